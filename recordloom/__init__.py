"""recordloom: clinical-record analytics written with the PySpark DataFrame API."""
