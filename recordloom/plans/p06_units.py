"""p6: laboratory results recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.units import recorded_units
from recordloom.sources.tables import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "investigation_items").select("item_id", "testName", "resultValue", "numericValue", "units", "referenceRange")
    return items.dropDuplicates(["item_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = recorded_units(_items(spark, folder), table(spark, folder, "lab_units"))
    return rows.where("unit_code <> common_unit").select("item_id", "unit_code")


def p6_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Every numeric result in the common unit of its test."""
    rows = recorded_units(_items(spark, folder), table(spark, folder, "lab_units"))
    return rows.select("item_id", F.col("field").alias("test_code"), "value", "unit_code", "source", "common_unit", F.round("common_value", 6).alias("common_value"))


QUERIES = {"p6_found": p6_found, "p6_converted": p6_converted}
ORACLES: dict[str, str] = {}
