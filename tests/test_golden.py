import pytest
from pyspark.sql import functions as F

from recordloom.functions.jsonx import repair
from recordloom.plans.scalars import lab_class


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a":1,"b":[1,2', '{"a":1,"b":[1,2]}'), ('{"a":1,"b":"xy', '{"a":1}'), ("no brace", None), (None, None), ("", None), ('<think>{x}</think>{"a":1}', '{"a":1}'), ('Here:\n```json\n{"a": [1]}\n```\nDone', '{"a":[1]}'),
        ('{"a":1, "b"', '{"a":1}'), ('{"a":1,', '{"a":1}'), ('{"a":"x', '{"a":"x"}'), ('{"a":{"b":1},"c":{"d":2', '{"a":{"b":1}}'), ('{"n":[' + "1," * 5000 + "oops", '{"n":[' + "1," * 4999 + "1]}"),
    ],
)
def test_json_repair(text, value):
    assert repair(text) == value


def test_lab_class(spark):
    cases = [
        ("Fasting Glucose", "99", "NORMAL"), ("Fasting Glucose", "110", "HIGH"), ("Fasting Glucose", "168", "CRITICAL"), ("Fasting Glucose", "69", "LOW"), ("HbA1c", "7.8", "HIGH"), ("HbA1c", "8.4", "CRITICAL"), ("HbA1c", "8.5", "CRITICAL"),
        ("Creatinine", "0.9", "NORMAL"), ("Creatinine", "1.3", "HIGH"), ("Creatinine", "1.8", "CRITICAL"), ("LDL cholesterol", "120", "HIGH"), ("Cholesterol", "1,234", "CRITICAL"), ("Haemoglobin", "14", "UNKNOWN"), ("Glucose", "Normal", "UNKNOWN"), (None, None, "UNKNOWN"),
    ]
    df = spark.createDataFrame(cases, "name string, result string, want string")
    assert df.where(lab_class(F.col("name"), F.col("result")) != F.col("want")).collect() == []
