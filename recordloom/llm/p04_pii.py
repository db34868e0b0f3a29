"""p4: personal data in messages, snippets and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.pii import personal_spans, personal_types, redacted
from recordloom.sources.tables import table

# The texts to look through.
TEXTS = [("messages", "_id", "content"), ("medication_items", "item_id", "textSnippet"), ("investigation_items", "item_id", "textSnippet"), ("medical_records", "_id", "verificationNotes")]


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, key, field in TEXTS:
        one = table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.lit(field).alias("field_name"), F.col(field).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _names(spark: SparkSession, folder: str) -> DataFrame:
    patients = table(spark, folder, "patients").select(F.col("fullName").alias("name"))
    reviewers = table(spark, folder, "medical_records").select(F.col("verifiedByName").alias("name"))
    return patients.unionByName(reviewers).unionByName(table(spark, folder, "conversations").select(F.col("doctorName").alias("name")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_types(_texts(spark, folder), _names(spark, folder))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    texts = _texts(spark, folder)
    return redacted(texts, personal_spans(texts, _names(spark, folder)))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLES: dict[str, str] = {}
