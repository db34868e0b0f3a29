"""p8: held-out items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.leaks import leaked
from recordloom.sources.tables import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return leaked(docs, table(spark, folder, "eval_passages").select("item_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and longest passage by leaked item."""
    found = _leaks(spark, folder)
    return found.groupBy("item_id").agg(F.countDistinct("id").alias("n_docs"), F.max("span").alias("longest"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLES: dict[str, str] = {}
