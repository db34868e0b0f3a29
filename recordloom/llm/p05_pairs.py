"""p5: useless answers of the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.conversations import answer_pairs
from recordloom.llm.pairs import defective
from recordloom.session import checkpointed
from recordloom.sources.tables import table


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    pairs = checkpointed(answer_pairs(table(spark, folder, "messages")))
    return defective(pairs, table(spark, folder, "medication_reference").select(F.col("canonicalName").alias("term")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select("answer_id", "defect")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of answers by defect, truncated ones also by what tells it."""
    return _defects(spark, folder).groupBy("defect", "evidence").agg(F.count("*").alias("n_answers"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES: dict[str, str] = {}
