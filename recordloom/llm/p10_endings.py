"""p10: document texts cut by field limits or broken transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.endings import cut_keys, text_keys
from recordloom.operators.skew import salted_join
from recordloom.sources.tables import table


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    cut = cut_keys(docs, table(spark, folder, "medication_reference").select(F.col("canonicalName").alias("term")))
    return salted_join(text_keys(docs).select("doc_id", "source", "t1", "t2"), cut, ["t1", "t2"], F.col("doc_id"), "left_semi")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, cut documents and their rate, by source."""
    docs = table(spark, folder, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_docs"))
    cut = _cut(spark, folder).groupBy("source").agg(F.count("*").alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0))
    return docs.join(cut, "source", "left").select("source", "n_docs", n.alias("n_cut"), F.round(n / F.col("n_docs"), 6).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
ORACLES: dict[str, str] = {}
