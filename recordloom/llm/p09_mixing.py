"""p9: the sources of documents mixed to their target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm.mixing import mixed, tokenizer_file
from recordloom.sources.tables import table


def _mixed(spark: SparkSession, folder: str, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixed(docs, table(spark, folder, "mix_targets"), vocabulary or tokenizer_file())


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, folder)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
