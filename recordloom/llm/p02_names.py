"""p2: medicine names typed freely, mapped to the medication reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.names import map_names
from recordloom.operators.skew import salted_join
from recordloom.sources.tables import table


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "medication_items")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("name", "genericName"))))
    return items.select("item_id", fields.alias("x")).select("item_id", "x.*").where("value IS NOT NULL AND value <> ''").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    reference = table(spark, folder, "medication_reference")
    typed = _typed(spark, folder)
    canonical = F.broadcast(reference.select(F.col("canonicalName").alias("value")).distinct())
    typed = typed.join(canonical, "value", "left_anti")
    mapped = map_names(typed.select("value"), reference)
    return salted_join(typed, mapped, ["value"], F.col("item_id")).select("item_id", "field_name", F.col("entry").alias("med_ref_id"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values that denote no entry, with the number of items that hold them."""
    typed = _typed(spark, folder)
    mapped = map_names(typed.select("value"), table(spark, folder, "medication_reference")).where("entry = 0")
    return typed.groupBy("field_name", "value").agg(F.count("*").alias("n_items")).join(mapped.select("value"), "value", "left_semi")


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
ORACLES: dict[str, str] = {}
