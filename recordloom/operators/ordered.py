"""Order-dependent columns for keys that may hold a large part of all rows.

A window over such a key would run in one task. Here the rows are range-partitioned by (key, order), so that a hot key is cut into
chunks; windows run within (key, chunk), and what a chunk needs from the chunks before it is carried over. At most one key goes on
from one chunk to the next, so the carried table has fewer rows than there are chunks, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import checkpointed

CHUNK = "_chunk"


def chunked(df: DataFrame, key: str, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` with the column _chunk; (key, order) must be unique. Null keys are left out.

    The result is checkpointed: chunk borders come from sampling and must not change between the reads of one plan.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(key).isNotNull()).repartitionByRange(n, key, *order)
    return checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _carry(df: DataFrame, key: str, name: str, per_chunk: Column, running: bool) -> DataFrame:
    """(key, _chunk, name): the value that the chunks before hand on, for chunks that are not the first of their key."""
    ends = df.groupBy(key, CHUNK).agg(per_chunk.alias("_end"))
    before = Window.partitionBy(key).orderBy(CHUNK)
    if running:
        handed = F.last("_end", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    else:
        handed = F.lag("_end").over(before)
    return ends.select(key, CHUNK, handed.alias(name)).where(F.col(name).isNotNull())


def with_previous(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the row before in the order of the key; null in its first row.

    ``value`` must not be null (wrap it in a struct if it may be).
    """
    held = df.withColumn("_value", value)
    carry = _carry(held, key, "_handed", F.max_by("_value", F.struct(*order)), running=False)
    inside = F.lag("_value").over(Window.partitionBy(key, CHUNK).orderBy(*order))
    return held.join(F.broadcast(carry), [key, CHUNK], "left").withColumn(name, F.coalesce(inside, "_handed")).drop("_value", "_handed")


def with_latest(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the latest ``value`` that is not null up to and with this row of the key."""
    held = df.withColumn("_value", value)
    stamp = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carry = _carry(held, key, "_handed", F.max_by("_value", stamp), running=True)
    upto = Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last("_value", ignorenulls=True).over(upto)
    return held.join(F.broadcast(carry), [key, CHUNK], "left").withColumn(name, F.coalesce(inside, "_handed")).drop("_value", "_handed")


def with_position(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number, from 1, in the order of the key."""
    counts = df.groupBy(key, CHUNK).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(key, CHUNK, F.sum("_n").over(before).alias("_handed")).where("_handed IS NOT NULL")
    inside = F.row_number().over(Window.partitionBy(key, CHUNK).orderBy(*order)).cast("bigint")
    return df.join(F.broadcast(carry), [key, CHUNK], "left").withColumn(name, inside + F.coalesce("_handed", F.lit(0))).drop("_handed")


def with_total_before(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the key before this one; 0 in its first row. Null values count as 0."""
    held = df.withColumn("_value", F.coalesce(value, F.lit(0)))
    counts = held.groupBy(key, CHUNK).agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(key, CHUNK, F.sum("_n").over(before).alias("_handed")).where("_handed IS NOT NULL")
    inside = F.sum("_value").over(Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = F.coalesce(inside, F.lit(0)) + F.coalesce("_handed", F.lit(0))
    return held.join(F.broadcast(carry), [key, CHUNK], "left").withColumn(name, summed).drop("_value", "_handed")
