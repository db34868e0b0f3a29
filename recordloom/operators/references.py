"""References to keys of other tables that are missing, deleted or younger than the referring row.

The parents' integer keys are sorted and compressed to runs of consecutive keys. The distinct referenced keys are matched as-of
to the preceding run start; a key beyond the end of that run has no parent. Both sides are cut into blocks of the key space, so
that no task sees more than one block of distinct keys, however many rows refer to one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.skew import salted_join

BLOCK = 1 << 16


def key_runs(parents: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive keys: (space, block, run_start, run_end, run_latest).

    ``parents`` has space (the name of the table), key and created. Null keys are left out, repeated keys count once.
    ``run_latest`` is the latest ``created`` in the run. Runs end at block borders.
    """
    keys = parents.where(F.col("key").isNotNull()).groupBy("space", "key").agg(F.max("created").alias("created"))
    in_block = Window.partitionBy("space", "block").orderBy("key")
    numbered = keys.withColumn("block", F.floor(F.col("key") / block)).withColumn("island", F.col("key") - F.row_number().over(in_block))
    return numbered.groupBy("space", "block", "island").agg(
        F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.max("created").alias("run_latest")
    ).drop("island")


def match_runs(keys: DataFrame, runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each distinct (space, key) of ``keys`` with the run that starts at or before it: adds run_end and run_latest.

    Both are null where no run of the block starts at or before the key. A key is present iff key <= run_end.
    """
    points = keys.withColumn("block", F.floor(F.col("key") / block)).withColumn("is_ref", F.lit(1))
    starts = runs.select(
        "space", "block", F.col("run_start").alias("key"), F.lit(0).alias("is_ref"), F.struct("run_end", "run_latest").alias("run")
    )
    upto = Window.partitionBy("space", "block").orderBy("key", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(starts, allowMissingColumns=True).withColumn("run", F.last("run", ignorenulls=True).over(upto))
    return both.where("is_ref = 1").select(*keys.columns, "run.run_end", "run.run_latest")


def orphan_references(refs: DataFrame, parents: DataFrame, deleted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``refs`` whose key does not hold, once each, with ``kind``.

    ``refs``: table_name, field_name, row_id, space, key, created. ``parents``: space, key, created. ``deleted``: space, key.
    ``kind`` is 'deleted' for an absent key that ``deleted`` lists, 'missing' for another absent key, 'late' for a key whose
    parent has a later ``created`` than the row. Null keys refer to nothing and are left out; a null ``created`` on either side
    is never late; rows delivered twice come out once; empty tables give no rows or only absent keys.
    """
    used = refs.select("table_name", "field_name", "row_id", "space", "key", "created").where(F.col("key").isNotNull())
    parents, deleted = parents.select("space", "key", "created"), deleted.select("space", "key")
    keys = used.groupBy("space", "key").agg(F.min("created").alias("first_use"))
    matched = match_runs(keys, key_runs(parents, block), block)
    absent = matched.where(~F.coalesce(F.col("key") <= F.col("run_end"), F.lit(False))).select("space", "key")
    gone = deleted.select("space", "key", F.lit("deleted").alias("logged")).distinct()
    absent = absent.join(gone, ["space", "key"], "left").select(
        "space", "key", F.coalesce("logged", F.lit("missing")).alias("status"), F.lit(None).cast("timestamp_ntz").alias("parent_created")
    )
    doubtful = matched.where((F.col("key") <= F.col("run_end")) & (F.col("first_use") < F.col("run_latest"))).select("space", "key", "first_use")
    born = parents.groupBy("space", "key").agg(F.max("created").cast("timestamp_ntz").alias("parent_created"))
    late = doubtful.join(born, ["space", "key"]).where("first_use < parent_created").select("space", "key", F.lit("late").alias("status"), "parent_created")
    rows = salted_join(used, absent.unionByName(late), ["space", "key"], F.col("row_id"))
    kept = rows.where((F.col("status") != "late") | (F.col("created") < F.col("parent_created")))
    return kept.select(
        "table_name", "row_id", "field_name", F.col("status").alias("kind"), "key", "created"
    ).dropDuplicates(["table_name", "row_id", "field_name", "kind"])
