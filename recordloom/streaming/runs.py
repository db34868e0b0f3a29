"""Structured Streaming over the event table: windows, de-duplication, limits and an index that grows with its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import tokens
from recordloom.session import shared_folder
from recordloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files; ``ts`` becomes a timestamp that watermarks accept."""
    path = f"{folder}/{name}.parque[t]"  # a pattern, as a file source takes folders and patterns but no single file
    df = spark.readStream.schema(table(spark, folder, name).schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def finished(df: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all that is there, each batch written to the shared folder, and read the result."""
    spark, base = df.sparkSession, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    how = "append" if mode == "append" else "overwrite"
    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{base}/out")).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts by event-time hour and type."""
    agg = stream(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return finished(agg.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total"), "complete")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_running_counts(s, d):
    return finished(stream(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts >= before + INTERVAL 10 MINUTE")
def stream_dedup_within_ttl(s, d):
    """Events without another of the same user and type in the ten minutes before; each event renews the ten minutes."""
    runs = stream(s, d, "events").groupBy(F.session_window("ts", "10 minutes"), "user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return finished(runs.select("first.event_id", "user_id", "event_type"), "complete")


@query("WITH t AS (SELECT unnest(list_filter(string_split_regex(regexp_replace(lower(originalFilename), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'was', 'were', 'that', 'this', 'are', 'has', 'have'))) AS token FROM clinical_documents) SELECT token, count(*) AS n FROM t GROUP BY 1")
def stream_incremental_index(s, d):
    """Token counts of file names kept by a stream equal those of a rebuild."""
    words = stream(s, d, "clinical_documents").select(F.explode(tokens(F.col("originalFilename"))).alias("token"))
    return finished(words.groupBy("token").agg(F.count("*").alias("n")), "complete")


LIMIT, WINDOW = 3, "15 minutes"


def rate_limited(events: DataFrame) -> DataFrame:
    """(user_id, window, n): events (user_id, ts) by user and window of event time."""
    return events.groupBy("user_id", F.window("ts", WINDOW).alias("w")).agg(F.count("*").alias("n"))


@query()
def stream_rate_limit(s, d):
    """Accepted and rejected events by user: of each window of fifteen minutes the first LIMIT events are accepted.

    The windows are aligned to the epoch. The source application begins a window at the first request of a user after the last
    window; that depends on the order in which events arrive, these windows do not, and they are counted before the shuffle.
    """
    counts = finished(rate_limited(stream(s, d, "events")), "complete")
    accepted = F.least("n", F.lit(LIMIT))
    return counts.groupBy("user_id").agg(F.sum(accepted).alias("accepted"), F.sum(F.col("n") - accepted).alias("rejected"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_event, count(*) AS n FROM n GROUP BY user_id, k"
)
def session_counts(s, d):
    """Sessions of a user that end after thirty minutes without an event (the same expression runs on a stream)."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    agg = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").cast("timestamp_ntz").alias("first_event"), F.count("*").alias("n"))
    return agg.select("user_id", "first_event", "n")
