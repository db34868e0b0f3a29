"""Joins on similar strings that never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit_join(left: DataFrame, right: DataFrame, max_edits: int = 2) -> DataFrame:
    """Pairs (l, r, distance) of distinct strings ``left``.l and ``right``.r within ``max_edits`` Levenshtein edits.

    Exact: ``r`` is cut into max_edits + 1 pieces; within so many edits one piece stays whole and moves by at most max_edits
    places, so all pairs meet on (length of r, piece number, piece). Strings too short to be cut meet on their length alone; they
    are few. Nulls match nothing; an empty string is a string of length 0.
    """
    k = max_edits + 1
    r = right.select("r").where("r IS NOT NULL").distinct().withColumn("m", F.length("r"))
    q = left.select("l").where("l IS NOT NULL").distinct().withColumn("n", F.length("l"))
    lengths = F.sequence(F.greatest(F.col("n") - max_edits, F.lit(0)), F.col("n") + max_edits)

    def start(m: Column, i: int) -> Column:  # 1-based start of piece i of a string of length m
        return (F.floor(m * i / k) + 1).cast("int")

    long_r = r.where(F.col("m") >= k)
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), F.substring("r", start(F.col("m"), i), start(F.col("m"), i + 1) - start(F.col("m"), i)).alias("piece")) for i in range(k)))
    index = long_r.select("r", "m", F.explode(pieces).alias("p")).select("r", "m", "p.*")

    def probes(i: int) -> Column:
        def at(shift: Column) -> Column:
            s = start(F.col("m"), i) + shift
            size = start(F.col("m"), i + 1) - start(F.col("m"), i)
            return F.when((s >= 1) & (s + size - 1 <= F.col("n")), F.struct(F.lit(i).alias("i"), F.substring("l", s, size).alias("piece")))

        return F.transform(F.sequence(F.lit(-max_edits), F.lit(max_edits)), at)

    spread = q.select("l", "n", F.explode(lengths).alias("m")).where(F.col("m") >= k)
    asked = spread.select("l", "m", F.explode(F.array_distinct(F.filter(F.concat(*(probes(i) for i in range(k))), lambda x: x.isNotNull()))).alias("p")).select("l", "m", "p.*")
    met = asked.join(index, ["m", "i", "piece"]).select("l", "r").distinct()
    short = q.select("l", F.explode(lengths).alias("m")).where(F.col("m") < k).join(r.where(F.col("m") < k), "m").select("l", "r")
    pairs = met.unionByName(short)
    return pairs.withColumn("distance", F.levenshtein("l", "r", max_edits)).where("distance >= 0").withColumn("distance", F.col("distance").cast("bigint"))


def contains_join(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (query_id, id) whose ``rows``.text contains ``queries``.q (three letters or longer) as a substring.

    Exact: each query is looked up by the rarest of its trigrams among the rows, and the substring is then checked.
    """
    def grams(x: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))

    texts = rows.where(F.length("text") >= 3)
    index = texts.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    asked = queries.where(F.length("q") >= 3).select("query_id", "q", F.explode(grams(F.col("q"))).alias("gram"))
    rarest = asked.join(df, "gram").groupBy("query_id", "q").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    hits = rarest.join(index, "gram").join(texts, "id")
    return hits.where(F.contains(F.col("text"), F.col("q"))).select("query_id", "id").distinct()
