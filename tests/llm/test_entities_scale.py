import datetime as dt
import random

from recordloom.llm import entities
from recordloom.llm.entities import LEAST_COSINE, candidate_pairs, date_keys, date_likeness, day_keys, distance_within, folded_name, likely, met, name_vectors, near_dates, pair_score
from recordloom.llm.names import weighted_distance
from pyspark.sql import functions as F


def test_one_birth_date_of_many_rows_loses_no_link(spark):
    """5,000 rows on one birth date: two rows of each person, the second with a slip, in another order."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "el", "in", "or", "un")]
    rows, truth = [], set()
    for k in range(2500):
        given, last = ("".join(rng.choice(syllables) for _ in range(3)) for _ in range(2))
        at = rng.randrange(1, len(last))
        rows += [(2 * k, f"{given} {last}"), (2 * k + 1, f"{last[:at]}{last[at + 1:]} {given}")]
        truth.add((2 * k, 2 * k + 1))
    people = spark.createDataFrame([(i, n, None, None, dt.date(1980, 1, 1)) for i, n in rows], "id bigint, name string, mrn string, phone string, birth date").withColumn("folded", folded_name(F.col("name")))
    found = {(r.a, r.b) for r in candidate_pairs(people).select("a", "b").collect()}
    assert truth <= found


def test_candidates_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(("anna", "ana", "mike", "michael", "lorphin", "lorfin", "galmibury", "tarrath")) for _ in range(2)), None, rng.choice((None, "70", "71")), rng.choice((None, dt.date(1980, 1, 1), dt.date(1980, 1, 2)))) for k in range(60)]
    people = spark.createDataFrame(rows, "id bigint, name string, mrn string, phone string, birth date").withColumn("folded", folded_name(F.col("name")))
    vectors = {}
    for r in name_vectors(people).collect():
        vectors.setdefault(r.id, {})[r.gram] = r.v
    want = set()
    for a, b in ((a, b) for a in rows for b in rows if a[0] < b[0]):
        shared = sum(x is not None and x == y for x, y in ((a[3], b[3]), (a[4], b[4])))
        cosine = sum(v * vectors[b[0]].get(g, 0.0) for g, v in vectors[a[0]].items())
        if shared and cosine >= LEAST_COSINE + 1e-9:
            want.add((a[0], b[0]))
    got = {(r.a, r.b) for r in candidate_pairs(people).collect()}
    assert want <= got


def test_split_keys_meet_all(spark, monkeypatch):
    import recordloom.llm.entities as E

    monkeypatch.setattr(E, "SPLIT", 3)
    df = spark.createDataFrame([(1, k) for k in range(20)] + [(2, k) for k in range(2)] + [(3, 7)], "key bigint, id bigint")
    got = sorted((r.key, r.a, r.b) for r in met(df, []).collect())
    assert got == sorted([(1, a, b) for a in range(20) for b in range(a + 1, 20)] + [(2, 0, 1)])


def test_exploded_rows_are_not_broadcast(spark):
    """What explode makes of a small table can be large: neither side of the join is sent to the driver, whatever Spark's estimate."""
    small = spark.range(40).select((F.col("id") % 4).alias("key"), "id")
    for pairs in (met(small, []), met(small, [], others=small)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.where("a < b").count() == 4 * 45


def test_rows_of_two_tables_meet_also_on_large_keys(spark, monkeypatch):
    monkeypatch.setattr(entities, "SPLIT", 3)
    left = spark.range(10).select(F.lit(1).alias("key"), "id").union(spark.range(2).select(F.lit(2), "id"))
    right = spark.range(12).select(F.lit(1).alias("key"), "id").union(spark.range(3).select(F.lit(2), "id"))
    want = sorted([(1, a, b) for a in range(10) for b in range(12) if a != b] + [(2, a, b) for a in range(2) for b in range(3) if a != b])
    for sent in (0, 9):
        monkeypatch.setattr(entities, "SENT_KEYS", sent)
        got = met(left, [], others=right, counted=left.where("key = 1"))
        assert sorted((r.key, r.a, r.b) for r in got.select("key", "a", "b").collect()) == want


def test_dates_near_each_other_share_a_key(spark):
    """Those that date_likeness calls near, and only these, for all dates around three of them."""
    firsts = [dt.date(1973, 8, 5), dt.date(1937, 12, 12), dt.date(1904, 2, 29), dt.date(2000, 1, 31)]
    dates = sorted({d + dt.timedelta(days=x) for d in firsts for x in (*range(-40, 41), *range(355, 375), *range(3640, 3660), 36524, 36525)} | {dt.date(y, d.month, min(d.day, 28)) for d in firsts for y in range(1860, 2041)} | {dt.date(d.year, m, k) for d in firsts for m in range(1, 13) for k in (5, 8, 12)})
    known = spark.createDataFrame([(d,) for d in dates], "d date")
    later, earlier = day_keys(F.col("d"))
    kept = [r for r in known.select("d", date_keys(F.col("d")).alias("k"), later.alias("later"), earlier.alias("earlier")).collect()]
    a, b = known.withColumnRenamed("d", "a"), known.withColumnRenamed("d", "b")
    near = {(r.a, r.b) for r in a.join(b, near_dates(F.col("a"), F.col("b"))).where("a < b").collect()}
    want = {(x, y) for x in dates for y in dates if x < y and date_likeness(x, y) == "near"}
    assert near == want
    keys = {r.d: (set(r.k), set(r.later), set(r.earlier)) for r in kept}
    assert all(keys[x][0] & keys[y][0] or keys[x][2] & keys[y][1] for x, y in want)


def test_bounds_hold(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeilnorstzkcuvbdm") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
    words += [w[:i] + rng.choice("eiynmzs") + w[i + rng.randrange(2) :] for w in words for i in (0, len(w) // 2)]
    for _ in range(4000):
        x, y, limit = rng.choice(words), rng.choice(words), rng.choice((1.25, 2.3, 3.0))
        d, got = weighted_distance(x, y), distance_within(x, y, limit)
        assert got == d if d <= limit else got > limit
    born, numbers = [None, dt.date(1973, 8, 5), dt.date(1973, 5, 8), dt.date(1950, 1, 1)], [None, "6071234567", "6071243567", "607123456", "6091234567", "1"]
    people = [(k, rng.choice(("ann orlowska", "ann", "orlowska a", "mark tolliver", None)), rng.choice(born), rng.choice(numbers), rng.choice(numbers), rng.choice(("m", "f", None))) for k in range(120)]
    df = spark.createDataFrame(people, "id int, name string, birth date, mrn string, phone string, sex string")
    pairs = df.select(F.col("id").alias("a")).join(df.select(F.col("id").alias("b"))).where("a < b")
    kept = {(r.a, r.b) for r in likely(pairs, df, 0.4).collect()}
    for a in people:
        for b in people[a[0] + 1 :]:
            score = pair_score(a[1], b[1], a[2], b[2], a[3], b[3], a[4], b[4], a[5], b[5], 1.0)
            assert (a[0], b[0]) in kept if score >= 0.4 else True, (a, b)
    assert 0 < len(kept) < 120 * 119 / 4
