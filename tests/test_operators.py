import random

from pyspark.sql import functions as F

from recordloom.functions.jsonx import repair
from recordloom.operators.ordered import chunked, with_latest, with_position, with_previous
from recordloom.operators.similarity import contains_join, edit_join
from recordloom.operators.skew import salted_join


def test_order_columns_over_chunks_equal_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), rng.randrange(40), i, rng.choice([1, 2, 3])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t int, id bigint, v int")
    order = ["t", "id"]
    c = chunked(df, "k", order, chunks=7)
    got = with_position(with_latest(with_previous(c, "k", order, F.col("v"), "prev"), "k", order, F.when(F.col("v") == 3, F.col("id")), "last3"), "k", order, "n")
    seen = {r.id: (r.prev, r.last3, r.n) for r in got.collect()}
    want, state = {}, {}
    for k, t, i, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        prev, last3, n = state.get(k, (None, None, 0))
        last3 = i if v == 3 else last3
        want[i] = (prev, last3, n + 1)
        state[k] = (v, last3, n + 1)
    assert seen == want
    assert c.select("_chunk").distinct().count() > 1


def test_order_columns_of_an_empty_table(spark):
    c = chunked(spark.createDataFrame([], "k string, t int"), "k", ["t"])
    assert with_position(with_previous(c, "k", ["t"], F.col("t"), "p"), "k", ["t"], "n").count() == 0


def test_salted_join_keeps_every_row_once(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 100)], "k int, id bigint")
    small = spark.createDataFrame([(1, "a"), (3, "c")], "k int, name string")
    assert salted_join(big, small, ["k"], F.col("id")).count() == 50
    assert salted_join(big, small, ["k"], F.col("id"), "left").count() == 52
    assert salted_join(big, small, ["k"], F.col("id"), "left_semi").count() == 50


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_join_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(90)]
    left, right = words[:40] + [None], words[30:] + [None]
    got = {(r.l, r.r, r.distance) for r in edit_join(spark.createDataFrame([(w,) for w in left], "l string"), spark.createDataFrame([(w,) for w in right], "r string")).collect()}
    want = {(a, b, lev(a, b)) for a in left if a is not None for b in right if b is not None and lev(a, b) <= 2}
    assert got == want


def test_contains_join_equals_brute_force(spark):
    texts = [(1, "abcabd"), (2, "xxabc"), (3, "ab"), (4, None), (5, "")]
    asked = [(10, "abc"), (11, "abd"), (12, "zzz"), (13, "ab"), (14, None)]
    got = {(r.query_id, r.id) for r in contains_join(spark.createDataFrame(asked, "query_id int, q string"), spark.createDataFrame(texts, "id int, text string")).collect()}
    assert got == {(10, 1), (10, 2), (11, 1)}


def test_json_repair():
    assert repair('{"a":1,"b":[1,2') == '{"a":1,"b":[1,2]}'
    assert repair('text ```{"a":"x"}``` more') == '{"a":"x"}'
    assert repair('{"a":1,"b') in ('{"a":1}', '{"a":1,"b":null}')
    assert repair('{"a":"x\\"y","c') is not None
    assert repair("") is None and repair(None) is None and repair("no json") is None
