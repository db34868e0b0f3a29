"""Column expressions of the normal forms on constructed rows, nulls and empty texts among them."""

import pytest
from pyspark.sql import functions as F

from recordloom.plans import normal as N
from recordloom.plans import retrieval


def values(spark, rows, schema, make):
    return [r[0] for r in spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", i int").orderBy("i").select(make).collect()]


def test_secrets(spark):
    rows = [("Authorization: Bearer abc.def, next",), ("api_key=12345; TOKEN : xyz",), ("nothing here",), (None,), ("",), ("key=" + "a" * 2000 + " " + "b" * 2000,)]
    got = values(spark, rows, "m string", N.redacted_secrets(F.col("m")))
    assert got[:5] == ["Authorization: Bearer [redacted], next", "api_key=[redacted]; TOKEN=[redacted]", "nothing here", None, ""]
    assert got[5].startswith("key=[redacted] b") and len(got[5]) == 700


def test_names_and_types(spark):
    assert values(spark, [("Ann  Mary Lee",), (" bo",), ("",), (None,), ("  ",)], "n string", N.initials(F.col("n"))) == ["AM", "b", "P", "P", ""]
    rows = [("A.PDF", None), ("b.jpeg", "x"), ("c.webp", ""), ("d", "Text/Plain"), (None, None), ("pdf", "")]
    assert values(spark, rows, "n string, p string", N.mime(F.col("n"), F.col("p"))) == ["application/pdf", "image/jpeg", "image/webp", "text/plain", "", ""]


def test_confidence(spark):
    rows = [(0.5,), (1.0,), (92.0,), (250.0,), (-3.0,), (0.0,), (None,), (0.849,)]
    assert values(spark, rows, "c double", N.ratio(F.col("c"))) == [0.5, 1.0, 0.92, 2.5, -3.0, 0.0, None, 0.849]
    assert values(spark, rows, "c double", N.percent_shown(F.col("c"))) == [50, 100, 92, 100, 0, 90, 90, 85]
    assert values(spark, rows, "c double", N.extraction_tier(F.col("c")))[-1] == "REVIEW_RECOMMENDED"


def test_boxes(spark):
    ok, default = [1.0, 2.0, 3.0, 100.0], [0.0, 0.0, 5.0, 5.0]
    rows = [(ok, None), ([1.0, 2.0, 3.0], default), ([1.0, 2.0, 3.0, 101.0], default), ([1.0, None, 3.0, 4.0], None), ([1.0, float("nan"), 3.0, 4.0], default), (None, [1.0]), (None, None)]
    assert values(spark, rows, "b array<double>, d array<double>", N.valid_box(F.col("b"), F.col("d"))) == [ok, default, default, None, default, None, None]


@pytest.mark.parametrize("a, b, want", [([" Asthma", "gout", ""], ["ASTHMA", None], ["Asthma", "gout"]), (None, ["x"], ["x"]), (None, None, []), ([], ["a", "a", "A"], ["a"])])
def test_merged_lists(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(N.merged_list(F.col("a"), F.col("b"))).first()[0] == want


def test_upsert(spark):
    old = spark.createDataFrame([("h1", 1), ("h2", 1)], "hash string, record int")
    new = spark.createDataFrame([("h2", 1), ("h3", 2)], "hash string, record int")
    assert {tuple(r) for r in retrieval.upserted(old, new).collect()} == {(1, "h1", "delete"), (1, "h2", "keep"), (2, "h3", "insert")}
    assert {r.action for r in retrieval.upserted(old.limit(0), new).collect()} == {"insert"} and retrieval.upserted(old.limit(0), new.limit(0)).count() == 0
