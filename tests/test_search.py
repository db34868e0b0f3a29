"""The stages of the search on small tables, the page of a prefix against brute force."""

import pytest

from recordloom.operators import search as S

ROWS = [("patient_1", "patient", "Ann Lee", "M1", "fullName", "Ann Lee"), ("patient_1", "patient", "Ann Lee", "M1", "phone", "555 010"), ("patient_2", "patient", "Anna Leeds", None, "fullName", "Anna Leeds"), ("doc_7", "document", "scan-of-anna.pdf", "LAB", "originalFilename", "scan-of-anna.pdf")]
FIELDS = "id string, kind string, title string, subtitle string, field string, text string"


def search(spark, *asked):
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, q string")
    return {(r.query_id, r.id): (r.stage, r.score) for r in S.fused(queries, spark.createDataFrame(ROWS, FIELDS)).collect()}


def test_stages(spark):
    got = search(spark, "ann lee", "ann lxe", "of-a", "55", "", "zzzz", None)
    assert got[("ann lee", "patient_1")] == ("prefix", 100 + 5 * 15.0)
    assert got[("ann lxe", "patient_1")][0] == "index"
    assert got[("of-a", "doc_7")] == ("substring", 40.0)
    assert got[("55", "patient_1")] == ("prefix", 100.0)  # phones are phrases but have no postings
    assert {q for q, _ in got} == {"ann lee", "ann lxe", "of-a", "55"}


def test_nearest_phrase_only_where_nothing_else_is_found(spark):
    got = search(spark, "anna-leedz", "anna leedz")
    assert got[("anna-leedz", "patient_2")] == ("fuzzy", 75 - 2 * 15.0)
    assert got[("anna leedz", "patient_2")][0] == "index"  # the token anna is found


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELDS)
    asked = spark.createDataFrame([("a", "ann")], "query_id string, q string")
    assert S.fused(asked, none).collect() == [] and S.fused(asked.limit(0), spark.createDataFrame(ROWS, FIELDS)).collect() == []


def test_prefix_page_equals_brute_force(spark):
    phrases = [(f"e{i:03d}", "document", p) for i, p in enumerate(["rx-" + "ab"[i % 2] * (i % 40) for i in range(300)] + ["rx-", "r", "rx-a", ""])]
    asked = ["r", "rx-", "rx-a", "rx-" + "b" * 9, "rx-" + "b" * 37, "x", ""]
    got = S.by_prefix(spark.createDataFrame([(q, q) for q in asked], "query_id string, q string"), spark.createDataFrame(phrases, "id string, kind string, phrase string")).collect()
    want = set()
    for q in filter(None, asked):
        met = sorted((i, p == q) for i, _, p in phrases if p.startswith(q))
        want |= {(q, i) for i, _ in [x for n, x in enumerate(met) if n < 25 or x[1]][:30]}
    assert {(r.query_id, r.id) for r in got} == want and len(got) == len(want)


def test_page_needs_few_entities_of_a_common_token(spark):
    """The first page is that of all entities; of 300 entities of a common token only those that can be on it are joined with each query."""
    rows = [(f"patient_{i:03d}", "patient", t, None, "fullName", t) for i, t in enumerate(["Ann Lee", "Lee Ann Ann", "Marianna Leeds", *(f"Ann {'xyz'[i % 3]}{i}q" for i in range(300)), *["Ann"] * 3])]
    rows += [("rec_1", "record", "ann", "LAB", "verificationNotes", "ann " * 30), ("rec_2", "record", "ann lee", "LAB", "verificationNotes", "lee " * 12)]
    fields, asked = spark.createDataFrame(rows, FIELDS), ["ann lee", "ann x0q", "ann", "ann ann", "anna le", "lee", "zann lee"]
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, q string")

    def first(page):
        return {tuple(r) for r in S.top_results(S.fused(queries, fields, page)).select("query_id", "place", "id", "stage", "score").collect()}

    assert first(15) == first(None)
    assert S.leading(queries.where("q = 'ann x0q'"), S.postings(fields), 15).distinct().count() <= 15 + S.PREFIX_PAGE + 1


@pytest.mark.parametrize("asked, size", [(None, 20), ("", 20), ("abc", 20), (0, 20), ("30", 30), (500, 50), (15, 15)])
def test_page_size(asked, size):
    assert S.page_size(asked) == size
