import random

import pytest

from recordloom.llm.names import map_names, reference_spellings, weighted_distance

REF = [(1, "Nelzusetrane", ["Prapetasus"], "x"), (2, "Veltapril", [], "x"), (3, "Lommogliptan", ["Lomranelan", "Fernioxaan"], "x"), (4, "Ramlidoprine", None, "x"), (5, "Ferveglagliptan", [], "x")]


def mapped(spark, values):
    ref = spark.createDataFrame(REF, "med_ref_id bigint, canonicalName string, brandNames array<string>, category string")
    df = spark.createDataFrame([(v, 1) for v in values], "value string, entry int")
    out = {}
    for r in map_names(df, ref).collect():
        out.setdefault(r.value, set()).add(r.entry)
    return out


def test_ways_of_typing(spark):
    cases = {
        "nelzusetrane": {1}, "  NELZUSETRANE ": {1}, "Tab. Nelzusetrane 40 mg": {1}, "Nelzüsetrane": {1}, "Nelzu setrane": {1}, "Nelzu-setrane XR": {1}, "Nelzusetrane (generic)": {1}, "Nelzuse.": {1}, "Nelzusetrnae": {1}, "Ne1zusetrane": {1},
        "Veltapreel": {2}, "T. Veltapril hydrochloride": {2}, "Prapetasus": {1}, "Lommogliptan/Veltapril": {2, 3}, "Fernioxaan & Ramlidoprine 1g": {3, 4}, "Rarnlidoprine 250mg": {4}, "herbal tea": {0}, "Glyglasetrane": {0}, "as before": {0},
        "???": {0}, "40 mg": {0}, "x" * 20000: {0}, "a b " * 3000: {0},
    }
    got = mapped(spark, [*cases, *cases, None, ""])
    assert got == cases


def test_empty_tables(spark):
    assert mapped(spark, []) == {}
    ref = spark.createDataFrame([], "med_ref_id bigint, canonicalName string, brandNames array<string>")
    assert reference_spellings(ref).count() == 0
    assert [(r.value, r.entry) for r in map_names(spark.createDataFrame([("abc",)], "value string"), ref).collect()] == [("abc", 0)]


def test_candidates_equal_brute_force(spark):
    """All values within two plain edits of a spelling are found, as a comparison of all pairs finds them."""
    rng = random.Random(2)

    def slip(w):
        i = rng.randrange(1, len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("bdgt") + w[i:], w[:i] + rng.choice("bdgt") + w[i + 1 :]])

    words = {i: n.lower() for i, n, _, _ in REF}
    typed = {slip(slip(w)) for w in words.values() for _ in range(12)}
    want = {v: {min((weighted_distance(v, w), i) for i, w in words.items())[1]} for v in typed if min(weighted_distance(v, w) for w in words.values()) <= 2}
    got = mapped(spark, sorted(typed))
    assert want and all(got[v] == want[v] for v in want)


def test_distance():
    assert weighted_distance("abc", "abc") == 0 and weighted_distance("abcd", "abdc") == pytest.approx(0.7) and weighted_distance("", "ab") == 2
