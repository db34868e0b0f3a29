import datetime as dt
import random

from recordloom.operators.references import key_runs, orphan_references

REFS = "table_name string, field_name string, row_id bigint, space string, key bigint, created timestamp_ntz, status string, kind string"
PARENTS = "space string, key bigint, created timestamp_ntz, extra int"


def at(day):
    return None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def found(spark, refs, parents, deleted, block=8):
    r = spark.createDataFrame([("t", "f", i, s, k, at(c), "x", "y") for i, s, k, c in refs], REFS)
    p = spark.createDataFrame([(s, k, at(c), 1) for s, k, c in parents], PARENTS)
    d = spark.createDataFrame(deleted, "space string, key bigint")
    return sorted((x.row_id, x.kind) for x in orphan_references(r, p, d, block).collect())


def brute(refs, parents, deleted):
    born = {}
    for s, k, c in parents:
        if k is not None:
            born[s, k] = max((x for x in (born.get((s, k)), c) if x is not None), default=None)
    out = set()
    for i, s, k, c in refs:
        if k is None:
            continue
        if (s, k) not in born:
            out.add((i, "deleted" if (s, k) in deleted else "missing"))
        elif born[s, k] is not None and c is not None and c < born[s, k]:
            out.add((i, "late"))
    return sorted(out)


def test_against_brute_force_with_hot_key_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    parents = [(s, k, rng.choice([0, 5, 10, None])) for s in "ab" for k in range(-20, 60) if rng.random() < 0.6]
    parents += parents[:7]
    refs = [(i, rng.choice("ab"), rng.choice([None, 7, 7, 7, rng.randrange(-25, 70)]), rng.choice([0, 3, 8, 20, None])) for i in range(600)]
    refs += refs[:50]
    deleted = [("a", 7), ("a", 65), ("b", -25), ("b", 65), ("a", 65)]
    assert found(spark, refs, parents, deleted) == brute(refs, parents, set(deleted))


def test_runs_end_at_gaps_and_block_borders(spark):
    p = spark.createDataFrame([("s", k, at(0), 1) for k in (1, 2, 3, 7, 8, 9, 16, None, 3)], PARENTS)
    runs = sorted((r.run_start, r.run_end) for r in key_runs(p, 8).collect())
    assert runs == [(1, 3), (7, 7), (8, 9), (16, 16)]


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, "s", 5, 0)], [], []) == [(1, "missing")]
    assert found(spark, [], [("s", 5, 0)], []) == []
