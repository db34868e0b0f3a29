import datetime as dt
import math
import random

from recordloom.llm.conversations import answer_pairs, calibrated_gap, defects, rebuilt

SCHEMA = "_id bigint, conversation bigint, role string, content string, createdAt timestamp_ntz, receivedAt timestamp_ntz, code string, blank boolean"


def frame(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, r, x, None if s is None else t0 + dt.timedelta(seconds=s), None, "z", None) for i, c, r, x, s in rows], SCHEMA)


def keys(spark, ids):
    return spark.createDataFrame([(i, 0) for i in ids], "_id bigint, conversation int")


def brute(rows, ids):
    code = lambda r: {"USER": "U", "human": "U", "ASSISTANT": "A", "bot": "A", "SYSTEM": "S"}.get((r or "").strip())
    blank = lambda x: x is None or x.strip() in ("", "...", "N/A")
    out = set()
    for c in ids:
        mine = sorted({r for r in rows if r[1] == c}, key=lambda r: (r[4], r[0]))
        turns = [(code(r[2]), blank(r[3])) for r in mine if code(r[2]) in ("U", "A")]
        if all(b for _, b in turns):
            out.add((c, "empty"))
            continue
        runs = []
        for k, b in turns:
            if runs and runs[-1][0] == k:
                runs[-1][1] |= not b
            else:
                runs.append([k, not b])
        for i, (k, _) in enumerate(runs):
            if k == "U" and not (i + 1 < len(runs) and runs[i + 1][1]):
                out.add((c, "no_reply"))
            if k == "A" and not (i > 0 and runs[i - 1][1]):
                out.add((c, "no_question"))
        if any(code(r[2]) is None for r in mine):
            out.add((c, "no_role"))
    return out


def test_defects_equal_brute_force_with_a_hot_conversation(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        c = rng.choice([1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9])
        rows.append((i, c, rng.choice(["USER", "ASSISTANT", "human", "bot ", "SYSTEM"] + ["?", None] * (c in (3, 4))), rng.choice(["text 1", "hello", "..." if c % 2 else "x", None]), rng.randrange(200)))
    rows += [(800, 10, "SYSTEM", "x", 1), (801, 11, "USER", None, 1), (802, 12, "USER", "q", 1), (803, 12, "ASSISTANT", "a", 1)]
    rows += rows[:40]
    ids = list(range(1, 15))
    got = {(r.conversation, r.defect) for r in defects(frame(spark, rows), keys(spark, ids)).collect()}
    assert got == brute(rows, ids)
    assert (14, "empty") in got and not any(c == 12 for c, _ in got)


def test_rebuilt_orders_infers_and_splits(spark):
    rows = [(1, 1, "USER", "q1", 0), (2, 1, None, "a1", 5), (3, 1, "USER", "q2", 100_000), (4, 1, "ASSISTANT", "a2", 100_004), (5, 2, "USER", "alone", 0), (6, 1, "SYSTEM", "s", 2), (4, 1, "ASSISTANT", "a2", 100_004)]
    rows = [r if r[0] != 2 else (2, 1, "ASSISTANT", "a1", 5) for r in rows] + [(9, 3, "USER", "q", 0), (10, 3, "?", "maybe", 1), (11, 3, "ASSISTANT", "a", 2)]
    got = rebuilt(frame(spark, rows), keys(spark, [1, 2, 3]), gap=3600).orderBy("conversation", "turn").collect()
    assert [(r.conversation, r._id, r.turn, r.speaker) for r in got] == [(1, 1, 1, "USER"), (1, 2, 2, "ASSISTANT"), (1, 3, 3, "USER"), (1, 4, 4, "ASSISTANT"), (3, 9, 1, "USER"), (3, 10, 2, "ASSISTANT"), (3, 11, 3, "ASSISTANT")]
    assert len({r.session for r in got if r.conversation == 1}) == 2
    assert [r._id for r in got if r.role_inferred] == [10]


def test_calibrated_gap(spark):
    pauses = [20.0] * 400 + [60.0] * 400 + [86_400.0] * 20
    assert 200 < calibrated_gap(spark.createDataFrame([(p,) for p in pauses], "gap double")) < 50_000
    assert calibrated_gap(spark.createDataFrame([(20.0,)] * 5, "gap double")) == math.inf
    assert calibrated_gap(spark.createDataFrame([], "gap double")) == math.inf


def test_pairs(spark):
    rows = [(1, 1, "USER", "q", 0), (2, 1, "SYSTEM", "s", 1), (3, 1, "bot", "a", 2), (4, 1, "bot", "b", 3), (5, None, "bot", "c", 4), (6, 2, "bot", "d", 0)]
    assert [(r.answer_id, r.question_id) for r in answer_pairs(frame(spark, rows)).collect()] == [(3, 1)]


def test_empty(spark):
    assert defects(frame(spark, []), keys(spark, [])).count() == 0
    assert [r.defect for r in defects(frame(spark, []), keys(spark, [1])).collect()] == ["empty"]
    assert rebuilt(frame(spark, []), keys(spark, [1])).count() == 0
