"""Conversations from single message rows: roles, order, runs of one role, sessions, and pairs of question and answer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordered import chunked, with_latest, with_position, with_previous
from recordloom.operators.skew import salted_join
from recordloom.session import checkpointed, written

# How roles are typed, and what stands in for a missing text.
USER_ROLES = ("user", "human", "usr", "patient", "doctor", "clinician", "customer", "client", "person", "me", "u")
ASSISTANT_ROLES = ("assistant", "ai", "bot", "model", "agent", "assist", "asst", "chatbot", "a")
SYSTEM_ROLES = ("system", "sys", "developer", "tool")
STAND_INS = (
    "n/a", "na", "n.a", "n.a.", "null", "none", "nil", "nan", "undefined", "empty", "missing", "blank", "(no response)", "no response", "[no response]", "<no response>", "(empty)", "[empty]",
    "(null)", "<null>", "(none)", "no answer", "(no answer)", "no reply", "(no reply)", "no content", "(no content)", "[no content]", "tbd", "unknown", "not available", "(blank)",
)
ORDER = ("createdAt", "_id")


def role_code(role: Column) -> Column:
    """USER, ASSISTANT, SYSTEM, or null for a role that is missing or cannot be read."""
    typed = F.regexp_replace(F.lower(role), r"[^\p{L}]", "")
    return (
        F.when(typed.isin(*USER_ROLES), "USER").when(typed.isin(*ASSISTANT_ROLES), "ASSISTANT").when(typed.isin(*SYSTEM_ROLES), "SYSTEM").otherwise(F.lit(None).cast("string"))
    )


def is_blank(content: Column) -> Column:
    """Null, without letter or digit, or only a stand-in for a missing value."""
    return content.isNull() | ~content.rlike(r"[\p{L}\p{N}]") | F.lower(F.regexp_replace(content, r"^[\s​﻿]+|[\s​﻿]+$", "")).isin(*STAND_INS)


def messages_once(messages: DataFrame, with_content: bool) -> DataFrame:
    """Each message once (the delivery that came first), with code, blank and createdAt; ``content`` only where asked for."""
    kept = ["conversation", "code", "blank", "createdAt", *(["content"] if with_content else [])]
    typed = messages.select("_id", "conversation", "createdAt", "receivedAt", role_code(F.col("role")).alias("code"), is_blank(F.col("content")).alias("blank"), *(["content"] if with_content else []))
    first = F.min_by(F.struct(*kept), F.struct(F.coalesce("receivedAt", F.col("createdAt")), *(["content"] if with_content else ["blank"])))
    return typed.groupBy("_id").agg(first.alias("m")).select("_id", "m.*")


def defects(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation, defect) for the keys of ``conversations`` (_id) that should be dropped, one row for each defect.

    'empty': no USER or ASSISTANT row that is not blank (also: no row at all); then nothing else is listed. 'no_reply',
    'no_question': a run of one side without a neighbouring run of the other side that holds a row that is not blank, after or
    before it. 'no_role': a row whose role cannot be read. Rows delivered twice count once; null conversations are left out.
    """
    once = checkpointed(messages_once(messages, with_content=False))  # read for the borders of chunks, the chunks and the lost roles
    turns = chunked(once.where("code IN ('USER', 'ASSISTANT')").select("_id", "conversation", "code", "blank", "createdAt"), "conversation", ORDER)
    marked = with_previous(turns, "conversation", ORDER, F.col("code"), "before")
    here = F.struct(*ORDER)
    begun = with_latest(marked, "conversation", ORDER, F.when(F.col("before").isNull() | (F.col("before") != F.col("code")), here), "run")
    linked = with_previous(begun, "conversation", ORDER, F.col("run"), "run_before")
    runs = linked.groupBy("conversation", "run").agg(
        F.max("code").alias("code"), F.max(~F.col("blank")).alias("says"), F.max(F.when(F.col("run_before") != F.col("run"), F.col("run_before"))).alias("run_before")
    )
    earlier = runs.select("conversation", F.col("run").alias("run_before"), F.col("says").alias("said_before"))
    joined = runs.join(earlier, ["conversation", "run_before"], "left")
    later = runs.where("run_before IS NOT NULL").select("conversation", F.col("run_before").alias("run"), F.col("says").alias("says_after"))
    judged = joined.join(later, ["conversation", "run"], "left")
    by_run = judged.groupBy("conversation").agg(
        F.max("says").alias("says"),
        F.max((F.col("code") == "USER") & ~F.coalesce("says_after", F.lit(False))).alias("no_reply"),
        F.max((F.col("code") == "ASSISTANT") & ~F.coalesce("said_before", F.lit(False))).alias("no_question"),
    )
    lost = once.where("code IS NULL AND conversation IS NOT NULL").select("conversation").distinct().withColumn("no_role", F.lit(True))
    keys = conversations.select(F.col("_id").alias("conversation")).where("conversation IS NOT NULL").distinct()
    all_keys = keys.join(by_run, "conversation", "left").join(lost, "conversation", "left")
    empty = ~F.coalesce("says", F.lit(False))
    found = F.when(empty, F.array(F.lit("empty"))).otherwise(
        F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(c)) for c in ("no_reply", "no_question", "no_role"))), lambda x: x.isNotNull())
    )
    return all_keys.select("conversation", F.explode(found).alias("defect"))


def calibrated_gap(gaps: DataFrame) -> float:
    """The pause in seconds that parts sessions, from the histogram of log2 pauses (at most 64 rows reach the driver).

    The pauses within a session and those between sessions form two hills: the cut is the middle of the widest valley above the
    median, a stretch of bins that together hold at most one pause in a thousand. No such valley below a longer pause: infinity.
    """
    rows = gaps.where("gap > 0").groupBy(F.greatest(F.lit(-8), F.least(F.lit(55), F.floor(F.log2("gap")))).alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = {int(r["bin"]): r["n"] for r in rows}
    total = sum(counts.values())
    if not counts:
        return math.inf
    below, median = 0, max(counts)
    for b in sorted(counts):
        below += counts[b]
        if below * 2 >= total:
            median = b
            break
    best, cut = 0, math.inf
    for start in range(median + 1, max(counts)):
        held, end = 0, start
        while end < max(counts) and held + counts.get(end, 0) <= total / 1000:
            held += counts.get(end, 0)
            end += 1
        if end - start > best and counts.get(start, 0) == 0:
            best, cut = end - start, 2.0 ** ((start + end) / 2)
    return cut


def rebuilt(messages: DataFrame, conversations: DataFrame, gap: float | None = None) -> DataFrame:
    """Ordered conversations without defects: (conversation, session, turn, speaker, role_inferred, createdAt, _id, content).

    Sessions end at pauses of at least ``gap`` seconds (calibrated on all pauses where None). A role that cannot be read is taken
    from its neighbours: speakers take turns from the last row whose role is known, or back from the first such row. Conversations whose runs lack a reply or a
    question, or that are empty, are dropped as a whole; sessions in which only one side speaks are dropped too.
    """
    bad = defects(messages, conversations).where("defect <> 'no_role'").select("conversation").distinct()
    known = conversations.select(F.col("_id").alias("conversation")).where("conversation IS NOT NULL").distinct()
    good = known.join(bad, "conversation", "left_anti")
    once = messages_once(messages, with_content=True).where("coalesce(code, '') <> 'SYSTEM' AND NOT blank")
    rows = chunked(salted_join(once, good, ["conversation"], F.col("_id"), "left_semi"), "conversation", ORDER)
    timed = with_previous(rows, "conversation", ORDER, F.struct(F.col("createdAt").alias("at"), F.col("code").alias("code")), "last")
    seconds = (F.unix_micros(F.col("createdAt").cast("timestamp")) - F.unix_micros(F.col("last.at").cast("timestamp"))) / 1e6
    timed = timed.withColumn("gap", F.when(F.col("last").isNotNull(), seconds))
    pause = calibrated_gap(timed) if gap is None else gap
    starts = F.when(F.col("gap").isNull() | (F.col("gap") >= F.lit(pause)), F.struct(*ORDER))
    known_role = F.when(F.col("code").isNotNull(), F.col("code"))
    sessions = with_latest(timed, "conversation", ORDER, starts, "session_start")
    # a lost role continues the turns from the last row whose role is known, by the number of rows since; before any, it answers to the next one
    numbered = with_position(sessions, "conversation", ORDER, "turn")
    heard = with_latest(numbered, "conversation", ORDER, F.when(known_role.isNotNull(), F.struct(known_role.alias("code"), F.col("turn").alias("turn"))), "heard")
    first = heard.where("code IS NOT NULL").groupBy("conversation").agg(F.min_by(F.struct("code", "turn"), "turn").alias("first"))
    heard = salted_join(heard, first, ["conversation"], F.col("_id"), "left")
    anchor = F.coalesce("heard", "first")
    other = F.when(anchor["code"] == "USER", "ASSISTANT").otherwise("USER")
    inferred = F.when(F.abs(F.col("turn") - anchor["turn"]) % 2 == 0, anchor["code"]).otherwise(other)
    sessions = heard.withColumn("speaker", F.coalesce("code", inferred, F.lit("USER")))
    both = sessions.groupBy("conversation", "session_start").agg(F.countDistinct("speaker").alias("sides")).where("sides = 2").drop("sides")
    kept = salted_join(sessions, both, ["conversation", "session_start"], F.col("_id"), "left_semi")
    return kept.select("conversation", F.col("session_start.createdAt").alias("session"), "turn", "speaker", F.col("code").isNull().alias("role_inferred"), "createdAt", "_id", "content")


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(answer_id, answer, question_id, question, answer_blank): ASSISTANT rows whose nearest earlier USER or ASSISTANT row is a USER row."""
    once = written(messages_once(messages, with_content=True).where("code IN ('USER', 'ASSISTANT')"))
    turns = chunked(once, "conversation", ORDER)
    paired = with_previous(turns, "conversation", ORDER, F.struct(F.col("code").alias("code"), F.col("_id").alias("id"), F.col("content").alias("content")), "q")
    return paired.where("code = 'ASSISTANT' AND q.code = 'USER'").select(
        F.col("_id").alias("answer_id"), F.col("content").alias("answer"), F.col("q.id").alias("question_id"), F.col("q.content").alias("question"), F.col("blank").alias("answer_blank")
    )
