"""p3: conversations rebuilt from message rows, and those to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.conversations import ASSISTANT_ROLES, STAND_INS, SYSTEM_ROLES, USER_ROLES, defects, rebuilt
from recordloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "messages"), table(spark, folder, "conversations"))


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return rebuilt(table(spark, folder, "messages"), table(spark, folder, "conversations"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of conversations by defect."""
    return p3_found(spark, folder).groupBy("defect").agg(F.count("*").alias("n_conversations"))


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_DEFECTS = rf"""
WITH once AS (
  SELECT _id, conversation, createdAt, content, regexp_replace(lower(role), '[^\p{{L}}]', '', 'g') AS typed FROM messages
  QUALIFY row_number() OVER (PARTITION BY _id ORDER BY coalesce(receivedAt, createdAt), content) = 1
), coded AS (
  SELECT _id, conversation, createdAt,
    CASE WHEN typed IN ({_in(USER_ROLES)}) THEN 'USER' WHEN typed IN ({_in(ASSISTANT_ROLES)}) THEN 'ASSISTANT' WHEN typed IN ({_in(SYSTEM_ROLES)}) THEN 'SYSTEM' END AS code,
    content IS NULL OR NOT regexp_matches(content, '[\p{{L}}\p{{N}}]') OR lower(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(8203))) IN ({_in(STAND_INS)}) AS blank
  FROM once
), turns AS (
  SELECT *, lag(code) OVER w AS before FROM coded WHERE code IN ('USER', 'ASSISTANT') WINDOW w AS (PARTITION BY conversation ORDER BY createdAt, _id)
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> code THEN 1 ELSE 0 END) OVER (PARTITION BY conversation ORDER BY createdAt, _id ROWS UNBOUNDED PRECEDING) AS run FROM turns
), runs AS (SELECT conversation, run, min(code) AS code, bool_or(NOT blank) AS says FROM numbered GROUP BY ALL),
near AS (SELECT *, lag(says) OVER w AS said_before, lead(says) OVER w AS says_after FROM runs WINDOW w AS (PARTITION BY conversation ORDER BY run)),
by_run AS (
  SELECT conversation, bool_or(says) AS says, bool_or(code = 'USER' AND NOT coalesce(says_after, false)) AS no_reply, bool_or(code = 'ASSISTANT' AND NOT coalesce(said_before, false)) AS no_question
  FROM near GROUP BY 1
), lost AS (SELECT DISTINCT conversation, true AS no_role FROM coded WHERE code IS NULL),
keys AS (
  SELECT c._id AS conversation, coalesce(says, false) AS says, coalesce(no_reply, false) AS no_reply, coalesce(no_question, false) AS no_question, coalesce(no_role, false) AS no_role
  FROM (SELECT DISTINCT _id FROM conversations) c LEFT JOIN by_run b ON b.conversation = c._id LEFT JOIN lost l ON l.conversation = c._id
), found AS (
  SELECT conversation, 'empty' AS defect FROM keys WHERE NOT says
  UNION ALL SELECT conversation, 'no_reply' FROM keys WHERE says AND no_reply
  UNION ALL SELECT conversation, 'no_question' FROM keys WHERE says AND no_question
  UNION ALL SELECT conversation, 'no_role' FROM keys WHERE says AND no_role
)
"""

QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations, "p3_report": p3_report}
ORACLES = {
    "p3_found": _DEFECTS + "SELECT conversation, defect FROM found",
    "p3_report": _DEFECTS + "SELECT defect, count(*) AS n_conversations FROM found GROUP BY 1",
}
