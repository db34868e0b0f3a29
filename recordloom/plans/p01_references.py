"""p1: references of medical records and messages that do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.references import orphan_references
from recordloom.sources.tables import table

#: Referring field and the table it points to.
RECORD_FIELDS = {"patient": "patients", "document": "clinical_documents", "extraction": "clinical_extractions"}
PARENTS = ("patients", "clinical_documents", "clinical_extractions", "conversations")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "medical_records")
    fields = F.explode(
        F.array(*(F.struct(F.lit(f).alias("field_name"), F.lit(space).alias("space"), F.col(f).alias("key")) for f, space in RECORD_FIELDS.items()))
    )
    from_records = records.select(F.lit("medical_records").alias("table_name"), F.col("_id").alias("row_id"), F.col("createdAt").alias("created"), fields.alias("x")).select(
        "table_name", "row_id", "created", "x.*"
    )
    from_messages = table(spark, folder, "messages").select(
        F.lit("messages").alias("table_name"), F.col("_id").alias("row_id"), F.col("createdAt").alias("created"), F.lit("conversation").alias("field_name"),
        F.lit("conversations").alias("space"), F.col("conversation").alias("key"),
    )
    parents = None
    for name in PARENTS:
        one = table(spark, folder, name).select(F.lit(name).alias("space"), F.col("_id").alias("key"), F.col("createdAt").alias("created"))
        parents = one if parents is None else parents.unionByName(one)
    deleted = table(spark, folder, "deletion_log").select(F.col("collectionName").alias("space"), F.col("refId").alias("key"))
    return orphan_references(from_records.unionByName(from_messages), parents, deleted)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "row_id", "field_name", "kind")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of such references and of their distinct keys by table, field, kind and month of the referring row."""
    month = F.date_format("created", "yyyy-MM")
    return _orphans(spark, folder).groupBy("table_name", "field_name", "kind", month.alias("month")).agg(
        F.count("*").alias("n_refs"), F.countDistinct("key").alias("n_keys")
    )


_REFS = """
WITH refs AS (
  SELECT 'medical_records' AS table_name, _id AS row_id, 'patient' AS field_name, 'patients' AS space, patient AS key, createdAt AS created FROM medical_records
  UNION ALL SELECT 'medical_records', _id, 'document', 'clinical_documents', document, createdAt FROM medical_records
  UNION ALL SELECT 'medical_records', _id, 'extraction', 'clinical_extractions', extraction, createdAt FROM medical_records
  UNION ALL SELECT 'messages', _id, 'conversation', 'conversations', conversation, createdAt FROM messages
), parents AS (
  SELECT 'patients' AS space, _id AS key, createdAt AS born FROM patients
  UNION ALL SELECT 'clinical_documents', _id, createdAt FROM clinical_documents
  UNION ALL SELECT 'clinical_extractions', _id, createdAt FROM clinical_extractions
  UNION ALL SELECT 'conversations', _id, createdAt FROM conversations
), gone AS (SELECT DISTINCT collectionName AS space, refId AS key FROM deletion_log),
judged AS (
  SELECT r.table_name, r.row_id, r.field_name, r.key, r.created,
    CASE WHEN p.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN p.key IS NULL THEN 'missing' WHEN r.created < p.born THEN 'late' END AS kind
  FROM refs r LEFT JOIN parents p ON p.space = r.space AND p.key = r.key LEFT JOIN gone g ON g.space = r.space AND g.key = r.key
  WHERE r.key IS NOT NULL
), orphans AS (SELECT DISTINCT table_name, row_id, field_name, kind, key, created FROM judged WHERE kind IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLES = {
    "p1_found": _REFS + "SELECT DISTINCT table_name, row_id, field_name, kind FROM orphans",
    "p1_report": _REFS
    + "SELECT table_name, field_name, kind, strftime(created, '%Y-%m') AS month, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM orphans GROUP BY ALL",
}
