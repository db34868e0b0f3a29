"""Versions, latest rows, merges and checks of rows that must not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.ordered import chunked, with_position, with_previous
from recordloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def versions(rows: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """Adds version_no, valid_from and valid_to: each row of a key holds until the next one begins; the last one has no end."""
    order = [at, row_id]
    numbered = with_position(with_previous(chunked(rows, key, order), key, order, F.col(row_id), "_before"), key, order, "version_no")
    ends = numbered.where("_before IS NOT NULL").select(F.col("_before").alias(row_id), F.col(at).alias("valid_to"))
    return numbered.join(ends, row_id, "left").withColumn("valid_from", F.col(at)).drop("_before", "_chunk")


@query(
    "SELECT _id, document, row_number() OVER w AS version_no, createdAt AS valid_from, lead(createdAt) OVER w AS valid_to FROM (SELECT DISTINCT _id, document, createdAt FROM medical_records WHERE document IS NOT NULL) WINDOW w AS (PARTITION BY document ORDER BY createdAt, _id)"
)
def record_versions(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "medical_records").where("document IS NOT NULL").select("_id", "document", "createdAt").distinct()
    return versions(r, "document", "createdAt", "_id").select("_id", "document", "version_no", "valid_from", "valid_to")


@query("SELECT document, max_by(_id, (createdAt, _id)) AS extraction, max(createdAt) AS updated FROM clinical_extractions WHERE document IS NOT NULL GROUP BY 1")
def draft_latest_wins(s, d):
    e = table(s, d, "clinical_extractions").where("document IS NOT NULL")
    return e.groupBy("document").agg(F.max_by("_id", F.struct("createdAt", "_id")).alias("extraction"), F.max("createdAt").alias("updated"))


@query(
    "SELECT document, min_by(status, (createdAt, _id)) AS first_status, max_by(status, (createdAt, _id)) AS last_status, count(*) AS n FROM (SELECT DISTINCT _id, document, createdAt, coalesce(status, '?') AS status FROM medical_records WHERE document IS NOT NULL) GROUP BY 1"
)
def upsert_set_on_insert(s, d):
    """What an upsert leaves: fields set on insert come from the first write, the others from the last."""
    r = table(s, d, "medical_records").where("document IS NOT NULL").select("_id", "document", "createdAt", F.coalesce("status", F.lit("?")).alias("status")).distinct()
    at = F.struct("createdAt", "_id")
    return r.groupBy("document").agg(F.min_by("status", at).alias("first_status"), F.max_by("status", at).alias("last_status"), F.count("*").alias("n"))


@query("SELECT _id, count(*) AS n_deliveries, count(DISTINCT sha256(coalesce(content, '') || '|' || coalesce(role, ''))) AS n_contents FROM messages GROUP BY 1 HAVING count(*) > 1")
def immutable_rows_check(s, d):
    """Rows delivered more than once, and how many different contents they came with."""
    h = F.sha2(F.concat(F.coalesce("content", F.lit("")), F.lit("|"), F.coalesce("role", F.lit(""))), 256)
    return table(s, d, "messages").groupBy("_id").agg(F.count("*").alias("n_deliveries"), F.countDistinct(h).alias("n_contents")).where("n_deliveries > 1")


@query(
    "SELECT before, status AS after, count(*) AS n FROM (SELECT coalesce(status, '?') AS status, lag(coalesce(status, '?')) OVER (PARTITION BY patient ORDER BY createdAt, _id) AS before FROM (SELECT DISTINCT _id, patient, createdAt, status FROM medical_records WHERE patient IS NOT NULL)) WHERE before IS NOT NULL GROUP BY 1, 2"
)
def status_sequences(s, d):
    """How often one state follows another in the records of a patient."""
    r = table(s, d, "medical_records").where("patient IS NOT NULL").select("_id", "patient", "createdAt", F.coalesce("status", F.lit("?")).alias("status")).distinct()
    order = ["createdAt", "_id"]
    seen = with_previous(chunked(r, "patient", order), "patient", order, F.col("status"), "before").where("before IS NOT NULL")
    return seen.groupBy("before", F.col("status").alias("after")).agg(F.count("*").alias("n"))


@query(
    "WITH gone AS (SELECT DISTINCT refId FROM deletion_log WHERE collectionName = 'clinical_extractions'), live AS (SELECT document, count(*) AS n FROM clinical_extractions WHERE document IS NOT NULL AND _id NOT IN (SELECT refId FROM gone) GROUP BY 1) SELECT d._id AS document, coalesce(n, 0) AS n_live FROM clinical_documents d LEFT JOIN live ON live.document = d._id"
)
def tombstone_filter(s, d):
    """Live extractions of each document, without those whose key the deletion log lists."""
    gone = table(s, d, "deletion_log").where("collectionName = 'clinical_extractions'").select(F.col("refId").alias("_id"))
    live = table(s, d, "clinical_extractions").where("document IS NOT NULL").join(gone, "_id", "left_anti").groupBy("document").agg(F.count("*").alias("n"))
    return table(s, d, "clinical_documents").select(F.col("_id").alias("document")).join(live, "document", "left").select("document", F.coalesce("n", F.lit(0)).alias("n_live"))


@query(
    """
WITH p AS (SELECT _id, regexp_replace(lower(fullName), '[^a-z0-9]', '', 'g') AS name, regexp_replace(lower(mrn), '[^a-z0-9]', '', 'g') AS mrn, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone, dateOfBirth AS born FROM patients),
pairs AS (
  SELECT a._id AS a, b._id AS b, CASE WHEN a.mrn = b.mrn THEN 100 ELSE 0 END + CASE WHEN a.phone = b.phone AND length(a.phone) = 10 THEN 80 ELSE 0 END + CASE WHEN a.born = b.born THEN 65 ELSE 0 END + CASE WHEN a.name = b.name THEN 50 WHEN contains(a.name, b.name) OR contains(b.name, a.name) THEN 15 ELSE 0 END AS score, a.name = b.name AS same_name
  FROM p a JOIN p b ON a._id % 20 = 0 AND a._id <> b._id AND (a.mrn = b.mrn OR (a.phone = b.phone AND length(a.phone) = 10) OR a.born = b.born) WHERE a.name <> '' AND b.name <> ''
) SELECT a, b, place, score, CASE WHEN same_name THEN 'HIGH' ELSE 'MEDIUM' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM pairs WHERE score >= 60) WHERE place <= 10
"""
)
def match_candidates_scored(s, d):
    """The ten best matches of the patients whose id is divisible by 20; only rows that share an identity are compared.

    A shared record number, phone or birth date is of HIGH confidence with an equal name and of MEDIUM confidence without."""
    p = table(s, d, "patients")
    low = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    phone = F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10))
    base = p.select("_id", low("fullName").alias("name"), low("mrn").alias("mrn"), F.when(F.length(phone) == 10, phone).alias("phone"), F.col("dateOfBirth").alias("born")).where("name <> ''")
    keys = F.array(F.concat(F.lit("m"), "mrn"), F.concat(F.lit("p"), "phone"), F.concat(F.lit("b"), F.col("born").cast("string")))
    keyed = base.select("_id", F.explode(keys).alias("key")).where("key IS NOT NULL")
    met = keyed.where("_id % 20 = 0").select(F.col("_id").alias("a"), "key").join(keyed.select(F.col("_id").alias("b"), "key"), "key").where("a <> b").select("a", "b").distinct()
    left = base.select(F.col("_id").alias("a"), F.struct("name", "mrn", "phone", "born").alias("x"))
    right = base.select(F.col("_id").alias("b"), F.struct("name", "mrn", "phone", "born").alias("y"))
    n = lambda cond, points: F.when(cond, points).otherwise(0)
    x, y = lambda f: F.col(f"x.{f}"), lambda f: F.col(f"y.{f}")
    names = F.when(x("name") == y("name"), 50).when(F.contains(x("name"), y("name")) | F.contains(y("name"), x("name")), 15).otherwise(0)
    scored = met.join(left, "a").join(right, "b").select("a", "b", (n(x("mrn") == y("mrn"), 100) + n(x("phone") == y("phone"), 80) + n(x("born") == y("born"), 65) + names).alias("score"), (x("name") == y("name")).alias("same_name")).where("score >= 60")
    from pyspark.sql import Window

    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")).cast("bigint")).where("place <= 10")
    return placed.select("a", "b", "place", F.col("score").cast("int").alias("score"), F.when(F.col("same_name"), "HIGH").otherwise("MEDIUM").alias("band"))
