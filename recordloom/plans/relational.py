"""Filters, joins, aggregates, orders and set operations over the record tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators.ordered import chunked, with_latest
from recordloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The moment from which recent rows are counted; a parameter, so that results do not depend on the clock.
AS_OF = "2024-06-15 12:00:00"
# States of an approved document.
APPROVED = ("APPROVED", "CLINICIAN_VERIFIED", "AMENDED", "DOCTOR_VERIFIED")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def big(x: Column) -> Column:
    return x.cast("bigint")


# ---------------------------------------------------------------- filters and projections


@query("SELECT _id, documentType, status FROM clinical_documents WHERE status IN ('APPROVED', 'CLINICIAN_VERIFIED', 'AMENDED', 'DOCTOR_VERIFIED')")
def filter_status_in(s: SparkSession, d: str) -> DataFrame:
    """Documents in a group of states; the list reaches the Parquet scan."""
    return table(s, d, "clinical_documents").where(F.col("status").isin(*APPROVED)).select("_id", "documentType", "status")


def with_choices(df: DataFrame, **choices: str) -> DataFrame:
    """Keep rows that equal every choice; the choice 'ALL' filters nothing."""
    for column, choice in choices.items():
        if choice != "ALL":
            df = df.where(F.col(column) == choice)
    return df


@query("SELECT _id, clinic FROM clinical_documents WHERE documentType = 'PRESCRIPTION'")
def filter_choices_with_all(s, d):
    return with_choices(table(s, d, "clinical_documents"), documentType="PRESCRIPTION", status="ALL").select("_id", "clinic")


@query("SELECT _id, fullName FROM patients WHERE contains(lower(fullName), 'mer') OR contains(lower(mrn), '77') AND contains(lower(chronicConditions), 'gastritis')")
def substring_search_multi(s, d):
    """Case-blind substrings over several columns, or-ed and and-ed; never a pattern."""
    has = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return table(s, d, "patients").where(has("fullName", "mer") | has("mrn", "77") & has("chronicConditions", "gastritis")).select("_id", "fullName")


@query("SELECT DISTINCT _id, status FROM medical_records WHERE doctorVerified IS DISTINCT FROM false AND status IS DISTINCT FROM 'REJECTED'")
def filter_null_safe_not_false(s, d):
    """'Not false' keeps rows without a value."""
    r = table(s, d, "medical_records")
    return r.where(~F.col("doctorVerified").eqNullSafe(False) & ~F.col("status").eqNullSafe("REJECTED")).select("_id", "status").distinct()


@query(f"SELECT _id, createdAt FROM clinical_documents WHERE createdAt >= date_trunc('day', TIMESTAMP '{AS_OF}')")
def filter_since_start_of_day(s, d):
    start = AS_OF[:10] + " 00:00:00"
    return table(s, d, "clinical_documents").where(F.col("createdAt") >= F.lit(start).cast("timestamp_ntz")).select("_id", "createdAt")


@query("SELECT DISTINCT _id, version, extractedData.diagnosis AS diagnosis FROM medical_records WHERE version > 1 AND extractedData.diagnosis IS NOT NULL")
def filter_nested_and_counter(s, d):
    r = table(s, d, "medical_records")
    return r.where("version > 1 AND extractedData.diagnosis IS NOT NULL").select("_id", "version", F.col("extractedData.diagnosis").alias("diagnosis")).distinct()


@query("SELECT _id, allergies FROM patients WHERE allergies IS NOT NULL AND lower(trim(allergies)) NOT IN ('', 'none', 'none documented', 'no known allergies', 'no allergies', 'nil', 'n/a', '-', '--')")
def filter_documented_allergy(s, d):
    said = F.lower(F.trim("allergies"))
    # Spellings of no allergy.
    nothing = ("", "none", "none documented", "no known allergies", "no allergies", "nil", "n/a", "-", "--")
    return table(s, d, "patients").where(F.col("allergies").isNotNull() & ~said.isin(*nothing)).select("_id", "allergies")


@query(
    "SELECT item_id, CASE WHEN t <> '' AND lower(t) NOT IN (" + listed(X.PLACEHOLDERS) + ") THEN t END AS result FROM (SELECT DISTINCT item_id, regexp_replace(resultValue, '^\\s+|\\s+$', '', 'g') AS t FROM investigation_items)"
)
def placeholder_null(s, d):
    return table(s, d, "investigation_items").select("item_id", X.without_placeholder(F.col("resultValue")).alias("result"), X.trimmed(F.col("resultValue")).alias("t")).distinct().drop("t")


@query("SELECT DISTINCT item_id, confidence FROM medication_items WHERE isVerified IS NOT TRUE OR confidence < 0.85 OR confidenceTier = 'NEEDS_VERIFICATION'")
def filter_needs_review(s, d):
    i = table(s, d, "medication_items")
    return i.where(~F.coalesce("isVerified", F.lit(False)) | (F.col("confidence") < 0.85) | (F.col("confidenceTier") == "NEEDS_VERIFICATION")).select("item_id", "confidence").distinct()


@query("SELECT extraction, sum(CASE WHEN status IN ('HIGH', 'LOW', 'CRITICAL') THEN 1 ELSE 0 END)::BIGINT AS n_abnormal, count(*) AS n_results FROM (SELECT DISTINCT item_id, extraction, status FROM investigation_items) GROUP BY 1")
def abnormal_results(s, d):
    i = table(s, d, "investigation_items").select("item_id", "extraction", "status").distinct()
    return i.groupBy("extraction").agg(F.sum(F.col("status").isin("HIGH", "LOW", "CRITICAL").cast("bigint")).alias("n_abnormal"), F.count("*").alias("n_results")).withColumn("n_abnormal", F.coalesce("n_abnormal", F.lit(0)))



@query(
    "SELECT _id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) AS last4, strftime(dateOfBirth, '%Y-%m-%d') AS born FROM patients WHERE clinic = 'Pinegate Hospital' AND (dateOfBirth = DATE '1981-01-03' OR right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) LIKE '3%')"
)
def identity_check(s, d):
    """Rows of a clinic that agree in the birth date or in the last four digits of the phone."""
    last4 = F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(4))
    p = table(s, d, "patients").where("clinic = 'Pinegate Hospital'")
    return p.where((F.col("dateOfBirth") == F.lit("1981-01-03").cast("date")) | last4.startswith("3")).select("_id", last4.alias("last4"), F.date_format("dateOfBirth", "yyyy-MM-dd").alias("born"))


# ---------------------------------------------------------------- joins


@query("SELECT d._id, d.documentType FROM clinical_documents d WHERE d.patient IN (SELECT _id FROM patients WHERE clinic = 'Greywater Clinic' OR ownerDoctor = 112)")
def access_scope_semi_join(s, d):
    scope = table(s, d, "patients").where("clinic = 'Greywater Clinic' OR ownerDoctor = 112").select(F.col("_id").alias("patient"))
    return table(s, d, "clinical_documents").join(scope, "patient", "left_semi").select("_id", "documentType")


@query(
    "SELECT _id, patient FROM clinical_documents WHERE patient IN (SELECT _id FROM patients WHERE clinic = 'Greywater Clinic') UNION ALL SELECT _id, patient FROM clinical_documents WHERE patient IS NULL AND clinic = 'Greywater Clinic'"
)
def access_scope_docs_with_unassigned(s, d):
    docs = table(s, d, "clinical_documents")
    scope = table(s, d, "patients").where("clinic = 'Greywater Clinic'").select(F.col("_id").alias("patient"))
    assigned = docs.join(scope, "patient", "left_semi").select("_id", "patient")
    return assigned.unionByName(docs.where("patient IS NULL AND clinic = 'Greywater Clinic'").select("_id", "patient"))


@query("SELECT d._id, d.documentType, p.fullName, p.mrn FROM clinical_documents d LEFT JOIN patients p ON p._id = d.patient")
def populate_left_join(s, d):
    p = table(s, d, "patients").select(F.col("_id").alias("patient"), "fullName", "mrn")
    return table(s, d, "clinical_documents").join(p, "patient", "left").select("_id", "documentType", "fullName", "mrn")


@query(
    "SELECT DISTINCT r._id, r.status, d.documentType, e.aiProvider, e.overallConfidence, p.fullName FROM medical_records r LEFT JOIN clinical_documents d ON d._id = r.document LEFT JOIN clinical_extractions e ON e._id = r.extraction LEFT JOIN patients p ON p._id = r.patient"
)
def populate_many_hops(s, d):
    r = table(s, d, "medical_records").select("_id", "status", "document", "extraction", "patient").distinct()
    docs = table(s, d, "clinical_documents").select(F.col("_id").alias("document"), "documentType")
    ext = table(s, d, "clinical_extractions").select(F.col("_id").alias("extraction"), "aiProvider", "overallConfidence")
    p = table(s, d, "patients").select(F.col("_id").alias("patient"), "fullName")
    return r.join(docs, "document", "left").join(ext, "extraction", "left").join(p, "patient", "left").select("_id", "status", "documentType", "aiProvider", "overallConfidence", "fullName")


@query(
    "WITH r AS (SELECT patient, _id, originalFilename, row_number() OVER (PARTITION BY patient ORDER BY createdAt DESC, _id DESC) AS k FROM clinical_documents WHERE patient IS NOT NULL) SELECT patient, string_agg(originalFilename, '|' ORDER BY k) AS files FROM r WHERE k <= 5 GROUP BY patient"
)
def array_ref_populate(s, d):
    """The five newest references of each patient resolved and nested again in their order."""
    docs = table(s, d, "clinical_documents").where("patient IS NOT NULL")
    w = Window.partitionBy("patient").orderBy(F.desc("createdAt"), F.desc("_id"))
    refs = docs.select("patient", "_id", F.row_number().over(w).alias("k")).where("k <= 5")
    nested = refs.groupBy("patient").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_id"))), lambda x: x["_id"]).alias("refs"))
    names = docs.select("_id", "originalFilename")
    out = nested.select("patient", F.posexplode("refs").alias("k", "_id")).join(names, "_id", "left")
    return out.groupBy("patient").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "originalFilename"))), lambda x: x["originalFilename"]), "|").alias("files"))


@query(
    "WITH dc AS (SELECT patient, count(*) AS n_docs, sum(CASE WHEN status = 'NEEDS_VERIFICATION' THEN 1 ELSE 0 END)::BIGINT AS n_alerts FROM clinical_documents WHERE patient IS NOT NULL GROUP BY 1) SELECT p._id, coalesce(n_docs, 0) AS n_docs, coalesce(n_alerts, 0) AS n_alerts FROM patients p LEFT JOIN dc ON dc.patient = p._id"
)
def patients_doc_alert_counts(s, d):
    docs = table(s, d, "clinical_documents").where("patient IS NOT NULL").groupBy(F.col("patient").alias("_id"))
    counts = docs.agg(F.count("*").alias("n_docs"), F.sum(F.when(F.col("status") == "NEEDS_VERIFICATION", 1).otherwise(0)).alias("n_alerts"))
    return table(s, d, "patients").select("_id").join(counts, "_id", "left").select("_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))


@query("SELECT d._id FROM clinical_documents d WHERE d.status = 'APPROVED' AND d._id NOT IN (SELECT document FROM medical_records WHERE document IS NOT NULL)")
def missing_record_anti_join(s, d):
    have = table(s, d, "medical_records").select(F.col("document").alias("_id"))
    return table(s, d, "clinical_documents").where("status = 'APPROVED'").join(have, "_id", "left_anti").select("_id")


@query("SELECT DISTINCT l.collectionName, l.refId FROM deletion_log l WHERE l.collectionName = 'clinical_extractions' AND NOT EXISTS (SELECT 1 FROM clinical_extractions e WHERE e._id = l.refId)")
def stale_key_anti_join(s, d):
    live = table(s, d, "clinical_extractions").select(F.col("_id").alias("refId"))
    return table(s, d, "deletion_log").where("collectionName = 'clinical_extractions'").join(live, "refId", "left_anti").select("collectionName", "refId").distinct()


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, right_id: str, right_value: str) -> DataFrame:
    """Rows of ``left`` (key, at, id) with the latest row of ``right`` of the same key at or before them; unmatched rows are left out.

    Both sides are merged in the order of time within the key, in chunks, so that a hot key is spread over tasks.
    """
    a = left.select(key, at, F.lit(1).alias("side"), F.col("id").alias("row"), F.lit(None).cast("timestamp_ntz").alias("value"))
    b = right.select(key, at, F.lit(0).alias("side"), F.col(right_id).alias("row"), F.col(right_value).alias("value"))
    order = [at, "side", "row"]
    both = chunked(a.unionByName(b).where(F.col(at).isNotNull()), key, order)
    hit = with_latest(both, key, order, F.when(F.col("side") == 0, F.struct(F.col("row").alias("id"), F.col("value").alias("value"))), "hit")
    return hit.where("side = 1 AND hit IS NOT NULL").select(key, F.col("row").alias("id"), at, F.col("hit.id").alias("matched"), F.col("hit.value").alias("matched_at"))


_ASOF = """
WITH r AS (SELECT DISTINCT _id, document, createdAt FROM medical_records WHERE document IS NOT NULL),
m AS (SELECT r._id, r.document, r.createdAt, e._id AS matched, e.createdAt AS matched_at FROM r ASOF JOIN (SELECT document, createdAt, max(_id) AS _id FROM clinical_extractions GROUP BY 1, 2) e ON e.document = r.document AND e.createdAt <= r.createdAt)
"""


def _asof(s, d):
    r = table(s, d, "medical_records").select(F.col("_id").alias("id"), "document", "createdAt").distinct()
    return asof_backward(r, table(s, d, "clinical_extractions"), "document", "createdAt", "_id", "createdAt")


@query(_ASOF + "SELECT _id AS record, document, matched AS extraction, (epoch_us(createdAt) - epoch_us(matched_at)) AS wait_us FROM m")
def asof_rows(s, d):
    """Each record with the latest extraction of its document before it."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _asof(s, d).select(F.col("id").alias("record"), "document", F.col("matched").alias("extraction"), (us("createdAt") - us("matched_at")).alias("wait_us"))


@query(_ASOF + "SELECT count(*) AS n, round(avg((epoch_us(createdAt) - epoch_us(matched_at)) / 6e7), 2) AS mean_minutes FROM m")
def asof_mean_latency(s, d):
    return asof_rows(s, d).agg(F.count("*").alias("n"), F.round(F.avg(F.col("wait_us") / 6e7), 2).alias("mean_minutes"))


@query(
    "WITH v AS (SELECT patient, max(coalesce(verifiedAt, createdAt)) AS at FROM medical_records WHERE patient IS NOT NULL GROUP BY 1 UNION ALL SELECT patient, max(createdAt) FROM clinical_documents WHERE patient IS NOT NULL GROUP BY 1) SELECT p._id, max(v.at) AS last_visit FROM patients p LEFT JOIN v ON v.patient = p._id GROUP BY 1"
)
def last_visit_two_sources(s, d):
    r = table(s, d, "medical_records").select("patient", F.coalesce("verifiedAt", "createdAt").alias("at"))
    docs = table(s, d, "clinical_documents").select("patient", F.col("createdAt").alias("at"))
    last = r.unionByName(docs).where("patient IS NOT NULL").groupBy(F.col("patient").alias("_id")).agg(F.max("at").alias("last_visit"))
    return table(s, d, "patients").select("_id").join(last, "_id", "left")


# ---------------------------------------------------------------- aggregates


@query("SELECT conversation, count(*) AS n_messages FROM messages WHERE conversation IS NOT NULL GROUP BY 1")
def message_counts(s, d):
    return table(s, d, "messages").where("conversation IS NOT NULL").groupBy("conversation").agg(F.count("*").alias("n_messages"))


@query(
    f"""SELECT count(*) AS n_docs, count(*) FILTER (WHERE status = 'APPROVED') AS n_approved, count(*) FILTER (WHERE patient IS NULL) AS n_unassigned,
    count(*) FILTER (WHERE createdAt >= TIMESTAMP '{AS_OF}') AS n_recent, count(DISTINCT patient) AS n_patients, count(*) FILTER (WHERE status IS NULL) AS n_no_status FROM clinical_documents"""
)
def kpi_one_pass(s, d):
    """All counts in one scan."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    c = F.col
    return table(s, d, "clinical_documents").agg(
        F.count("*").alias("n_docs"), n(c("status") == "APPROVED", "n_approved"), n(c("patient").isNull(), "n_unassigned"), n(c("createdAt") >= F.lit(AS_OF).cast("timestamp_ntz"), "n_recent"),
        F.countDistinct("patient").alias("n_patients"), n(c("status").isNull(), "n_no_status"),
    )


@query("SELECT DISTINCT clinic, documentType FROM clinical_documents")
def distinct_keys(s, d):
    return table(s, d, "clinical_documents").select("clinic", "documentType").distinct()


@query("SELECT name, count(*) AS n FROM (SELECT DISTINCT item_id, name FROM medication_items) WHERE name IS NOT NULL AND name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_values(s, d):
    return table(s, d, "medication_items").select("item_id", "name").distinct().where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)


@query(
    "SELECT condition, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(chronicConditions, '[;,]'))) AS condition FROM patients WHERE chronicConditions IS NOT NULL) WHERE condition <> '' GROUP BY 1"
)
def top_split_values(s, d):
    parts = table(s, d, "patients").select(F.explode(F.split("chronicConditions", "[;,]")).alias("c")).select(F.trim("c").alias("condition")).where("condition <> ''")
    return parts.groupBy("condition").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 2) AS mean_value FROM events GROUP BY 1")
def action_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 2).alias("mean_value"))


@query("SELECT round(count(DISTINCT CASE WHEN doctorVerified THEN document END) * 100.0::DOUBLE / nullif((SELECT count(*) FROM clinical_documents), 0), 2) AS reviewed_percent FROM medical_records")
def review_rate(s, d):
    done = table(s, d, "medical_records").agg(F.countDistinct(F.when(F.col("doctorVerified"), F.col("document"))).alias("n"))
    total = table(s, d, "clinical_documents").agg(F.count("*").alias("all"))  # one row each
    return done.join(F.broadcast(total)).select(F.round(F.col("n") * 100.0 / F.nullif("all", F.lit(0)), 2).alias("reviewed_percent"))


@query(
    "SELECT recordType, count(*) AS n, round(avg(m), 2) AS mean_minutes FROM (SELECT DISTINCT _id, recordType, (epoch_us(verifiedAt) - epoch_us(createdAt)) / 6e7 AS m FROM medical_records) WHERE m >= 0 GROUP BY 1"
)
def processing_minutes(s, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = table(s, d, "medical_records").select("_id", "recordType", ((us("verifiedAt") - us("createdAt")) / 6e7).alias("m")).distinct()
    return r.where("m >= 0").groupBy("recordType").agg(F.count("*").alias("n"), F.round(F.avg("m"), 2).alias("mean_minutes"))


@query("SELECT coalesce(documentType, 'ALL') AS facet, count(*) AS n FROM clinical_documents WHERE documentType IS NOT NULL GROUP BY GROUPING SETS ((documentType), ())")
def facet_counts(s, d):
    docs = table(s, d, "clinical_documents").where("documentType IS NOT NULL")
    return docs.rollup("documentType").agg(F.count("*").alias("n")).select(F.coalesce("documentType", F.lit("ALL")).alias("facet"), "n")


@query("SELECT extraction, lower(trim(name)) AS key, min_by(name, position_no) AS name, min(position_no) AS first_place FROM medication_items WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY 1, 2")
def ordered_unique(s, d):
    """Case-blind distinct values in their order; the first spelling stays."""
    i = table(s, d, "medication_items").where("name IS NOT NULL AND trim(name) <> ''").withColumn("key", F.lower(F.trim("name")))
    return i.groupBy("extraction", "key").agg(F.min_by("name", "position_no").alias("name"), F.min("position_no").alias("first_place"))


@query("SELECT _id, sha256(coalesce(status, '') || ':' || coalesce(title, '')) AS hash FROM (SELECT DISTINCT _id, status, title FROM medical_records)")
def content_hash(s, d):
    return table(s, d, "medical_records").select("_id", "status", "title").distinct().select("_id", F.sha2(F.concat(F.coalesce("status", F.lit("")), F.lit(":"), F.coalesce("title", F.lit(""))), 256).alias("hash"))


@query("SELECT patient, count(*) AS n, sum(('0x' || substr(md5(_id::VARCHAR || ':' || coalesce(status, '')), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM clinical_documents WHERE patient IS NOT NULL GROUP BY 1")
def source_fingerprint(s, d):
    """A fingerprint of each patient's sources that does not depend on their order, as a sum that combines before the shuffle."""
    part = F.conv(F.substring(F.md5(F.concat(F.col("_id").cast("string"), F.lit(":"), F.coalesce("status", F.lit("")))), 1, 8), 16, 10).cast("bigint")
    return table(s, d, "clinical_documents").where("patient IS NOT NULL").groupBy("patient").agg(F.count("*").alias("n"), F.sum(part).alias("fingerprint"))


# ---------------------------------------------------------------- order and limits


@query("SELECT _id, createdAt FROM clinical_documents ORDER BY createdAt DESC, _id LIMIT 50")
def topn_sort_limit(s, d):
    return table(s, d, "clinical_documents").orderBy(F.desc("createdAt"), "_id").select("_id", "createdAt").limit(50)


@query("SELECT patient, _id, k FROM (SELECT patient, _id, row_number() OVER (PARTITION BY patient ORDER BY createdAt DESC, _id) AS k FROM clinical_documents WHERE patient IS NOT NULL) WHERE k <= 3")
def top3_per_patient(s, d):
    """Three newest of each key; Spark limits each group before the shuffle."""
    w = Window.partitionBy("patient").orderBy(F.desc("createdAt"), "_id")
    return table(s, d, "clinical_documents").where("patient IS NOT NULL").select("patient", "_id", big(F.row_number().over(w)).alias("k")).where("k <= 3")


@query("SELECT patient, max_by(_id, (createdAt, _id)) AS newest, max(createdAt) AS at FROM clinical_documents WHERE patient IS NOT NULL GROUP BY 1")
def latest_per_patient(s, d):
    return table(s, d, "clinical_documents").where("patient IS NOT NULL").groupBy("patient").agg(F.max_by("_id", F.struct("createdAt", "_id")).alias("newest"), F.max("createdAt").alias("at"))


@query(
    "SELECT kind, id, happened FROM (SELECT 'DOCUMENT' AS kind, _id AS id, createdAt AS happened FROM clinical_documents UNION ALL SELECT 'RECORD', _id, createdAt FROM (SELECT DISTINCT _id, createdAt FROM medical_records) UNION ALL SELECT 'LAB', item_id, testDate FROM (SELECT DISTINCT item_id, testDate FROM investigation_items WHERE testDate IS NOT NULL)) ORDER BY happened DESC, kind, id LIMIT 60"
)
def union_timeline(s, d):
    docs = table(s, d, "clinical_documents").select(F.lit("DOCUMENT").alias("kind"), F.col("_id").alias("id"), F.col("createdAt").alias("happened"))
    recs = table(s, d, "medical_records").select(F.lit("RECORD").alias("kind"), F.col("_id").alias("id"), F.col("createdAt").alias("happened")).distinct()
    labs = table(s, d, "investigation_items").where("testDate IS NOT NULL").select(F.lit("LAB").alias("kind"), F.col("item_id").alias("id"), F.col("testDate").alias("happened")).distinct()
    return docs.unionByName(recs).unionByName(labs).orderBy(F.desc("happened"), "kind", "id").limit(60)


# ---------------------------------------------------------------- set operations


@query("SELECT patient FROM clinical_documents WHERE patient IS NOT NULL EXCEPT SELECT patient FROM medical_records")
def keys_except(s, d):
    return table(s, d, "clinical_documents").where("patient IS NOT NULL").select("patient").subtract(table(s, d, "medical_records").select("patient"))


@query("SELECT patient FROM clinical_documents WHERE patient IS NOT NULL INTERSECT SELECT patient FROM medical_records")
def keys_intersect(s, d):
    return table(s, d, "clinical_documents").where("patient IS NOT NULL").select("patient").intersect(table(s, d, "medical_records").select("patient"))


@query(
    "WITH n AS (SELECT extraction, list(DISTINCT lower(name)) FILTER (WHERE name IS NOT NULL) AS a, list(DISTINCT lower(genericName)) FILTER (WHERE genericName IS NOT NULL) AS b FROM medication_items GROUP BY 1) SELECT extraction, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS n_both, len(list_distinct(coalesce(a, []) || coalesce(b, []))) AS n_any FROM n"
)
def array_set_operations(s, d):
    """Names and generic names of each extraction as sets; an extraction holds few items."""
    i = table(s, d, "medication_items").groupBy("extraction").agg(F.collect_set(F.lower("name")).alias("a"), F.collect_set(F.lower("genericName")).alias("b"))
    return i.select("extraction", big(F.size(F.array_intersect("a", "b"))).alias("n_both"), big(F.size(F.array_union("a", "b"))).alias("n_any"))
