"""Lookups, scoped search, item lists, display lines and comparisons of first and latest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import tokens
from recordloom.operators import search as S
from recordloom.plans import search as search_plans
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


@query("SELECT _id, fullName, clinic FROM patients WHERE mrn = (SELECT min(mrn) FROM patients WHERE mrn LIKE 'PT00%')")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """Rows with one key value."""
    p = table(s, d, "patients")
    key = p.where("mrn LIKE 'PT00%'").agg(F.min("mrn").alias("mrn"))  # one row
    return p.join(F.broadcast(key), "mrn").select("_id", "fullName", "clinic")


@query("SELECT clinic, bool_or(status = 'APPROVED') AS has_approved, bool_or(patient IS NULL) AS has_unassigned FROM clinical_documents GROUP BY 1")
def existence_probe(s, d):
    return table(s, d, "clinical_documents").groupBy("clinic").agg(F.bool_or(F.col("status") == "APPROVED").alias("has_approved"), F.bool_or(F.col("patient").isNull()).alias("has_unassigned"))


@query(
    """WITH m AS (SELECT DISTINCT item_id, extraction, confidence, name FROM medication_items), l AS (SELECT DISTINCT item_id, extraction, confidence, resultValue FROM investigation_items),
f AS (SELECT extraction, confidence < 0.8 OR name IS NULL OR name = '' AS open FROM m UNION ALL SELECT extraction, confidence < 0.8 OR resultValue IS NULL FROM l)
SELECT extraction, count(*) AS n_fields, sum(CASE WHEN open THEN 1 ELSE 0 END)::BIGINT AS n_open FROM f GROUP BY 1"""
)
def unresolved_exceptions(s, d):
    """Fields of an extraction that are uncertain or empty."""
    m = table(s, d, "medication_items").select("item_id", "extraction", "confidence", "name").distinct().select("extraction", ((F.col("confidence") < 0.8) | F.col("name").isNull() | (F.col("name") == "")).alias("open"))
    r = table(s, d, "investigation_items").select("item_id", "extraction", "confidence", "resultValue").distinct().select("extraction", ((F.col("confidence") < 0.8) | F.col("resultValue").isNull()).alias("open"))
    return m.unionByName(r).groupBy("extraction").agg(F.count("*").alias("n_fields"), F.sum(F.when(F.col("open"), 1).otherwise(0)).alias("n_open"))


@query(
    "SELECT 'DOCUMENT' AS kind, _id AS id FROM clinical_documents WHERE contains(lower(originalFilename), 'rx') AND createdAt >= TIMESTAMP '2023-01-01' AND createdAt < TIMESTAMP '2023-07-01' UNION ALL SELECT DISTINCT 'RECORD', _id FROM medical_records WHERE contains(lower(title), 'rx') AND createdAt >= TIMESTAMP '2023-01-01' AND createdAt < TIMESTAMP '2023-07-01'"
)
def timeline_filter(s, d):
    """Events whose text holds a word within a span of dates."""
    span = (F.col("createdAt") >= F.lit("2023-01-01").cast("timestamp_ntz")) & (F.col("createdAt") < F.lit("2023-07-01").cast("timestamp_ntz"))
    docs = table(s, d, "clinical_documents").where(span & F.contains(F.lower("originalFilename"), F.lit("rx"))).select(F.lit("DOCUMENT").alias("kind"), F.col("_id").alias("id"))
    recs = table(s, d, "medical_records").where(span & F.contains(F.lower("title"), F.lit("rx"))).select(F.lit("RECORD").alias("kind"), F.col("_id").alias("id")).distinct()
    return docs.unionByName(recs)


@query(
    search_plans._FIELDS
    + ", scope AS (SELECT 'patient_' || _id AS id FROM patients WHERE clinic = 'Greywater Clinic' UNION ALL SELECT 'doc_' || _id FROM clinical_documents WHERE patient IN (SELECT _id FROM patients WHERE clinic = 'Greywater Clinic')) SELECT query_id, place, id, score FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM found f WHERE id IN (SELECT id FROM scope)) WHERE place <= 15"
)
def search_scoped(s, d):
    """Search within a scope: entities out of scope go before the ranking, so that the page is full."""
    p = table(s, d, "patients").where("clinic = 'Greywater Clinic'").select(F.col("_id").alias("patient"))
    docs = table(s, d, "clinical_documents").join(p, "patient", "left_semi").select(F.concat(F.lit("doc_"), F.col("_id").cast("string")).alias("id"))
    scope = p.select(F.concat(F.lit("patient_"), F.col("patient").cast("string")).alias("id")).unionByName(docs)
    found = S.lookup(search_plans._asked(s, d), S.postings(search_plans._fields(s, d)).join(scope, "id", "left_semi"))
    return S.top_results(found).select("query_id", "place", "id", "score")


@query(
    "SELECT DISTINCT item_id, concat_ws(' · ', nullif(name || ' — ' || coalesce(dosage, ''), ''), frequency, route, duration) AS line FROM medication_items WHERE name IS NOT NULL UNION ALL SELECT DISTINCT item_id, concat_ws(' ', testName || ' —', resultValue, units, '[' || upper(coalesce(status, 'unknown')) || ']') FROM investigation_items WHERE testName IS NOT NULL"
)
def display_lines(s, d):
    """Items as the lines that a page shows."""
    m = table(s, d, "medication_items").where("name IS NOT NULL")
    r = table(s, d, "investigation_items").where("testName IS NOT NULL")
    med = F.concat_ws(" · ", F.concat("name", F.lit(" — "), F.coalesce("dosage", F.lit(""))), "frequency", "route", "duration")
    lab = F.concat_ws(" ", F.concat("testName", F.lit(" —")), "resultValue", "units", F.concat(F.lit("["), F.upper(F.coalesce("status", F.lit("unknown"))), F.lit("]")))
    return m.select("item_id", med.alias("line")).distinct().unionByName(r.select("item_id", lab.alias("line")).distinct())


@query(
    "WITH v AS (SELECT patient, count(*) AS n, count(DISTINCT document) AS docs FROM clinical_extractions WHERE patient IS NOT NULL GROUP BY 1) SELECT p._id, coalesce(p.fullName, 'Unnamed') || ' has ' || coalesce(n, 0) || CASE WHEN coalesce(n, 0) = 1 THEN ' visit' ELSE ' visits' END || ' from ' || coalesce(docs, 0) || CASE WHEN coalesce(docs, 0) = 1 THEN ' document.' ELSE ' documents.' END AS sentence FROM patients p LEFT JOIN v ON v.patient = p._id"
)
def at_a_glance(s, d):
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").groupBy(F.col("patient").alias("_id")).agg(F.count("*").alias("n"), F.countDistinct("document").alias("docs"))
    n, docs = F.coalesce("n", F.lit(0)), F.coalesce("docs", F.lit(0))
    text = F.concat(
        F.coalesce("fullName", F.lit("Unnamed")), F.lit(" has "), n.cast("string"), F.when(n == 1, " visit").otherwise(" visits"), F.lit(" from "), docs.cast("string"), F.when(docs == 1, " document.").otherwise(" documents."),
    )
    return table(s, d, "patients").select("_id", "fullName").join(v, "_id", "left").select("_id", text.alias("sentence"))


@query(
    "WITH r AS (SELECT DISTINCT _id, patient, createdAt, coalesce(extractedData.diagnosis, '') AS diagnosis, coalesce(recordType, '') AS recordType FROM medical_records WHERE patient IS NOT NULL), e AS (SELECT patient, min_by(diagnosis, (createdAt, _id)) AS d1, max_by(diagnosis, (createdAt, _id)) AS d2, min_by(recordType, (createdAt, _id)) AS t1, max_by(recordType, (createdAt, _id)) AS t2 FROM r GROUP BY 1) SELECT patient, d1 AS first_diagnosis, d2 AS last_diagnosis, d1 <> d2 AS diagnosis_changed, t1 <> t2 AS type_changed FROM e"
)
def first_and_current_compare(s, d):
    """The first record of a patient against the latest."""
    r = table(s, d, "medical_records").where("patient IS NOT NULL").select("_id", "patient", "createdAt", F.coalesce("extractedData.diagnosis", F.lit("")).alias("diagnosis"), F.coalesce("recordType", F.lit("")).alias("recordType")).distinct()
    at = F.struct("createdAt", "_id")
    e = r.groupBy("patient").agg(F.min_by("diagnosis", at).alias("d1"), F.max_by("diagnosis", at).alias("d2"), F.min_by("recordType", at).alias("t1"), F.max_by("recordType", at).alias("t2"))
    return e.select("patient", F.col("d1").alias("first_diagnosis"), F.col("d2").alias("last_diagnosis"), (F.col("d1") != F.col("d2")).alias("diagnosis_changed"), (F.col("t1") != F.col("t2")).alias("type_changed"))


@query(
    "SELECT extraction, name, genericName, n FROM (SELECT extraction, name, genericName, count(*) OVER (PARTITION BY extraction) AS n, row_number() OVER (PARTITION BY extraction ORDER BY position_no, item_id) AS k FROM (SELECT DISTINCT extraction, item_id, position_no, name, genericName FROM medication_items)) WHERE k = 1"
)
def first_item_and_count(s, d):
    """The first item of each extraction and how many it has, as a nested list would show them."""
    i = table(s, d, "medication_items").select("extraction", "item_id", "position_no", "name", "genericName").distinct()
    first = i.groupBy("extraction").agg(F.min_by(F.struct("name", "genericName"), F.struct("position_no", "item_id")).alias("x"), F.count("*").alias("n"))
    return first.select("extraction", "x.name", "x.genericName", "n")


@query(
    r"WITH t AS (SELECT unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'was', 'were', 'that', 'this', 'are', 'has', 'have')))) AS token FROM documents) SELECT token, count(*) AS n_docs FROM t GROUP BY 1"
)
def document_frequencies(s, d):
    return table(s, d, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))
