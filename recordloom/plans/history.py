"""Longitudinal history of all patients at once: visits, their items, and what changed between them.

A visit is an extraction with a patient; its items are the medicines named in it. Comparisons run on visit ids, so a patient with
very many visits is spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.text import compact
from recordloom.operators.ordered import chunked, with_position, with_previous
from recordloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["at", "visit"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _visits(s: SparkSession, d: str) -> DataFrame:
    """(patient, visit, at, visit_no, before): before is the visit before of the same patient."""
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("patient", F.col("_id").alias("visit"), F.col("createdAt").alias("at"))
    c = chunked(v, "patient", ORDER)
    return with_position(with_previous(c, "patient", ORDER, F.col("visit"), "before"), "patient", ORDER, "visit_no").select("patient", "visit", "at", "visit_no", "before")


def _items(s: SparkSession, d: str) -> DataFrame:
    """(visit, key, name, details): one row for each medicine of a visit; of repeated keys the first place counts."""
    i = table(s, d, "medication_items").where("name IS NOT NULL AND name <> ''").withColumn("key", compact(F.col("name")))
    details = F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("name", "dosage", "frequency", "route", "duration")))
    return i.groupBy(F.col("extraction").alias("visit"), "key").agg(F.min_by("name", F.struct("position_no", "item_id")).alias("name"), F.min_by(details, F.struct("position_no", "item_id")).alias("details"))


_BASE = """
WITH visits AS (SELECT patient, _id AS visit, createdAt AS happened, row_number() OVER w AS visit_no, lag(_id) OVER w AS before FROM clinical_extractions WHERE patient IS NOT NULL WINDOW w AS (PARTITION BY patient ORDER BY createdAt, _id)),
latest AS (SELECT patient, max(visit_no) AS last_no FROM visits GROUP BY 1),
raw AS (SELECT extraction AS visit, item_id, position_no, name, CASE WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> '' THEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') ELSE lower(trim(name)) END AS key,
  concat_ws('|', lower(trim(coalesce(name, ''))), lower(trim(coalesce(dosage, ''))), lower(trim(coalesce(frequency, ''))), lower(trim(coalesce(route, ''))), lower(trim(coalesce(duration, '')))) AS details FROM medication_items WHERE name IS NOT NULL AND name <> ''),
items AS (SELECT visit, key, name, details FROM (SELECT *, row_number() OVER (PARTITION BY visit, key ORDER BY position_no, item_id) AS k FROM raw) WHERE k = 1),
seen AS (SELECT patient, key, min(visit_no) AS first_no, max(visit_no) AS last_seen, count(*) AS n_visits FROM visits JOIN items USING (visit) GROUP BY 1, 2)
"""


@query(_BASE + "SELECT v.patient, visit, visit_no, before, visit_no = last_no AS is_latest FROM visits v JOIN latest USING (patient)")
def visit_numbering(s, d):
    v = _visits(s, d)
    last = v.groupBy("patient").agg(F.max("visit_no").alias("last_no"))
    return v.join(last, "patient").select("patient", "visit", "visit_no", "before", (F.col("visit_no") == F.col("last_no")).alias("is_latest"))


@query(_BASE + "SELECT v.visit, i.key FROM visits v JOIN items i USING (visit) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM items o WHERE o.visit = v.before AND o.key = i.key)")
def visit_added_items(s, d):
    i = _items(s, d).select("visit", "key")
    now = _visits(s, d).where("before IS NOT NULL").select("visit", "before").join(i, "visit")
    return now.join(i.withColumnRenamed("visit", "before"), ["before", "key"], "left_anti").select("visit", "key")


@query(_BASE + "SELECT v.visit, o.key FROM visits v JOIN items o ON o.visit = v.before WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.visit = v.visit AND i.key = o.key)")
def visit_omitted_items(s, d):
    i = _items(s, d).select("visit", "key")
    then = _visits(s, d).where("before IS NOT NULL").select("visit", "before").join(i.withColumnRenamed("visit", "before"), "before")
    return then.join(i, ["visit", "key"], "left_anti").select("visit", "key")


@query(_BASE + "SELECT v.visit, i.key, o.details AS old_details, i.details AS new_details FROM visits v JOIN items i ON i.visit = v.visit JOIN items o ON o.visit = v.before AND o.key = i.key WHERE o.details <> i.details")
def visit_changed_items(s, d):
    i = _items(s, d)
    now = _visits(s, d).where("before IS NOT NULL").select("visit", "before").join(i.select("visit", "key", F.col("details").alias("new_details")), "visit")
    old = i.select(F.col("visit").alias("before"), "key", F.col("details").alias("old_details"))
    return now.join(old, ["before", "key"]).where("old_details <> new_details").select("visit", "key", "old_details", "new_details")


def _seen(s, d):
    v = _visits(s, d).select("patient", "visit", "visit_no")
    seen = v.join(_items(s, d), "visit").groupBy("patient", "key").agg(F.min("visit_no").alias("first_no"), F.max("visit_no").alias("last_seen"), F.count("*").alias("n_visits"))
    return seen.join(v.groupBy("patient").agg(F.max("visit_no").alias("last_no")), "patient")


# Fixed value: words of a note that speak of stopping.
_STOPPED = r"\b(discontinu|stop(?:ped)?|cease|withdr(?:aw|ew))\w*\b"

_MENTIONS = (
    _BASE
    + rf""", names AS (SELECT DISTINCT patient, key, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS words FROM raw JOIN visits USING (visit)),
notes AS (SELECT v.patient, v.visit, e.aiSummary AS note FROM visits v JOIN clinical_extractions e ON e._id = v.visit UNION ALL SELECT v.patient, visit, verificationNotes FROM visits v JOIN medical_records r ON r.extraction = v.visit),
said AS (SELECT patient, visit, ' ' || regexp_replace(lower(note), '[^a-z0-9]+', ' ', 'g') || ' ' AS note FROM notes WHERE regexp_matches(lower(note), '{_STOPPED}')),
mentions AS (SELECT DISTINCT s.patient, s.visit, n.key FROM said s JOIN names n ON n.patient = s.patient AND n.words <> '' AND contains(s.note, ' ' || n.words || ' '))
"""
)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """(patient, visit, key): notes that speak of stopping and name, in whole words, a medicine that the patient has on record.

    Notes and names meet on the patient and the first word of the name, so that not all names of a patient meet all notes.
    """
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("patient", F.col("_id").alias("visit"), "aiSummary")
    written = table(s, d, "medical_records").select(F.col("extraction").alias("visit"), F.col("verificationNotes").alias("note")).distinct()
    notes = v.select("patient", "visit", F.col("aiSummary").alias("note")).unionByName(v.select("patient", "visit").join(written, "visit").select("patient", "visit", "note"))
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    said = notes.where(F.lower("note").rlike(_STOPPED)).select("patient", "visit", words("note").alias("note"))
    said = said.select("patient", "visit", F.concat(F.lit(" "), "note", F.lit(" ")).alias("note"), F.explode(F.array_distinct(F.split("note", " "))).alias("word"))
    named = table(s, d, "medication_items").where("name <> ''").select(F.col("extraction").alias("visit"), "name").distinct().join(v.select("patient", "visit"), "visit")
    named = named.select("patient", compact(F.col("name")).alias("key"), words("name").alias("words")).where("words <> ''").distinct()
    met = said.join(named.withColumn("word", F.substring_index("words", " ", 1)), ["patient", "word"])
    return met.where(F.contains("note", F.concat(F.lit(" "), "words", F.lit(" ")))).select("patient", "visit", "key").distinct()


@query(
    _MENTIONS
    + "SELECT patient, key, n_visits, first_no, last_seen, CASE WHEN (patient, key) IN (SELECT (patient, key) FROM mentions) THEN 'Explicitly discontinued' WHEN last_seen < last_no THEN 'Not listed in latest record' WHEN n_visits > 1 THEN 'Continued in latest record' ELSE 'First documented' END AS status FROM seen JOIN latest USING (patient)"
)
def item_timeline_status(s, d):
    stopped = _mentions(s, d).select("patient", "key").distinct().withColumn("stopped", F.lit(True))
    status = F.when(F.col("stopped"), "Explicitly discontinued").when(F.col("last_seen") < F.col("last_no"), "Not listed in latest record").when(F.col("n_visits") > 1, "Continued in latest record").otherwise("First documented")
    return _seen(s, d).join(stopped, ["patient", "key"], "left").select("patient", "key", "n_visits", "first_no", "last_seen", status.alias("status"))


@query(_BASE + "SELECT patient, key FROM seen JOIN latest USING (patient) WHERE first_no = last_no AND last_no > 1")
def new_in_latest(s, d):
    return _seen(s, d).where("first_no = last_no AND last_no > 1").select("patient", "key")


@query(_BASE + "SELECT patient, key, first_no FROM seen WHERE first_no > 1")
def first_seen_after_first_visit(s, d):
    return _seen(s, d).where("first_no > 1").select("patient", "key", "first_no")


@query(
    "WITH t AS (SELECT DISTINCT e.patient, i.extraction, lower(i.testName) AS test FROM investigation_items i JOIN clinical_extractions e ON e._id = i.extraction WHERE e.patient IS NOT NULL AND i.testName IS NOT NULL) SELECT patient, test, count(*) AS n_visits FROM t GROUP BY 1, 2 HAVING count(*) > 1"
)
def repeated_items(s, d):
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("patient", F.col("_id").alias("extraction"))
    t = table(s, d, "investigation_items").where("testName IS NOT NULL").select("extraction", F.lower("testName").alias("test")).distinct()
    return t.join(v, "extraction").groupBy("patient", "test").agg(F.count("*").alias("n_visits")).where("n_visits > 1")


@query(_BASE + "SELECT v.patient, count(*) AS n_visits, min(happened) AS first_visit, max(happened) AS last_visit, any_value(age) AS age, any_value(gender) AS gender FROM visits v LEFT JOIN patients p ON p._id = v.patient GROUP BY 1")
def patient_overview(s, d):
    """Visits, the first and the last, with age and gender; patients that are absent have neither."""
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").groupBy("patient").agg(F.count("*").alias("n_visits"), F.min("createdAt").alias("first_visit"), F.max("createdAt").alias("last_visit"))
    return v.join(table(s, d, "patients").select(F.col("_id").alias("patient"), "age", "gender"), "patient", "left")


@query("SELECT patient, visit, k FROM (SELECT patient, _id AS visit, row_number() OVER (PARTITION BY patient ORDER BY createdAt DESC, _id DESC) AS k FROM clinical_extractions WHERE patient IS NOT NULL) WHERE k <= 3")
def recent_visits(s, d):
    w = Window.partitionBy("patient").orderBy(F.desc("createdAt"), F.desc("_id"))
    return table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("patient", F.col("_id").alias("visit"), F.row_number().over(w).cast("bigint").alias("k")).where("k <= 3")


@query(_MENTIONS + "SELECT patient, visit, key FROM mentions")
def discontinued_mentions(s, d):
    """Summaries and notes that speak of stopping, with the medicines named in them."""
    return _mentions(s, d)


_TREND = "CASE WHEN regexp_matches(lower(testName), 'a1c|glycated') THEN 'HBA1C' WHEN regexp_matches(lower(testName), 'glucose|fbs|sugar') THEN 'GLUCOSE' WHEN regexp_matches(lower(testName), 'creat') THEN 'CREATININE' WHEN regexp_matches(lower(testName), 'chol') THEN 'CHOLESTEROL' END"


@query(
    f"WITH t AS (SELECT DISTINCT i.item_id, e.patient, i.testDate, i.numericValue, {_TREND} AS series FROM investigation_items i JOIN clinical_extractions e ON e._id = i.extraction WHERE e.patient IS NOT NULL AND i.testDate IS NOT NULL AND i.numericValue IS NOT NULL) SELECT item_id, series, numericValue AS value, lag(numericValue) OVER (PARTITION BY patient, series ORDER BY testDate, item_id) AS before FROM t WHERE series IS NOT NULL"
)
def trend_series(s, d):
    """Each value of four series with the value before it."""
    name = F.lower("testName")
    series = F.when(name.rlike("a1c|glycated"), "HBA1C").when(name.rlike("glucose|fbs|sugar"), "GLUCOSE").when(name.rlike("creat"), "CREATININE").when(name.rlike("chol"), "CHOLESTEROL")
    v = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("patient", F.col("_id").alias("extraction"))
    i = table(s, d, "investigation_items").where("testDate IS NOT NULL AND numericValue IS NOT NULL").select("item_id", "extraction", "testDate", "numericValue", series.alias("series")).where("series IS NOT NULL").distinct()
    keyed = i.join(v, "extraction").withColumn("line", F.concat_ws(":", F.col("patient").cast("string"), "series"))
    order = ["testDate", "item_id"]
    return with_previous(chunked(keyed, "line", order), "line", order, F.col("numericValue"), "before").select("item_id", "series", F.col("numericValue").alias("value"), "before")
