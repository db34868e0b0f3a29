"""Scalar functions over the record tables: text, numbers, dates, arrays, JSON; and text, CSV, JSON and bundle outputs."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import jsonx
from recordloom.functions import text as X
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


@query(
    r"SELECT _id, regexp_replace(lower(fullName), '[^a-z0-9]', '', 'g') AS compact, left(regexp_replace(regexp_replace(lower(fullName), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug, right(_id::VARCHAR, 5) AS last5, upper(trim(gender)) AS sex, split_part(email, '@', 2) AS mail_host, length(fullName) AS n_chars FROM patients WHERE regexp_matches(fullName, '[A-Za-z]')"
)
def string_functions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "patients").where(F.col("fullName").rlike("[A-Za-z]"))
    return p.select(
        "_id", X.compact(F.col("fullName")).alias("compact"), X.slug(F.col("fullName")).alias("slug"), F.right(F.col("_id").cast("string"), F.lit(5)).alias("last5"), F.upper(F.trim("gender")).alias("sex"),
        F.split_part(F.col("email"), F.lit("@"), F.lit(2)).alias("mail_host"), F.length("fullName").cast("bigint").alias("n_chars"),
    )


@query("SELECT DISTINCT _id, replace(lower(recordType), '_', ' ') AS pretty, lower(status) AS class, CASE WHEN contains(lower(title), 'amended') THEN 'amend' WHEN contains(lower(title), 'review') THEN 'verify' ELSE 'default' END AS category FROM medical_records")
def label_functions(s, d):
    title = F.lower("title")
    category = F.when(F.contains(title, F.lit("amended")), "amend").when(F.contains(title, F.lit("review")), "verify").otherwise("default")
    return table(s, d, "medical_records").select("_id", F.replace(F.lower("recordType"), F.lit("_"), F.lit(" ")).alias("pretty"), F.lower("status").alias("class"), category.alias("category")).distinct()


@query(
    r"SELECT DISTINCT item_id, try_cast(nullif(regexp_extract(replace(resultValue, ',', ''), '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS number, round(least(greatest(confidence, 0.01), 1.0), 4) AS clamped, CASE WHEN confidence >= 0.92 THEN 'HIGH' WHEN confidence >= 0.80 THEN 'REVIEW_RECOMMENDED' WHEN confidence >= 0.50 THEN 'NEEDS_VERIFICATION' ELSE 'UNABLE_TO_DETERMINE' END AS band FROM investigation_items"
)
def number_functions(s, d):
    c = F.col("confidence")
    clamped = F.when(c.isNotNull(), F.round(F.least(F.greatest(c, F.lit(0.01)), F.lit(1.0)), 4)).otherwise(F.lit(0.01))
    return table(s, d, "investigation_items").select("item_id", X.first_number(F.col("resultValue")).alias("number"), clamped.alias("clamped"), X.tier(c).alias("band")).distinct()


@query(
    "SELECT _id, strftime(createdAt, '%Y-%m-%d') AS day, strftime(createdAt, '%B %Y') AS month, date_diff('day', createdAt::DATE, DATE '2025-01-01') AS age_days, strftime(createdAt, '%Y-%m-%dT%H:%M:%S') AS iso, year(createdAt) AS y, isodow(createdAt) AS weekday FROM clinical_documents"
)
def date_functions(s, d):
    at = F.col("createdAt")
    return table(s, d, "clinical_documents").select(
        "_id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "MMMM yyyy").alias("month"), F.datediff(F.lit("2025-01-01").cast("date"), at.cast("date")).cast("bigint").alias("age_days"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.year(at).cast("bigint").alias("y"), (F.weekday(at) + 1).cast("bigint").alias("weekday"),
    )


@query("SELECT med_ref_id, len(brandNames) AS n_brands, array_to_string(list_transform(brandNames, lambda x: upper(x)), '|') AS upper_brands, list_contains(brandNames, 'Briscapraus') AS has_it, coalesce(array_to_string(list_sort(brandNames), ','), '') AS sorted, len(list_filter(brandNames, lambda x: length(x) > 10)) AS n_long FROM medication_reference")
def array_functions(s, d):
    b = F.col("brandNames")
    return table(s, d, "medication_reference").select(
        "med_ref_id", F.size(b).cast("bigint").alias("n_brands"), F.array_join(F.transform(b, F.upper), "|").alias("upper_brands"), F.array_contains(b, "Briscapraus").alias("has_it"), F.array_join(F.sort_array(b), ",").alias("sorted"),
        F.size(F.filter(b, lambda x: F.length(x) > 10)).cast("bigint").alias("n_long"),
    )


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys, json_extract_string(props, '$.missing') IS NULL AS no_such FROM events")
def json_details_extract(s, d):
    p = F.col("props")
    return table(s, d, "events").select("event_id", F.get_json_object(p, "$.k").try_cast("bigint").alias("k"), F.size(F.json_object_keys(p)).cast("bigint").alias("n_keys"), F.get_json_object(p, "$.missing").isNull().alias("no_such"))


@query("SELECT DISTINCT item_id, coalesce(CASE WHEN trim(genericName) <> '' THEN genericName END, CASE WHEN trim(name) <> '' THEN name END, 'unnamed') AS label, coalesce(confidence, 0.9) AS confidence, CASE WHEN name IS NULL OR trim(name) = '' THEN 'not_detected' WHEN coalesce(confidence, 0.9) < 0.65 THEN 'review_required' ELSE 'detected' END AS state FROM medication_items")
def field_contract(s, d):
    """Aliases resolved in order, a default confidence, and the state of a field."""
    name, conf = F.col("name"), F.coalesce("confidence", F.lit(0.9))
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    state = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "not_detected").when(conf < 0.65, "review_required").otherwise("detected")
    return table(s, d, "medication_items").select("item_id", F.coalesce(filled("genericName"), filled("name"), F.lit("unnamed")).alias("label"), conf.alias("confidence"), state.alias("state")).distinct()


# Pattern of the name, low and high end, in the order in which they are tried.
LAB_RANGES = [("hba1c", 4.0, 5.6), ("glucose|sugar|fbs", 70.0, 99.0), ("creatinine", 0.6, 1.2), ("ldl", 0.0, 100.0), ("cholesterol", 0.0, 200.0)]


def lab_class(name, result):
    """CRITICAL over one and a half times the high end, HIGH, LOW, NORMAL; UNKNOWN without a number or a range."""
    name, v = F.lower(name), X.first_number(result)
    low = high = F.lit(None).cast("double")
    for pattern, lo, hi in reversed(LAB_RANGES):
        low, high = F.when(name.rlike(pattern), F.lit(lo)).otherwise(low), F.when(name.rlike(pattern), F.lit(hi)).otherwise(high)
    return F.when(v.isNull() | high.isNull(), "UNKNOWN").when(v > high * 1.5, "CRITICAL").when(v > high, "HIGH").when(v < low, "LOW").otherwise("NORMAL")


@query(
    """WITH r(code, lo, hi) AS (VALUES ('HBA1C', 4.0::DOUBLE, 5.6::DOUBLE), ('GLU', 70.0::DOUBLE, 99.0::DOUBLE), ('CREA', 0.6::DOUBLE, 1.2::DOUBLE), ('LDL', 0.0::DOUBLE, 100.0::DOUBLE), ('CHOL', 0.0::DOUBLE, 200.0::DOUBLE)),
t AS (SELECT DISTINCT item_id, resultValue, try_cast(regexp_extract(replace(coalesce(resultValue, ''), ',', ''), '-?[0-9]+([.][0-9]+)?') AS DOUBLE) AS v,
  CASE WHEN contains(lower(testName), 'hba1c') THEN 'HBA1C' WHEN regexp_matches(lower(testName), 'glucose|sugar|fbs') THEN 'GLU' WHEN contains(lower(testName), 'creatinine') THEN 'CREA' WHEN contains(lower(testName), 'ldl') THEN 'LDL' WHEN contains(lower(testName), 'cholesterol') THEN 'CHOL' END AS code FROM investigation_items)
SELECT DISTINCT item_id, v AS value, CASE WHEN v IS NULL OR r.code IS NULL THEN 'UNKNOWN' WHEN v > hi * 1.5::DOUBLE THEN 'CRITICAL' WHEN v > hi THEN 'HIGH' WHEN v < lo THEN 'LOW' ELSE 'NORMAL' END AS class FROM t LEFT JOIN r ON r.code = t.code"""
)
def lab_classify(s, d):
    """The first number of the typed result against a small table of ranges; the first name that fits decides."""
    return table(s, d, "investigation_items").select("item_id", X.first_number(F.col("resultValue")).alias("value"), lab_class(F.col("testName"), F.col("resultValue")).alias("class")).distinct()


@query(
    """SELECT '"' || coalesce(replace(_id::VARCHAR, '"', '""'), '') || '","' || coalesce(replace(originalFilename, '"', '""'), '') || '","' || coalesce(replace(documentType, '"', '""'), '') || '","' || coalesce(replace(status, '"', '""'), '') || '"' AS line FROM (SELECT * FROM clinical_documents ORDER BY createdAt DESC, _id LIMIT 500)"""
)
def csv_lines(s, d):
    """The newest 500 documents as fully quoted lines; ``sources.sinks.write_csv`` writes any frame this way."""
    newest = table(s, d, "clinical_documents").orderBy(F.desc("createdAt"), "_id").limit(500)
    quoted = [F.concat(F.lit('"'), F.coalesce(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')) for c in ("_id", "originalFilename", "documentType", "status")]
    return newest.select(F.concat_ws(",", *quoted).alias("line"))


@query(
    """WITH m AS (SELECT DISTINCT e.patient, i.item_id, i.name FROM medication_items i JOIN clinical_extractions e ON e._id = i.extraction WHERE e.patient IS NOT NULL AND i.name IS NOT NULL AND i.name <> '' AND i.position_no = 0),
k AS (SELECT patient, item_id, name FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY item_id DESC) AS n FROM m) WHERE n <= 10)
SELECT p._id, '{"resourceType":"Bundle","type":"collection","entry":[{"resource":{"resourceType":"Patient","id":"' || p._id || '"}}' || coalesce(string_agg(',{"resource":{"resourceType":"MedicationRequest","id":"' || item_id || '"}}', '' ORDER BY item_id DESC), '') || ']}' AS bundle FROM patients p LEFT JOIN k ON k.patient = p._id GROUP BY p._id"""
)
def patient_bundle(s, d):
    """A bundle for each patient with the first medicine of the ten newest extractions that have one, as JSON text."""
    of = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select(F.col("_id").alias("extraction"), "patient")
    m = table(s, d, "medication_items").where("name <> '' AND position_no = 0").select("extraction", "item_id").distinct().join(of, "extraction")
    newest = m.withColumn("n", F.row_number().over(Window.partitionBy("patient").orderBy(F.desc("item_id")))).where("n <= 10")
    entry = F.struct(F.struct(F.lit("MedicationRequest").alias("resourceType"), F.col("item_id").cast("string").alias("id")).alias("resource"))
    lists = newest.groupBy(F.col("patient").alias("_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", entry.alias("e"))), asc=False), lambda x: x["e"]).alias("meds"))
    first = F.array(F.struct(F.struct(F.lit("Patient").alias("resourceType"), F.col("_id").cast("string").alias("id")).alias("resource")))
    entries = F.when(F.col("meds").isNull(), first).otherwise(F.concat(first, F.col("meds")))
    return table(s, d, "patients").select("_id").join(lists, "_id", "left").select("_id", F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), entries.alias("entry"))).alias("bundle"))


@query("SELECT DISTINCT _id, concat_ws(chr(10), 'Record ' || _id, 'Status: ' || status, 'Reviewer: ' || verifiedByName, 'Diagnosis: ' || extractedData.diagnosis) AS text FROM medical_records WHERE doctorVerified")
def text_export(s, d):
    line = lambda label, c: F.concat(F.lit(label), c)
    r = table(s, d, "medical_records").where("doctorVerified")
    return r.select("_id", F.concat_ws("\n", line("Record ", F.col("_id").cast("string")), line("Status: ", F.col("status")), line("Reviewer: ", F.col("verifiedByName")), line("Diagnosis: ", F.col("extractedData.diagnosis"))).alias("text")).distinct()


def _cut_json(s: SparkSession, d: str) -> DataFrame:
    """Items as JSON text, cut at a place that a hash of the key tells: the input of the repair."""
    i = table(s, d, "medication_items").select("item_id", F.to_json(F.struct("item_id", "name", "dosage", "frequency", F.array("route", "duration").alias("more"))).alias("json")).distinct()
    keep = F.greatest(F.lit(12), F.floor(F.length("json") * (F.pmod(F.xxhash64("item_id"), F.lit(100)) + 1) / 100)).cast("int")
    return i.select("item_id", "json", F.substring(F.col("json"), F.lit(1), keep).alias("cut"))


@query()
def json_repair(s, d):
    """Cut JSON closed again, and whether it parses and still holds the key."""
    out = _cut_json(s, d).withColumn("fixed", jsonx.repaired(F.col("cut")))
    return out.select("item_id", "cut", "fixed", F.get_json_object("fixed", "$.item_id").try_cast("bigint").alias("key_read"), (F.col("cut") == F.col("json")).alias("whole"))


@query()
def file_signatures(s, d):
    """All files of the data folder by name, size and the first eight bytes of their content; no more of a file is read.

    Files without a byte have no row: Spark's scan passes over them.
    """
    # First bytes of the kinds of files that are told apart.
    kinds = {"25504446": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "52494646": "webp", "50415231": "parquet"}
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(d).select("path", "length")

    @F.pandas_udf("binary")
    def first_bytes(paths: pd.Series) -> pd.Series:
        def one(path: str) -> bytes:
            fs, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(path, safe="/:@")))
            with fs.open_input_file(at) as f:
                return f.read(8)

        return paths.map(one)

    head = F.hex(first_bytes("path"))
    kind = F.lit("unknown")
    for magic, name in kinds.items():
        kind = F.when(F.col("head").startswith(magic), name).otherwise(kind)
    return files.withColumn("head", head).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", kind.alias("kind"))
