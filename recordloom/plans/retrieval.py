"""Retrieval: chunks of records, their tokens, scored top passages, citations and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators.ordered import chunked, with_position
from recordloom.plans.relational import listed
from recordloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF_DATE = "2025-01-01"
TOP = 8


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def chunks(s: SparkSession, d: str) -> DataFrame:
    """(record, document, kind, text, created, hash): a visit chunk for each record, and one for its medicines and its results."""
    r = table(s, d, "medical_records").select("_id", "document", "extraction", "title", "recordType", F.col("extractedData.diagnosis").alias("diagnosis"), "verificationNotes", "createdAt").distinct()
    head = F.concat_ws("\n", F.concat(F.lit("Record: "), "title"), F.concat(F.lit("Type: "), "recordType"), F.concat(F.lit("Diagnosis: "), "diagnosis"))
    visit = r.select("_id", "document", "createdAt", F.lit("visit").alias("kind"), F.concat_ws("\n", head, F.concat(F.lit("Notes: "), "verificationNotes")).alias("text"))

    def section(items: DataFrame, kind: str, line) -> DataFrame:
        lines = items.groupBy("extraction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position_no", "item_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
        return r.join(lines, "extraction").select("_id", "document", "createdAt", F.lit(kind).alias("kind"), F.concat_ws("\n", head, "lines").alias("text"))

    meds = table(s, d, "medication_items").where("name IS NOT NULL").select("extraction", "position_no", "item_id", "name", "dosage", "frequency").distinct()
    labs = table(s, d, "investigation_items").where("testName IS NOT NULL").select("extraction", "position_no", "item_id", "testName", "resultValue", "units").distinct()
    all_chunks = (
        visit.unionByName(section(meds, "medication", F.concat_ws(" ", "name", "dosage", "frequency"))).unionByName(section(labs, "investigation", F.concat_ws(" ", "testName", "resultValue", "units")))
    )
    key = F.sha2(F.concat_ws(":", F.col("_id").cast("string"), "kind", "text"), 256)
    return all_chunks.select(F.col("_id").alias("record"), "document", "kind", "text", F.col("createdAt").alias("created"), key.alias("hash"))


def _tokens(text: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9.%/+-]+', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({listed(X.RETRIEVAL_STOP_WORDS)})))"


_CHUNKS = f"""
WITH r AS (SELECT DISTINCT _id, document, extraction, title, recordType, extractedData.diagnosis AS diagnosis, verificationNotes, createdAt,
  concat_ws(chr(10), 'Record: ' || title, 'Type: ' || recordType, 'Diagnosis: ' || extractedData.diagnosis) AS head FROM medical_records),
meds AS (SELECT extraction, string_agg(concat_ws(' ', name, dosage, frequency), chr(10) ORDER BY position_no, item_id) AS lines FROM (SELECT DISTINCT extraction, position_no, item_id, name, dosage, frequency FROM medication_items WHERE name IS NOT NULL) GROUP BY 1),
labs AS (SELECT extraction, string_agg(concat_ws(' ', testName, resultValue, units), chr(10) ORDER BY position_no, item_id) AS lines FROM (SELECT DISTINCT extraction, position_no, item_id, testName, resultValue, units FROM investigation_items WHERE testName IS NOT NULL) GROUP BY 1),
parts AS (
  SELECT _id AS record, document, createdAt AS created, 'visit' AS kind, concat_ws(chr(10), head, 'Notes: ' || verificationNotes) AS text FROM r
  UNION ALL SELECT _id, document, createdAt, 'medication', concat_ws(chr(10), head, lines) FROM r JOIN meds USING (extraction)
  UNION ALL SELECT _id, document, createdAt, 'investigation', concat_ws(chr(10), head, lines) FROM r JOIN labs USING (extraction)
), chunks AS (SELECT *, sha256(record || ':' || kind || ':' || text) AS hash FROM parts),
asked AS (SELECT DISTINCT extractedData.diagnosis AS q FROM medical_records WHERE _id % 20 = 0 AND extractedData.diagnosis IS NOT NULL),
asked_words AS (SELECT q, unnest({_tokens("q")}) AS token FROM asked),
chunk_words AS (SELECT hash, unnest({_tokens("text")}) AS token FROM (SELECT DISTINCT hash, text FROM chunks)),
overlap AS (SELECT q, hash, count(*) AS n FROM asked_words JOIN chunk_words USING (token) GROUP BY ALL),
scored AS (SELECT q, c.record, c.document, c.kind, c.created, hash, round(4.0 * n + CASE WHEN contains(lower(c.text), lower(q)) THEN 3 ELSE 0 END + greatest(0, 1 - date_diff('day', c.created::DATE, DATE '{AS_OF_DATE}') / 3650.0), 4)::DOUBLE AS score FROM overlap JOIN chunks c USING (hash)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, created DESC, record, kind) AS place FROM scored) WHERE place <= {TOP})
"""


@query(_CHUNKS + "SELECT record, kind, length(text) AS n_chars, hash FROM chunks")
def chunk_build(s, d):
    return chunks(s, d).select("record", "kind", F.length("text").cast("bigint").alias("n_chars"), "hash")


@query(_CHUNKS + f"SELECT DISTINCT hash, len({_tokens('text')}) AS n_tokens FROM chunks")
def chunk_tokens(s, d):
    return chunks(s, d).select("hash", F.size(X.retrieval_tokens(F.col("text"))).cast("bigint").alias("n_tokens")).distinct()


def scored_chunks(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(q, place, record, document, kind, score): the best chunks of each distinct query.

    Four points for each distinct token in common, three where the chunk holds the whole query, and up to one for recency. Queries
    meet chunks by their tokens; equal queries are asked once. Of equal scores the newest comes first.
    """
    asked = queries.select("q").distinct().select("q", F.explode(X.retrieval_tokens(F.col("q"))).alias("token"))
    words = found.select("hash", F.explode(X.retrieval_tokens(F.col("text"))).alias("token"))
    overlap = asked.join(words.distinct(), "token").groupBy("q", "hash").agg(F.count("*").alias("n"))
    age = F.datediff(F.lit(AS_OF_DATE).cast("date"), F.col("created").cast("date")) / F.lit(3650.0)
    score = 4.0 * F.col("n") + F.when(F.contains(F.lower("text"), F.lower("q")), 3.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1.0 - age)
    scored = overlap.join(found, "hash").select("q", "record", "document", "kind", "created", F.round(score, 4).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("created"), "record", "kind")
    return scored.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= TOP)


def _ranked(s, d):
    queries = table(s, d, "medical_records").where("_id % 20 = 0").select(F.col("extractedData.diagnosis").alias("q")).where("q IS NOT NULL")
    return scored_chunks(queries, chunks(s, d))


@query(_CHUNKS + "SELECT q, place, record, kind, score FROM ranked")
def chunk_score_topk(s, d):
    """Diagnoses of the records whose id is divisible by 20, asked against all chunks."""
    return _ranked(s, d).select("q", "place", "record", "kind", "score")


@query(_CHUNKS + "SELECT q, document, min(place) AS first_place, max_by(kind, place) AS label FROM ranked WHERE document IS NOT NULL GROUP BY 1, 2")
def citations_dedup(s, d):
    """One citation for each document: its first place, and the label of its last."""
    return _ranked(s, d).where("document IS NOT NULL").groupBy("q", "document").agg(F.min("place").alias("first_place"), F.max_by("kind", "place").alias("label"))


@query(_CHUNKS + "SELECT q, string_agg('SOURCE ' || place || ': ' || record || ' ' || kind, chr(10) ORDER BY place) AS context FROM ranked GROUP BY 1")
def context_assembly(s, d):
    line = F.concat(F.lit("SOURCE "), F.col("place").cast("string"), F.lit(": "), F.col("record").cast("string"), F.lit(" "), "kind")
    return _ranked(s, d).groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


@query(
    _CHUNKS
    + """, allowed AS (SELECT _id AS record FROM medical_records GROUP BY 1 HAVING bool_or(doctorVerified AND status IN ('APPROVED', 'AMENDED'))),
stored AS (SELECT hash, record FROM chunks WHERE created < TIMESTAMP '2024-01-01'), incoming AS (SELECT hash, record FROM chunks WHERE record IN (SELECT record FROM allowed))
SELECT coalesce(n.record, o.record) AS record, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'insert' WHEN n.hash IS NULL THEN 'delete' ELSE 'keep' END AS action FROM stored o FULL JOIN incoming n ON n.hash = o.hash"""
)
def chunk_upsert(s, d):
    """What an index of the chunks written before 2024 has to insert, keep and delete to hold the chunks of verified records only.

    A chunk is known by its hash: a changed text is a new chunk, and its old one goes.
    """
    r = table(s, d, "medical_records").where("doctorVerified AND status IN ('APPROVED', 'AMENDED')").select(F.col("_id").alias("record")).distinct()
    c = chunks(s, d).select("record", "hash", "created")
    return upserted(c.where(F.col("created") < F.lit("2024-01-01").cast("timestamp_ntz")), c.join(r, "record", "left_semi"))


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(record, hash, action) of every chunk on either side; hashes are unique on each."""
    old, new = stored.select("hash", F.col("record").alias("old")), incoming.select("hash", F.col("record").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("keep")
    return old.join(new, "hash", "full").select(F.coalesce("new", "old").alias("record"), "hash", action.alias("action"))


POOL = 500


@query(
    _CHUNKS
    + f""", owner AS (SELECT DISTINCT _id AS record, patient FROM medical_records WHERE patient IS NOT NULL),
verified AS (SELECT DISTINCT _id AS record FROM medical_records WHERE doctorVerified AND status IN ('APPROVED', 'AMENDED')),
pool AS (SELECT * FROM (SELECT o.patient, c.*, row_number() OVER (PARTITION BY o.patient ORDER BY c.created DESC, c.record DESC, c.kind) AS k FROM chunks c JOIN owner o USING (record) JOIN verified USING (record)) WHERE k <= {POOL}),
wanted AS (SELECT DISTINCT patient, extractedData.diagnosis AS q FROM medical_records WHERE _id % 20 = 0 AND patient IS NOT NULL AND extractedData.diagnosis IS NOT NULL),
met AS (SELECT w.patient, w.q, p.record, p.kind, p.created, len(list_intersect({_tokens("w.q")}, {_tokens("p.text")})) AS n,
  round(4.0 * len(list_intersect({_tokens("w.q")}, {_tokens("p.text")})) + CASE WHEN contains(lower(p.text), lower(w.q)) THEN 3 ELSE 0 END + greatest(0, 1 - date_diff('day', p.created::DATE, DATE '{AS_OF_DATE}') / 3650.0), 4)::DOUBLE AS score FROM wanted w JOIN pool p USING (patient))
SELECT patient, q, place, record, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY patient, q ORDER BY score DESC, created DESC, record, kind) AS place FROM met) WHERE place <= {TOP}"""
)
def patient_retrieval(s, d):
    """The best chunks of the patient's own verified records for each diagnosis of the records whose id is divisible by 20.

    The newest 500 chunks of a patient are the pool, as the feature says; every chunk in it has a score, so that a query none of
    whose words is met still gets the newest.
    """
    r = table(s, d, "medical_records").where("patient IS NOT NULL")
    verified = r.where("doctorVerified AND status IN ('APPROVED', 'AMENDED')").select(F.col("_id").alias("record"), "patient").distinct()
    newest = Window.partitionBy("patient").orderBy(F.desc("created"), F.desc("record"), "kind")
    pool = chunks(s, d).join(verified, "record").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= POOL)
    wanted = r.where("_id % 20 = 0").select("patient", F.col("extractedData.diagnosis").alias("q")).where("q IS NOT NULL").distinct().withColumn("asked", X.retrieval_tokens(F.col("q")))
    overlap = F.size(F.array_intersect("asked", "words"))
    age = F.datediff(F.lit(AS_OF_DATE).cast("date"), F.col("created").cast("date")) / F.lit(3650.0)
    score = 4.0 * overlap + F.when(F.contains(F.lower("text"), F.lower("q")), 3.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1.0 - age)
    met = pool.join(wanted.select("patient").distinct(), "patient", "left_semi").withColumn("words", X.retrieval_tokens(F.col("text"))).join(wanted, "patient")
    best = Window.partitionBy("patient", "q").orderBy(F.desc("score"), F.desc("created"), "record", "kind")
    return met.withColumn("score", F.round(score, 4)).withColumn("place", F.row_number().over(best).cast("bigint")).where(F.col("place") <= TOP).select("patient", "q", "place", "record", "kind", "score")


@query(
    """WITH ok AS (SELECT e._id AS extraction, e.patient FROM clinical_extractions e JOIN clinical_documents c ON c._id = e.document WHERE e.patient IS NOT NULL AND c.status IN ('APPROVED', 'CLINICIAN_VERIFIED', 'AMENDED', 'DOCTOR_VERIFIED')),
meds AS (SELECT DISTINCT patient, item_id, extraction, position_no, concat('- ', name, ' ', coalesce(dosage, ''), ' ', coalesce(frequency, ''), CASE WHEN isVerified THEN ' (verified)' ELSE ' (extracted)' END) AS line FROM medication_items JOIN ok USING (extraction) WHERE name IS NOT NULL),
labs AS (SELECT DISTINCT patient, item_id, testDate, concat('- ', testName, ': ', coalesce(resultValue, 'not recorded'), ' ', coalesce(units, ''), ' [', coalesce(status, 'UNKNOWN'), '] ref ', coalesce(referenceRange, 'not recorded')) AS line FROM investigation_items JOIN ok USING (extraction) WHERE testName IS NOT NULL)
SELECT _id AS patient, 'patient' AS section, 1::BIGINT AS place, concat('PATIENT: ', coalesce(fullName, 'not recorded'), ', age ', coalesce(floor(age)::BIGINT::VARCHAR, 'unknown'), ', gender ', coalesce(gender, 'not recorded'), ', MRN ', coalesce(mrn, 'not recorded')) AS line FROM patients
UNION ALL SELECT _id, 'allergies', 2, 'ALLERGIES: ' || coalesce(nullif(allergies, ''), 'None documented') FROM patients UNION ALL SELECT _id, 'conditions', 3, 'CHRONIC CONDITIONS: ' || coalesce(nullif(chronicConditions, ''), 'None documented') FROM patients
UNION ALL SELECT patient, 'medication', row_number() OVER (PARTITION BY patient ORDER BY extraction, position_no, item_id), line FROM meds
UNION ALL SELECT patient, 'lab', row_number() OVER (PARTITION BY patient ORDER BY coalesce(testDate, TIMESTAMP '1970-01-01') DESC, item_id), line FROM labs"""
)
def patient_context_lines(s, d):
    """The context of each patient from verified documents, as numbered lines of each section; results newest first.

    Lines stay rows and are numbered over chunks: a patient with very many items is never gathered in one task.
    """
    seen = table(s, d, "clinical_documents").where("status IN ('APPROVED', 'CLINICIAN_VERIFIED', 'AMENDED', 'DOCTOR_VERIFIED')").select(F.col("_id").alias("document"))
    ok = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select(F.col("_id").alias("extraction"), "document", "patient").join(seen, "document", "left_semi").drop("document")
    text = lambda c, missing="": F.coalesce(F.col(c).cast("string"), F.lit(missing))
    lit = F.lit
    p = table(s, d, "patients")
    head = F.concat(lit("PATIENT: "), text("fullName", "not recorded"), lit(", age "), F.coalesce(F.floor("age").cast("string"), lit("unknown")), lit(", gender "), text("gender", "not recorded"), lit(", MRN "), text("mrn", "not recorded"))
    none = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), lit("None documented"))
    heads = F.array(*(F.struct(lit(n).alias("section"), lit(k).cast("bigint").alias("place"), c.alias("line")) for k, (n, c) in enumerate([("patient", head), ("allergies", F.concat(lit("ALLERGIES: "), none("allergies"))), ("conditions", F.concat(lit("CHRONIC CONDITIONS: "), none("chronicConditions")))], 1)))
    med = F.concat(lit("- "), "name", lit(" "), text("dosage"), lit(" "), text("frequency"), F.when(F.col("isVerified"), " (verified)").otherwise(" (extracted)"))
    lab = F.concat(lit("- "), "testName", lit(": "), text("resultValue", "not recorded"), lit(" "), text("units"), lit(" ["), text("status", "UNKNOWN"), lit("] ref "), text("referenceRange", "not recorded"))
    age = -F.unix_micros(F.coalesce(F.col("testDate").cast("timestamp"), F.timestamp_seconds(lit(0))))
    meds = table(s, d, "medication_items").where("name IS NOT NULL").select("extraction", F.col("extraction").alias("first"), F.col("position_no").cast("bigint").alias("second"), "item_id", lit("medication").alias("section"), med.alias("line"))
    labs = table(s, d, "investigation_items").where("testName IS NOT NULL").select("extraction", age.alias("first"), lit(0).cast("bigint").alias("second"), "item_id", lit("lab").alias("section"), lab.alias("line"))
    items = meds.unionByName(labs).join(ok, "extraction").drop("extraction").distinct().withColumn("part", F.concat_ws(":", F.col("patient").cast("string"), "section"))
    order = ["first", "second", "item_id"]
    numbered = with_position(chunked(items, "part", order), "part", order, "place").select("patient", "section", "place", "line")
    return p.select(F.col("_id").alias("patient"), F.explode(heads).alias("x")).select("patient", "x.*").unionByName(numbered)


@query(
    """WITH n AS (SELECT patient, count(*) AS visits FROM clinical_extractions WHERE patient IS NOT NULL GROUP BY 1)
SELECT e._id AS visit, coalesce(trim(aiSummary), '') <> '' AND (coalesce(trim(fullName), '') = '' OR contains(lower(aiSummary), lower(trim(fullName)))) AND contains(aiSummary, visits::VARCHAR) AS accepted FROM clinical_extractions e JOIN n USING (patient) LEFT JOIN patients p ON p._id = e.patient"""
)
def summary_guard(s, d):
    """Whether a summary may be shown: it must name the patient, where the name is known, and the number of visits."""
    e = table(s, d, "clinical_extractions").where("patient IS NOT NULL").select("_id", "patient", "aiSummary")
    n = e.groupBy("patient").agg(F.count("*").cast("string").alias("visits")).join(table(s, d, "patients").select(F.col("_id").alias("patient"), F.coalesce(F.trim("fullName"), F.lit("")).alias("name")), "patient", "left")
    said = F.coalesce("aiSummary", F.lit(""))
    named = (F.coalesce("name", F.lit("")) == "") | F.contains(F.lower(said), F.lower("name"))
    return e.join(n, "patient").select(F.col("_id").alias("visit"), ((F.trim(said) != "") & named & F.contains(said, F.col("visits"))).alias("accepted"))
