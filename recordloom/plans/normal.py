"""Records and fields in one normal form: dates, lists, types, confidence, boxes, and texts fit to be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

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


_RECORDS = """WITH r AS (SELECT DISTINCT _id, document, extraction, recordType, title, extractedData.diagnosis AS diagnosis, verificationNotes, version, verifiedAt, approvedAt, createdAt FROM medical_records),
joined AS (SELECT r.*, c.createdAt AS document_at, c.originalFilename, c.documentType, e.aiSummary FROM r LEFT JOIN clinical_documents c ON c._id = r.document LEFT JOIN clinical_extractions e ON e._id = r.extraction)
"""


def _records(s, d):
    r = table(s, d, "medical_records").select("_id", "document", "extraction", "recordType", "title", F.col("extractedData.diagnosis").alias("diagnosis"), "verificationNotes", "version", "verifiedAt", "approvedAt", "createdAt").distinct()
    c = table(s, d, "clinical_documents").select(F.col("_id").alias("document"), F.col("createdAt").alias("document_at"), "originalFilename", "documentType")
    e = table(s, d, "clinical_extractions").select(F.col("_id").alias("extraction"), "aiSummary")
    return r.join(c, "document", "left").join(e, "extraction", "left")


@query(
    _RECORDS
    + """SELECT _id, coalesce(document::VARCHAR, '') AS document_id, coalesce(strftime(coalesce(verifiedAt, approvedAt, createdAt, document_at), '%Y-%m-%dT%H:%M:%S'), '') AS date, coalesce(nullif(recordType, ''), nullif(documentType, ''), 'CLINICAL_NOTE') AS record_type,
  coalesce(nullif(title, ''), nullif(originalFilename, ''), 'Clinical record') AS title, coalesce(nullif(version, 0), 1) AS version, coalesce(trim(verificationNotes), '') AS verification_notes FROM joined"""
)
def record_normalised(s, d):
    """One flat row for each record: its date from the first stamp that is set, its document standing in where it says nothing."""
    day = F.date_format(F.coalesce("verifiedAt", "approvedAt", "createdAt", "document_at"), "yyyy-MM-dd'T'HH:mm:ss")
    return _records(s, d).select(
        "_id", F.coalesce(F.col("document").cast("string"), F.lit("")).alias("document_id"), F.coalesce(day, F.lit("")).alias("date"), F.coalesce(X.filled(F.col("recordType"), F.col("documentType")), F.lit("CLINICAL_NOTE")).alias("record_type"),
        F.coalesce(X.filled(F.col("title"), F.col("originalFilename")), F.lit("Clinical record")).alias("title"), F.coalesce(F.when(F.col("version") != 0, F.col("version")), F.lit(1)).cast("bigint").alias("version"), F.coalesce(F.trim("verificationNotes"), F.lit("")).alias("verification_notes"),
    )


@query(_RECORDS + "SELECT _id, array_to_string(list_filter([trim(verificationNotes), trim(aiSummary)], lambda x: x <> ''), chr(10)) AS notes, len(list_filter([trim(verificationNotes), trim(aiSummary)], lambda x: x <> '')) AS n_notes FROM joined")
def record_notes(s, d):
    """The notes that a record and its extraction hold, in order, without the empty ones."""
    notes = F.filter(F.array(F.trim("verificationNotes"), F.trim("aiSummary")), lambda x: F.coalesce(x, F.lit("")) != "")
    return _records(s, d).select("_id", F.array_join(notes, "\n").alias("notes"), F.size(notes).cast("bigint").alias("n_notes"))


def merged_list(*lists: Column) -> Column:
    """The trimmed entries of several lists in order, each once in whatever case, without empty ones; null lists count as empty."""
    entries = F.filter(F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), X.trimmed), lambda x: F.coalesce(x, F.lit("")) != "")
    folded = F.transform(entries, F.lower)
    return F.filter(entries, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


@query(
    r"""WITH r AS (SELECT DISTINCT _id, patient, extractedData.diagnosis AS diagnosis FROM medical_records),
l AS (SELECT r._id, list_filter(list_transform(list_concat(coalesce(string_split_regex(chronicConditions, '[,;]'), []), [diagnosis]), lambda x: trim(x)), lambda x: x <> '') AS c FROM r LEFT JOIN patients p ON p._id = r.patient),
u AS (SELECT _id, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) AS c FROM l)
SELECT _id, array_to_string(c, '|') AS conditions, len(c) AS n FROM u"""
)
def condition_lists(s, d):
    """Conditions of the patient and the diagnosis of the record as one list without repeats."""
    r = table(s, d, "medical_records").select("_id", "patient", F.col("extractedData.diagnosis").alias("diagnosis")).distinct()
    p = table(s, d, "patients").select(F.col("_id").alias("patient"), "chronicConditions")
    c = merged_list(F.split("chronicConditions", "[,;]"), F.array("diagnosis"))
    return r.join(p, "patient", "left").select("_id", c.alias("c")).select("_id", F.array_join("c", "|").alias("conditions"), F.size("c").cast("bigint").alias("n"))


@query(
    "SELECT _id, CASE WHEN suffix(lower(originalFilename), '.pdf') THEN 'application/pdf' WHEN suffix(lower(originalFilename), '.png') THEN 'image/png' WHEN suffix(lower(originalFilename), '.jpg') OR suffix(lower(originalFilename), '.jpeg') THEN 'image/jpeg' WHEN suffix(lower(originalFilename), '.webp') THEN 'image/webp' ELSE '' END AS mime FROM clinical_documents"
)
def mime_types(s, d):
    """The type that a file name tells; empty where it tells none."""
    return table(s, d, "clinical_documents").select("_id", mime(F.col("originalFilename"), F.lit("")).alias("mime"))


def mime(name: Column, provided: Column) -> Column:
    """Type by the ending of a file name, else the one provided."""
    # Endings and types.
    kinds = [(".pdf", "application/pdf"), (".png", "image/png"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".webp", "image/webp")]
    out = F.lower(F.coalesce(provided, F.lit("")))
    for ending, kind in reversed(kinds):
        out = F.when(F.lower(name).endswith(ending), kind).otherwise(out)
    return out


def initials(name: Column) -> Column:
    """First letters of the first two words; those of 'Patient' where there is no name."""
    words = F.filter(F.split(F.coalesce(F.when(name != "", name), F.lit("Patient")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), "")


@query(r"SELECT _id, array_to_string(list_transform(list_filter(string_split_regex(coalesce(nullif(fullName, ''), 'Patient'), '\s+'), lambda w: w <> '')[1:2], lambda w: left(w, 1)), '') AS initials FROM patients")
def patient_initials(s, d):
    return table(s, d, "patients").select("_id", initials(F.col("fullName")).alias("initials"))


def redacted_secrets(message: Column, length: int = 700) -> Column:
    """Bearer tokens and values of keys taken out of a message, which is then cut to its first letters as the log asks."""
    out = F.regexp_replace(message, r"(?i)Bearer\s+[^\s,;]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)(api[_-]?key|key|token)\s*[=:]\s*[^\s,;]+", "$1=[redacted]")
    return F.substring(out, 1, length)


@query(
    r"SELECT DISTINCT _id, left(regexp_replace(regexp_replace('call ' || _id || ' token=' || _id || '; Bearer ' || role || ' failed: ' || content, '(?i)Bearer\s+[^\s,;]+', 'Bearer [redacted]', 'g'), '(?i)(api[_-]?key|key|token)\s*[=:]\s*[^\s,;]+', '\1=[redacted]', 'g'), 700) AS message FROM messages WHERE content IS NOT NULL AND role IS NOT NULL"
)
def secret_redaction(s, d):
    """Log lines made of all messages with a role, without the secrets in them."""
    i = F.col("_id").cast("string")
    line = F.concat(F.lit("call "), i, F.lit(" token="), i, F.lit("; Bearer "), "role", F.lit(" failed: "), "content")
    return table(s, d, "messages").where("content IS NOT NULL AND role IS NOT NULL").select("_id", redacted_secrets(line).alias("message")).distinct()


def ratio(x: Column) -> Column:
    """A share; what is over 1 is taken for per cent."""
    return F.when(x > 1, x / 100).otherwise(x)


def percent_shown(score: Column) -> Column:
    """A whole per cent from 0 to 100, of a share or of per cent; 90 without a score."""
    x = F.coalesce(F.when(score != 0, score), F.lit(0.9))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(x > 1, x).otherwise(x * 100))) + 0.5).cast("bigint")


def extraction_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.65, "REVIEW_RECOMMENDED").otherwise("NEEDS_VERIFICATION")


@query(
    """WITH t AS (SELECT DISTINCT item_id, confidence, CASE WHEN item_id % 2 = 0 THEN round(confidence * 100, 2) ELSE confidence END AS typed FROM medication_items)
SELECT item_id, CASE WHEN typed > 1 THEN typed / 100 ELSE typed END AS share, floor(greatest(0.0, least(100.0, CASE WHEN coalesce(nullif(typed, 0), 0.9) > 1 THEN typed ELSE coalesce(nullif(typed, 0), 0.9) * 100 END)) + 0.5)::BIGINT AS shown,
  CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'REVIEW_RECOMMENDED' ELSE 'NEEDS_VERIFICATION' END AS tier FROM t"""
)
def confidence_forms(s, d):
    """Confidence written as a share (odd ids) or in per cent (even ids): as a share, as shown, and its tier at extraction."""
    c = F.col("confidence")
    t = table(s, d, "medication_items").select("item_id", "confidence", F.when(F.col("item_id") % 2 == 0, F.round(c * 100, 2)).otherwise(c).alias("typed")).distinct()
    return t.select("item_id", ratio(F.col("typed")).alias("share"), percent_shown(F.col("typed")).alias("shown"), extraction_tier(c).alias("tier"))


def valid_box(box: Column, default: Column) -> Column:
    """The box, if it has four finite numbers from 0 to 100, else the default, if that has, else null."""

    def good(b: Column) -> Column:
        return (F.size(b) == 4) & F.forall(b, lambda x: F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 100), F.lit(False)))

    return F.when(good(box), box).when(good(default), default)


@query(
    """WITH b AS (SELECT vec_id, label, list_transform(embedding[1:3 + vec_id % 2], lambda x: x::DOUBLE * 100) AS box FROM embeddings),
g AS (SELECT vec_id, CASE WHEN len(box) = 4 AND len(list_filter(box, lambda x: x >= 0 AND x <= 100)) = 4 THEN box WHEN label % 2 = 0 THEN [33.0::DOUBLE, 10, 41, 88] END AS box FROM b)
SELECT vec_id, round(box[1], 6) AS x0, round(box[4], 6) AS y1, box IS NOT NULL AS shown FROM g"""
)
def source_boxes(s, d):
    """Boxes from the first numbers of the vectors; three numbers are no box, and rows of even labels have a default."""
    box = F.transform(F.slice("embedding", F.lit(1), (F.lit(3) + F.col("vec_id") % 2).cast("int")), lambda x: x.cast("double") * 100)
    default = F.when(F.col("label") % 2 == 0, F.array(*(F.lit(x) for x in (33.0, 10.0, 41.0, 88.0))))
    t = table(s, d, "embeddings").select("vec_id", valid_box(box, default).alias("box"))
    return t.select("vec_id", F.round(F.get("box", F.lit(0)), 6).alias("x0"), F.round(F.get("box", F.lit(3)), 6).alias("y1"), F.col("box").isNotNull().alias("shown"))


@query("SELECT DISTINCT _id, upper(trim(extractedData.diagnosis)) AS diagnosis, doctorVerified AND coalesce(trim(verificationNotes), '') <> '' AS noted FROM medical_records")
def payload_rebuild(s, d):
    """The nested payload with one field replaced and one added, its other fields as they are."""
    payload = F.col("extractedData").withField("diagnosis", F.upper(F.trim("extractedData.diagnosis"))).withField("noted", F.col("doctorVerified") & (F.coalesce(F.trim("verificationNotes"), F.lit("")) != ""))
    return table(s, d, "medical_records").select("_id", payload.alias("payload")).select("_id", "payload.diagnosis", "payload.noted").distinct()


@query(
    """SELECT aiProvider AS provider, count(*) AS calls, sum(CASE WHEN e.status = 'REJECTED' THEN 1 ELSE 0 END)::BIGINT AS rejected, sum(CASE WHEN aiSummary IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_summary,
  round(avg(date_diff('second', date_trunc('second', c.createdAt), date_trunc('second', e.createdAt))::DOUBLE), 3) AS mean_seconds, max(date_diff('second', date_trunc('second', c.createdAt), date_trunc('second', e.createdAt))) AS longest_seconds, max(e.createdAt) AS last_at
FROM clinical_extractions e LEFT JOIN clinical_documents c ON c._id = e.document GROUP BY 1"""
)
def pipeline_metrics(s, d):
    """Calls, failures and durations of each provider, from the document's arrival to its extraction."""
    c = table(s, d, "clinical_documents").select(F.col("_id").alias("document"), F.col("createdAt").alias("arrived"))
    seconds = F.unix_timestamp("createdAt") - F.unix_timestamp("arrived")
    e = table(s, d, "clinical_extractions").join(c, "document", "left").withColumn("seconds", seconds)
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return e.groupBy(F.col("aiProvider").alias("provider")).agg(
        F.count("*").alias("calls"), count(F.col("status") == "REJECTED").alias("rejected"), count(F.col("aiSummary").isNull()).alias("without_summary"), F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.max("seconds").alias("longest_seconds"),
        F.max("createdAt").alias("last_at"),
    )
