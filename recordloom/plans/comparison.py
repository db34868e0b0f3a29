"""Visits held against the visit before in three sections, the sentences on what changed, and results worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import compact, trimmed
from recordloom.plans import history
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


def _entries(s: SparkSession, d: str) -> DataFrame:
    """(visit, section, key, shown, details): what a visit documents; of repeated keys the first place counts.

    Medicines differ by their details; diagnoses and investigations are only listed or not.
    """
    place = F.struct("position_no", "item_id")
    meds = table(s, d, "medication_items").withColumn("label", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("genericName"))).where("label <> ''")
    details = F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("dosage", "frequency", "route", "duration", "instructions")))
    labs = table(s, d, "investigation_items").withColumn("label", F.coalesce(F.when(F.col("testName") != "", F.col("testName")), F.col("panelName"))).where("label <> ''")
    diagnosis = trimmed(F.col("extractedData.diagnosis"))
    of_records = table(s, d, "medical_records").where("extraction IS NOT NULL").select(F.col("extraction").alias("visit"), diagnosis.alias("shown")).where("shown <> ''")

    def first(items: DataFrame, section: str, more) -> DataFrame:
        rows = items.select(F.col("extraction").alias("visit"), compact(F.col("label")).alias("key"), "label", more.alias("more"), place.alias("place"))
        return rows.groupBy("visit", "key").agg(F.min_by("label", "place").alias("shown"), F.min_by("more", "place").alias("details")).select("visit", F.lit(section).alias("section"), "key", "shown", "details")

    listed = of_records.groupBy("visit", F.lower("shown").alias("key")).agg(F.min("shown").alias("shown")).select("visit", F.lit("diagnosis").alias("section"), "key", "shown", F.lit("").alias("details"))
    return first(meds, "medication", details).unionByName(first(labs, "investigation", F.lit(""))).unionByName(listed)


def compared(visits: DataFrame, entries: DataFrame) -> DataFrame:
    """(visit, section, key, shown, state) of each visit with a visit before: added, continued, changed or notListed.

    One full join on (visit, section, key), so that the entries of a patient with very many visits lie in many tasks. A visit
    without entries has a row for each entry of the visit before, and none where both are empty.
    """
    pairs = visits.where("before IS NOT NULL").select("visit", "before")
    now = pairs.select("visit").join(entries, "visit").select("visit", "section", "key", F.col("shown").alias("now"), F.col("details").alias("now_details"))
    then = pairs.join(entries.withColumnRenamed("visit", "before"), "before").select("visit", "section", "key", F.col("shown").alias("then"), F.col("details").alias("then_details"))
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "notListed").when(F.col("now_details") == F.col("then_details"), "continued").otherwise("changed")
    return now.join(then, ["visit", "section", "key"], "full").select("visit", "section", "key", F.coalesce("now", "then").alias("shown"), state.alias("state"))


_ENTRIES = history._BASE + """,
med_items AS (SELECT extraction AS visit, item_id, position_no, coalesce(CASE WHEN name <> '' THEN name END, genericName) AS label,
  concat_ws('|', lower(trim(coalesce(dosage, ''))), lower(trim(coalesce(frequency, ''))), lower(trim(coalesce(route, ''))), lower(trim(coalesce(duration, ''))), lower(trim(coalesce(instructions, '')))) AS details FROM medication_items),
lab_items AS (SELECT extraction AS visit, item_id, position_no, coalesce(CASE WHEN testName <> '' THEN testName END, panelName) AS label, '' AS details FROM investigation_items),
listed AS (
  SELECT 'medication' AS section, * FROM med_items WHERE label <> '' UNION ALL SELECT 'investigation', * FROM lab_items WHERE label <> ''
), keyed AS (SELECT *, CASE WHEN regexp_replace(lower(label), '[^a-z0-9]', '', 'g') <> '' THEN regexp_replace(lower(label), '[^a-z0-9]', '', 'g') ELSE lower(trim(label)) END AS key FROM listed),
entries AS (
  SELECT visit, section, key, label AS shown, details FROM (SELECT *, row_number() OVER (PARTITION BY visit, section, key ORDER BY position_no, item_id) AS k FROM keyed) WHERE k = 1
  UNION ALL SELECT extraction, 'diagnosis', lower(trim(extractedData.diagnosis)), min(trim(extractedData.diagnosis)), '' FROM medical_records WHERE extraction IS NOT NULL AND trim(extractedData.diagnosis) <> '' GROUP BY ALL
), pairs AS (SELECT visit, before FROM visits WHERE before IS NOT NULL),
now AS (SELECT p.visit, section, key, shown, details FROM pairs p JOIN entries e ON e.visit = p.visit),
prior AS (SELECT p.visit, section, key, shown, details FROM pairs p JOIN entries e ON e.visit = p.before),
compared AS (
  SELECT coalesce(n.visit, t.visit) AS visit, coalesce(n.section, t.section) AS section, coalesce(n.key, t.key) AS key, coalesce(n.shown, t.shown) AS shown,
    CASE WHEN t.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'notListed' WHEN n.details = t.details THEN 'continued' ELSE 'changed' END AS state
  FROM now n FULL JOIN prior t ON t.visit = n.visit AND t.section = n.section AND t.key = n.key
)
"""


@query(_ENTRIES + "SELECT visit, section, key, shown, state FROM compared")
def visit_comparison(s, d):
    return compared(history._visits(s, d), _entries(s, d))


# How a change is told, by section and state.
SENTENCES = {
    ("medication", "added"): "Newly documented medication(s): ", ("medication", "notListed"): "Previously documented medication(s) not listed in this record: ", ("medication", "changed"): "Documented medication detail difference: ",
    ("diagnosis", "added"): "Newly documented diagnosis/condition: ", ("investigation", "added"): "New investigation documented: ",
}


@query(
    _ENTRIES
    + f""", said(section, state, opening) AS (VALUES {", ".join(f"('{a}', '{b}', '{v}')" for (a, b), v in SENTENCES.items())})
SELECT visit, section, state, opening || string_agg(shown, ', ' ORDER BY key) || '.' AS sentence FROM compared JOIN said USING (section, state) GROUP BY visit, section, state, opening"""
)
def visit_change_sentences(s, d):
    """What a visit documents anew, no longer, or with other details, as one sentence for each."""
    opening = F.lit(None).cast("string")
    for (section, state), text in SENTENCES.items():
        opening = F.when((F.col("section") == section) & (F.col("state") == state), text).otherwise(opening)
    told = visit_comparison(s, d).withColumn("opening", opening).where("opening IS NOT NULL").groupBy("visit", "section", "state", "opening")
    names = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "shown"))), lambda x: x["shown"]), ", ").alias("names"))
    return names.select("visit", "section", "state", F.concat("opening", "names", F.lit(".")).alias("sentence"))


@query(
    _ENTRIES + ", lab_seen AS (SELECT patient, key, min(visit_no) AS first_no FROM visits JOIN entries USING (visit) WHERE section = 'investigation' GROUP BY 1, 2) SELECT patient, key FROM lab_seen JOIN latest USING (patient) WHERE first_no = last_no"
)
def new_investigations_in_latest(s, d):
    """Investigations of the latest visit that no earlier visit has; of a patient's only visit all count."""
    v = history._visits(s, d).select("patient", "visit", "visit_no")
    first = v.join(_entries(s, d).where("section = 'investigation'"), "visit").groupBy("patient", "key").agg(F.min("visit_no").alias("first_no"))
    return first.join(v.groupBy("patient").agg(F.max("visit_no").alias("last_no")), "patient").where("first_no = last_no").select("patient", "key")


@query(
    """SELECT DISTINCT i.item_id, concat(coalesce(strftime(coalesce(i.testDate, e.createdAt), '%Y-%m-%d'), 'Not documented'), ': ', testName, CASE WHEN concat_ws(' ', nullif(trim(resultValue), ''), nullif(trim(units), '')) <> '' THEN ' — ' || concat_ws(' ', nullif(trim(resultValue), ''), nullif(trim(units), '')) ELSE '' END, CASE WHEN i.status IS NOT NULL THEN ' [' || i.status || ']' ELSE '' END) AS line
FROM investigation_items i LEFT JOIN clinical_extractions e ON e._id = i.extraction WHERE testName <> '' AND (resultValue <> '' OR i.status IN ('HIGH', 'LOW', 'CRITICAL'))"""
)
def important_results(s, d):
    """Results with a value, or out of range even without one, as dated lines."""
    at = table(s, d, "clinical_extractions").select(F.col("_id").alias("extraction"), "createdAt")
    i = table(s, d, "investigation_items").where("testName <> '' AND (resultValue <> '' OR status IN ('HIGH', 'LOW', 'CRITICAL'))").select("item_id", "extraction", "testDate", "testName", "resultValue", "units", "status").distinct()
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    result = F.concat_ws(" ", part("resultValue"), part("units"))
    day = F.coalesce(F.date_format(F.coalesce("testDate", "createdAt"), "yyyy-MM-dd"), F.lit("Not documented"))
    line = F.concat(day, F.lit(": "), "testName", F.when(result != "", F.concat(F.lit(" — "), result)).otherwise(""), F.when(F.col("status").isNotNull(), F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise(""))
    return i.join(at, "extraction", "left").select("item_id", line.alias("line"))
