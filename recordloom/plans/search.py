"""Search queries: every patient row whose id is divisible by 20 asks for its own name, against all entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.operators import search as S
from recordloom.operators.similarity import edit_join
from recordloom.plans.relational import listed
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


def _fields(s: SparkSession, d: str) -> DataFrame:
    return S.entities(lambda name: table(s, d, name))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "patients").where("_id % 20 = 0").select(F.col("_id").alias("query_id"), F.lower(F.trim("fullName")).alias("q")).where("q IS NOT NULL")


def _slips(s: SparkSession, d: str) -> DataFrame:
    """The names with their third letter left out."""
    return _asked(s, d).select("query_id", F.concat(F.substring("q", 1, 2), F.substring(F.col("q"), F.lit(4), F.length("q"))).alias("q"))


def _of_each(results: DataFrame, asked: DataFrame) -> DataFrame:
    """Results of distinct queries given back to all that ask the same."""
    return results.withColumnRenamed("query_id", "q").join(asked, "q").drop("q")


def _fused(s: SparkSession, d: str, asked: DataFrame, page: int | None = None) -> DataFrame:
    return S.fused(asked.select(F.col("q").alias("query_id"), "q").distinct(), _fields(s, d), page)


def _case(kind: str) -> str:
    return " ".join(f"WHEN kind = '{kind}' AND field = '{f}' THEN {w}" for f, w in S.WEIGHTS[kind].items())


def _unpivot(kind: str, source: str, key: str, title: str, subtitle: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS id, '{kind}' AS kind, {title} AS title, {subtitle} AS subtitle, '{f}' AS field, {f} AS text FROM {source} WHERE {f} IS NOT NULL" for f in S.fields_of(kind))


def _words(text: str, stop=X.STOP_WORDS) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({listed(stop)}))"


_SLIP = "substr(q, 1, 2) || substr(q, 4)"


def _search_sql(typed: str) -> str:
    return f"""
WITH docs AS (SELECT *, strftime(createdAt, '%B %Y') AS month FROM clinical_documents),
meds AS (SELECT DISTINCT document, name, genericName FROM medication_items i JOIN clinical_extractions e ON e._id = i.extraction WHERE name IS NOT NULL),
labs AS (SELECT DISTINCT document, testName FROM investigation_items i JOIN clinical_extractions e ON e._id = i.extraction WHERE testName IS NOT NULL),
recs AS (SELECT DISTINCT _id, title, recordType, strftime(createdAt, '%B %Y') AS month, extractedData.diagnosis AS diagnosis, verificationNotes FROM medical_records),
fields AS (
  {_unpivot("patient", "patients", "'patient_' || _id", "fullName", "mrn")} UNION ALL {_unpivot("document", "docs", "'doc_' || _id", "originalFilename", "documentType")}
  UNION ALL {_unpivot("medication", "meds", "concat_ws('_', 'med', document, name)", "name", "NULL")} UNION ALL {_unpivot("lab", "labs", "concat_ws('_', 'lab', document, testName)", "testName", "NULL")}
  UNION ALL {_unpivot("record", "recs", "'rec_' || _id", "title", "recordType")}
), words AS (SELECT id, kind, field, CASE {" ".join(_case(k) for k in S.WEIGHTS)} END AS w, unnest({_words("text")}) AS token FROM fields WHERE field <> 'phone'),
postings AS (SELECT token, id, kind, round(sum(w)::DOUBLE, 4) AS score, count(DISTINCT field) AS n_fields FROM words GROUP BY ALL),
asked AS (SELECT query_id, {typed} AS q FROM (SELECT _id AS query_id, lower(trim(fullName)) AS q FROM patients WHERE _id % 20 = 0 AND fullName IS NOT NULL)),
asked_words AS (SELECT query_id, len({_words("q")}) AS n, unnest({_words("q")}) AS token FROM asked),
found AS (SELECT query_id, id, kind, round(sum(score) * CASE WHEN count(*) = max(n) THEN 1.5 ELSE 1 END, 4) AS score, count(*) AS hits FROM asked_words JOIN postings USING (token) GROUP BY ALL),
phrases AS (SELECT DISTINCT id, kind, lower(trim(text)) AS phrase FROM fields WHERE field IN ('fullName', 'mrn', 'phone', 'originalFilename', 'documentType', 'month', 'name', 'genericName', 'testName', 'title', 'diagnosis') AND trim(text) <> ''),
prefixed AS (SELECT query_id, id, kind, max(CASE WHEN phrase = q THEN 1 ELSE 0 END) AS whole FROM asked JOIN phrases ON starts_with(phrase, q) WHERE q <> '' GROUP BY ALL),
kept_by_prefix AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM prefixed) WHERE k <= 25 OR whole = 1),
by_prefix AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM kept_by_prefix) WHERE k <= 30),
shown AS (SELECT DISTINCT id, lower(concat_ws(' ', title, subtitle)) AS text FROM fields WHERE kind IN ('patient', 'document', 'record')),
by_substring AS (SELECT DISTINCT query_id, id FROM asked JOIN shown ON contains(text, q) WHERE length(q) >= 3),
scored AS (
  SELECT coalesce(f.query_id, p.query_id) AS query_id, coalesce(f.id, p.id) AS id, CASE WHEN p.id IS NOT NULL THEN 'prefix' ELSE 'index' END AS stage,
    round(CASE WHEN p.id IS NOT NULL AND f.id IS NOT NULL THEN 100 + 5 * f.score WHEN p.id IS NOT NULL THEN 100 ELSE 10 * f.score END, 3)::DOUBLE AS score
  FROM found f FULL JOIN by_prefix p ON p.query_id = f.query_id AND p.id = f.id
), near AS (
  SELECT query_id, min({{'dist': levenshtein(q, phrase), 'phrase': phrase}}) AS x FROM asked, (SELECT DISTINCT phrase FROM phrases)
  WHERE length(q) >= 3 AND query_id NOT IN (SELECT query_id FROM scored) AND levenshtein(q, phrase) <= 2 GROUP BY 1
), near_prefixed AS (SELECT query_id, id, 75.0 - 15 * x.dist AS score, max(CASE WHEN phrase = x.phrase THEN 1 ELSE 0 END) AS whole FROM near JOIN phrases ON starts_with(phrase, x.phrase) GROUP BY ALL),
near_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM near_prefixed) WHERE k <= 25 OR whole = 1),
matched AS (SELECT * FROM scored UNION ALL SELECT query_id, id, 'fuzzy', score::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM near_kept) WHERE n <= 20),
fused AS (SELECT * FROM matched UNION ALL SELECT query_id, id, 'substring', 40.0::DOUBLE FROM by_substring b WHERE NOT EXISTS (SELECT 1 FROM matched c WHERE c.query_id = b.query_id AND c.id = b.id)),
page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM fused) WHERE place <= 15)
"""


_FIELDS = _search_sql("q")


@query(rf"SELECT doc_id, len({_words('text')}) AS n_tokens, len(list_distinct({_words('text')})) AS n_distinct FROM documents")
def tokenize_documents(s, d):
    w = X.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query(_FIELDS + "SELECT token, id, score, n_fields FROM postings")
def postings_weighted(s, d):
    return S.postings(_fields(s, d)).select("token", "id", "score", "n_fields")


@query(_FIELDS + "SELECT query_id, id, score, hits FROM found")
def search_lookup_boost(s, d):
    return S.lookup(_asked(s, d), S.postings(_fields(s, d))).select("query_id", "id", "score", "hits")


@query(_search_sql("substr(q, 1, 5)") + "SELECT query_id, id FROM by_prefix")
def search_prefix(s, d):
    """What a search box shows after five letters."""
    asked = _asked(s, d).select("query_id", F.substring("q", 1, 5).alias("q"))
    return _of_each(S.by_prefix(asked.select(F.col("q").alias("query_id"), "q").distinct(), S.phrases(_fields(s, d))), asked).select("query_id", "id")


@query(
    _FIELDS + f"SELECT query_id, x.phrase AS suggestion, x.dist AS distance FROM (SELECT query_id, min({{'dist': levenshtein({_SLIP}, phrase), 'phrase': phrase}}) AS x FROM asked, (SELECT DISTINCT phrase FROM phrases) WHERE levenshtein({_SLIP}, phrase) <= 2 GROUP BY 1)"
)
def search_fuzzy_suggest(s, d):
    """Names typed with a letter missing, and the nearest phrase of all kinds."""
    return S.suggestions(_slips(s, d), S.phrases(_fields(s, d)))


@query(_FIELDS + "SELECT query_id, id FROM by_substring")
def search_substring(s, d):
    return _of_each(S.by_substring(_asked(s, d).select(F.col("q").alias("query_id"), "q").distinct(), _fields(s, d)), _asked(s, d)).select("query_id", "id")


@query(_FIELDS + "SELECT query_id, place, id, stage, score FROM page")
def search_hybrid(s, d):
    """The first page of each name; equal names are asked once."""
    return _of_each(S.top_results(_fused(s, d, _asked(s, d), 15)), _asked(s, d)).select("query_id", "place", "id", "stage", "score")


@query(_search_sql(_SLIP) + "SELECT query_id, place, id, stage, score FROM page")
def search_misspelt(s, d):
    """The first page of each name typed with a letter missing, by way of the nearest phrase where nothing else matches."""
    return _of_each(S.top_results(_fused(s, d, _slips(s, d))), _slips(s, d)).select("query_id", "place", "id", "stage", "score")


@query(_FIELDS + "SELECT query_id, CASE split_part(id, '_', 1) WHEN 'patient' THEN 'patients' WHEN 'rec' THEN 'records' ELSE 'documents' END AS part, split_part(id, '_', 2)::BIGINT AS entity, min(place) AS place, count(*) AS n FROM page GROUP BY ALL")
def search_regrouped(s, d):
    """The first page of each name as patients, documents (with the medicines and results found in them) and records."""
    kind = F.split_part(F.col("id"), F.lit("_"), F.lit(1))
    part = F.when(kind == "patient", "patients").when(kind == "rec", "records").otherwise("documents")
    page = S.top_results(_fused(s, d, _asked(s, d))).groupBy("query_id", part.alias("part"), F.split_part(F.col("id"), F.lit("_"), F.lit(2)).cast("bigint").alias("entity"))
    return _of_each(page.agg(F.min("place").alias("place"), F.count("*").alias("n")), _asked(s, d))


@query(_FIELDS + "SELECT query_id, CASE split_part(id, '_', 1) WHEN 'doc' THEN 'document' WHEN 'med' THEN 'medication' WHEN 'rec' THEN 'record' ELSE split_part(id, '_', 1) END AS facet, count(*) AS n FROM fused GROUP BY ALL")
def search_facets(s, d):
    """Matches of each query by kind, over all matches and not only the page shown."""
    kind = F.split_part(F.col("id"), F.lit("_"), F.lit(1))
    facet = F.when(kind == "doc", "document").when(kind == "med", "medication").when(kind == "rec", "record").otherwise(kind)
    return _of_each(_fused(s, d, _asked(s, d)).groupBy("query_id", facet.alias("facet")).agg(F.count("*").alias("n")), _asked(s, d))


@query(
    r"SELECT _id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(content), '\b(patients)\b', 'patient', 'g'), '\b(prescriptions)\b', 'prescription', 'g'), '\b(medicines)\b', 'medicine', 'g'), '\b(with|having|from|in|for|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM (SELECT DISTINCT _id, content FROM messages WHERE content IS NOT NULL)"
)
def query_normalize(s, d):
    """Plural forms and filler words out of all typed texts."""
    q = F.lower("content")
    for many, one in (("patients", "patient"), ("prescriptions", "prescription"), ("medicines", "medicine")):
        q = F.regexp_replace(q, rf"\b({many})\b", one)
    q = F.trim(F.regexp_replace(F.regexp_replace(q, r"\b(with|having|from|in|for|the)\b", " "), r"\s+", " "))
    return table(s, d, "messages").where("content IS NOT NULL").select("_id", "content").distinct().select("_id", q.alias("q"))


@query(
    "WITH t AS (SELECT DISTINCT lower(regexp_extract(name, '^[A-Za-z]+')) AS typed FROM medication_items WHERE name IS NOT NULL), lex AS (SELECT DISTINCT lower(canonicalName) AS word FROM medication_reference), m AS (SELECT typed, min({'dist': levenshtein(typed, word), 'word': word}) AS x FROM t, lex WHERE length(typed) >= 5 AND typed NOT IN (SELECT word FROM lex) AND levenshtein(typed, word) <= CASE WHEN length(typed) < 8 THEN 1 ELSE 2 END GROUP BY 1) SELECT typed, x.word AS word, x.dist AS distance FROM m"
)
def lexicon_correct(s, d):
    """First words of medicine names that no lexicon word equals, with the nearest lexicon word: two edits, one below eight letters."""
    lex = table(s, d, "medication_reference").select(F.lower("canonicalName").alias("r")).distinct()
    typed = table(s, d, "medication_items").select(F.lower(F.regexp_extract("name", "^[A-Za-z]+", 0)).alias("l")).where("length(l) >= 5").distinct()
    near = edit_join(typed.join(lex.withColumnRenamed("r", "l"), "l", "left_anti"), lex).where("distance <= CASE WHEN length(l) < 8 THEN 1 ELSE 2 END")
    return near.groupBy("l").agg(F.min(F.struct("distance", "r")).alias("x")).select(F.col("l").alias("typed"), F.col("x.r").alias("word"), F.col("x.distance").alias("distance"))


@query(
    "WITH n AS (SELECT DISTINCT lower(fullName) AS v FROM patients WHERE fullName IS NOT NULL) SELECT a.v AS l, b.v AS r, levenshtein(a.v, b.v) AS distance FROM (SELECT DISTINCT lower(fullName) AS v FROM patients WHERE _id % 20 = 0) a, n b WHERE levenshtein(a.v, b.v) <= 2"
)
def similarity_join(s, d):
    """Names within two edits of the asking names."""
    p = table(s, d, "patients")
    return edit_join(p.where("_id % 20 = 0").select(F.lower("fullName").alias("l")), p.select(F.lower("fullName").alias("r")))
