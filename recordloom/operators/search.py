"""Weighted full-text search over records as joins: entities, postings, lookup, prefixes, suggestions, substrings and their fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import tokens
from recordloom.operators.similarity import contains_join, edit_join
from recordloom.operators.skew import salted_join
from recordloom.session import checkpointed

# The weight of a field in the postings.
WEIGHTS = {
    "patient": {"fullName": 5.0, "mrn": 6.0, "allergies": 2.0, "chronicConditions": 2.0},
    "document": {"originalFilename": 4.0, "documentType": 3.5, "month": 2.5},
    "medication": {"name": 4.5, "genericName": 4.5},
    "lab": {"testName": 4.0},
    "record": {"title": 5.0, "recordType": 3.0, "month": 2.5, "diagnosis": 3.8, "verificationNotes": 2.5},
}
# Fields that are looked up as whole phrases only.
PHRASES_ONLY = {"patient": ("phone",)}
# Scores of the stages; how many entities a prefix keeps, and a page of them shows.
PREFIX_SCORE, INDEX_FACTOR, BOTH_FACTOR, ALL_TOKENS_BOOST, SUBSTRING_SCORE = 100.0, 10.0, 5.0, 1.5, 40.0
FUZZY_SCORE, FUZZY_STEP, FUZZY_PAGE = 75.0, 15.0, 20
FIRST_OF_PREFIX, PREFIX_PAGE = 25, 30
# Lengths of the beginnings on which phrases and queries meet: a query takes the longest that it fills.
HEADS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def fields_of(kind: str) -> list[str]:
    return [*WEIGHTS[kind], *PHRASES_ONLY.get(kind, ())]


def month_label(at: Column) -> Column:
    return F.date_format(at, "MMMM yyyy")


def entities(read: Callable[[str], DataFrame]) -> DataFrame:
    """(id, kind, title, subtitle, field, text): one row for each field of each entity that search knows."""

    def long(df: DataFrame, kind: str, key: Column, title: Column, subtitle: Column) -> DataFrame:
        fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields_of(kind)))
        return df.select(key.alias("id"), F.lit(kind).alias("kind"), title.alias("title"), subtitle.alias("subtitle"), F.explode(fields).alias("x")).select("id", "kind", "title", "subtitle", "x.*").where("text IS NOT NULL")

    def named(prefix: str, *parts: str) -> Column:
        return F.concat_ws("_", F.lit(prefix), *(F.col(p).cast("string") for p in parts))

    docs = read("clinical_documents").withColumn("month", month_label(F.col("createdAt")))
    of_doc = read("clinical_extractions").select(F.col("_id").alias("extraction"), "document")
    meds = read("medication_items").select("extraction", "name", "genericName").where("name IS NOT NULL").distinct().join(of_doc, "extraction")
    labs = read("investigation_items").select("extraction", "testName").where("testName IS NOT NULL").distinct().join(of_doc, "extraction")
    recs = read("medical_records").select("_id", "title", "recordType", "createdAt", F.col("extractedData.diagnosis").alias("diagnosis"), "verificationNotes").distinct().withColumn("month", month_label(F.col("createdAt")))
    return (
        long(read("patients"), "patient", named("patient", "_id"), F.col("fullName"), F.col("mrn"))
        .unionByName(long(docs, "document", named("doc", "_id"), F.col("originalFilename"), F.col("documentType")))
        .unionByName(long(meds.select("document", "name", "genericName").distinct(), "medication", named("med", "document", "name"), F.col("name"), F.lit(None).cast("string")))
        .unionByName(long(labs.select("document", "testName").distinct(), "lab", named("lab", "document", "testName"), F.col("testName"), F.lit(None).cast("string")))
        .unionByName(long(recs, "record", named("rec", "_id"), F.col("title"), F.col("recordType")))
    )


def postings(fields: DataFrame) -> DataFrame:
    """(token, id, kind, score, n_fields): the summed weights of a token in an entity, each occurrence counted."""
    weight = F.lit(None).cast("double")
    for kind, ws in WEIGHTS.items():
        for field, w in ws.items():
            weight = F.when((F.col("kind") == kind) & (F.col("field") == field), F.lit(w)).otherwise(weight)
    words = fields.select("id", "kind", "field", weight.alias("w"), "text").where("w IS NOT NULL").select("id", "kind", "field", "w", F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token", "id", "kind").agg(F.round(F.sum("w"), 4).alias("score"), F.countDistinct("field").alias("n_fields"))


def asked_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.size(tokens(F.col("q"))).alias("n"), F.explode(tokens(F.col("q"))).alias("token"))


def lookup(queries: DataFrame, index: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, kind, score, hits): summed scores, raised by half where every token of the query is met; of the pairs
    ``among`` (query_id, id) only, if these are given.

    Entities of a common token are spread over tasks. A query without tokens finds nothing.
    """
    asked, index = asked_tokens(queries), index.select("token", "id", "kind", "score")
    each = salted_join(index, asked, ["token"], F.col("id")) if among is None else among.join(asked, "query_id").join(index, ["token", "id"])
    met = each.groupBy("query_id", "id", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("hits"), F.max("n").alias("n"))
    return met.select("query_id", "id", "kind", F.round(F.col("score") * F.when(F.col("hits") == F.col("n"), ALL_TOKENS_BOOST).otherwise(1.0), 4).alias("score"), "hits")


def leading(queries: DataFrame, index: DataFrame, page: int) -> DataFrame:
    """(query_id, id): all entities of the index that can be among the first ``page`` of ``fused`` by score, then id.

    Entities with two tokens of a query have one besides its most common token, so the entities of the other tokens are all
    taken. Of those with the most common token alone, one with ``page`` entities before it that are not found by prefix is out, as a
    further token never lowers a score; a prefix has PREFIX_PAGE entities at most.
    """
    asked = asked_tokens(queries).select("query_id", "token").distinct()
    common = index.groupBy("token").agg(F.count("*").alias("df"))
    ranked = checkpointed(asked.join(common, "token").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "token"))))
    first = index.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "id"))).where(F.col("place") <= page + PREFIX_PAGE)
    single = ranked.where("k = 1").join(first.select("token", "id"), "token").select("query_id", "id")
    return single.unionByName(salted_join(index.select("token", "id"), ranked.where("k > 1").select("query_id", "token"), ["token"], F.col("id")).select("query_id", "id"))


def phrases(fields: DataFrame) -> DataFrame:
    """(id, kind, phrase): whole field values in lower case that prefixes are looked up in."""
    known = fields.where("field IN ('fullName', 'mrn', 'phone', 'originalFilename', 'documentType', 'month', 'name', 'genericName', 'testName', 'title', 'diagnosis')")
    return known.select("id", "kind", F.lower(F.trim("text")).alias("phrase")).where("phrase <> ''").distinct()


def by_prefix(queries: DataFrame, known: DataFrame, page: int = PREFIX_PAGE) -> DataFrame:
    """(query_id, id, kind): the first entities, by id, of those with a phrase that begins with the query.

    Of each query the first 25 count, and those with a phrase that equals it, up to ``page`` in all. Phrases and queries
    meet on a beginning nearly as long as the query; entities of a common beginning are spread over tasks. An empty query finds nothing.
    """
    size = F.coalesce(*(F.when(F.length("q") >= n, F.lit(n)) for n in reversed(HEADS)))
    asked = queries.where("q <> ''").withColumn("size", size).select("query_id", "q", "size", F.substring(F.col("q"), F.lit(1), F.col("size")).alias("head"))
    sizes = asked.agg(F.collect_set("size").alias("sizes"))  # one row with at most len(HEADS) numbers
    heads = F.transform(F.filter("sizes", lambda n: n <= F.length("phrase")), lambda n: F.substring(F.col("phrase"), F.lit(1), n))
    begun = known.join(F.broadcast(sizes)).select("id", "kind", "phrase", F.explode(heads).alias("head"))
    met = salted_join(begun, asked, ["head"], F.col("id")).where(F.col("phrase").startswith(F.col("q")))
    each = met.groupBy("query_id", "id", "kind").agg(F.max((F.col("phrase") == F.col("q")).cast("int")).alias("whole"))

    def first(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("k") <= k).select("query_id", "id", "kind")

    return first(first(each, FIRST_OF_PREFIX).unionByName(first(each.where("whole = 1"), page)).distinct(), page)


def suggestions(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, suggestion, distance): the nearest phrase within two edits; of equally near ones the first by letters."""
    near = edit_join(queries.select(F.col("q").alias("l")), known.select(F.col("phrase").alias("r")))
    best = near.groupBy("l").agg(F.min(F.struct("distance", "r")).alias("x"))
    return queries.join(best, F.col("q") == F.col("l")).select("query_id", F.col("x.r").alias("suggestion"), F.col("x.distance").alias("distance"))


def by_substring(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, id): patients, documents and records whose title or subtitle holds the query."""
    shown = fields.where("kind IN ('patient', 'document', 'record')").select("id", F.lower(F.concat_ws(" ", "title", "subtitle")).alias("text")).distinct()
    return contains_join(queries, shown)


def fused(queries: DataFrame, fields: DataFrame, page: int | None = None) -> DataFrame:
    """(query_id, id, stage, score) over all stages; with ``page``, entities may be missing that are not among the first ``page`` of
    their query by score, then id.

    100 for a prefix plus five times the index score, and ten times the index score alone. Queries of three letters or more that
    neither finds take the entities of the nearest phrase within two edits: 75 less 15 for each edit. 40 for entities that only a
    substring finds. An empty query finds nothing.
    """
    known = checkpointed(phrases(fields))
    prefix = by_prefix(queries, known).select("query_id", "id", F.lit(True).alias("by_prefix"))
    held = by_substring(queries, fields)
    if page is None:
        index = lookup(queries, postings(fields))
    else:
        prefix, held = checkpointed(prefix), checkpointed(held)
        met = checkpointed(postings(fields).select("token", "id", "kind", "score").join(asked_tokens(queries).select("token").distinct(), "token", "left_semi"))
        index = lookup(queries, met, leading(queries, met, page).unionByName(prefix.select("query_id", "id")).unionByName(held).distinct())
    both = index.select("query_id", "id", F.col("score").alias("s")).join(prefix, ["query_id", "id"], "full")
    value = F.when(F.col("by_prefix") & F.col("s").isNotNull(), PREFIX_SCORE + BOTH_FACTOR * F.col("s")).when(F.col("by_prefix"), F.lit(PREFIX_SCORE)).otherwise(INDEX_FACTOR * F.col("s"))
    scored = checkpointed(both.select("query_id", "id", F.when(F.col("by_prefix"), "prefix").otherwise("index").alias("stage"), F.round(value, 3).alias("score")))
    missed = queries.where(F.length("q") >= 3).join(scored.select("query_id").distinct(), "query_id", "left_anti")
    nearest = checkpointed(suggestions(missed, known))
    close = by_prefix(nearest.select("query_id", F.col("suggestion").alias("q")), known, FUZZY_PAGE).join(nearest, "query_id")
    found = scored.unionByName(close.select("query_id", "id", F.lit("fuzzy").alias("stage"), (FUZZY_SCORE - FUZZY_STEP * F.col("distance")).alias("score")))
    rest = held.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("substring").alias("stage"), F.lit(SUBSTRING_SCORE).alias("score"))
    return found.unionByName(rest)


def page_size(asked: float | str | None, usual: int = 20, most: int = 50) -> int:
    """A limit as typed, cut to ``most``; ``usual`` where it is missing, nought or no number."""
    try:
        size = float(asked or 0)
    except ValueError:
        size = 0
    return int(min(size, most)) if size and size == size else usual


def top_results(scored: DataFrame, k: int = 15) -> DataFrame:
    """The best ``k`` of each query by score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
