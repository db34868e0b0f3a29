"""Mapping freely typed names to the entries of a reference list.

Typed values are cleaned to keys with column expressions, and only distinct keys are looked up. The lookup is a symmetric-delete
join: every string that two deletions make of a key meets every string that two deletions make of a reference spelling, which
finds all pairs within two edits without comparing all pairs. Candidates are ranked by a weighted Damerau-Levenshtein distance
in which likely confusions are cheap, then by how often the entry is used, then by its id.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.skew import bounded_rows
from recordloom.session import checkpointed

# Dosage forms, salts and release marks that are no part of a name.
FORMS = "tab|tabs|tablet|tablets|cap|caps|capsule|capsules|inj|injection|syp|syr|syrup|susp|suspension|oint|ointment|drops?|cream|gel|spray|inh|inhaler|sol|solution|amp|vial|t|c|rx"
SALTS = (
    "hydrochloride|hcl|hbr|besylate|besilate|mesylate|maleate|sodium|potassium|pot|sod|calcium|magnesium|sulphate|sulfate|phosphate|tartrate|succinate|fumarate|citrate|"
    "acetate|nitrate|bromide|chloride|dihydrate|monohydrate|anhydrous|xr|sr|er|mr|cr|dr|od|bd|tds|ds|xl|la|retard|forte|plus|generic|brand"
)
UNITS = "mg|mcg|ug|g|gm|gms|ml|iu|units?|%|mg/ml"
# Spellings that sound or look alike, longest first; both sides of a comparison are folded by them.
ALIKE = [("ee", "i"), ("ph", "f"), ("rn", "m"), ("ck", "c"), ("ks", "x"), ("y", "i"), ("z", "s"), ("k", "c"), ("v", "u"), ("0", "o"), ("1", "l"), ("5", "s"), ("8", "b")]
# Pairs of letters that are often taken for each other, with the cost of the exchange.
CHEAP = {frozenset(p): 0.4 for p in ("yi", "zs", "kc", "ei", "il", "uv", "ec", "hn", "oa", "nm", "rv", "gq", "bd", "fp")}
MAX_EDITS = 2
BROADCAST_SPELLINGS = 5_000  # a spelling has some hundred deletes; more spellings are joined by a shuffle


def _strip_accents(text: Column) -> Column:
    """Letters with accents to plain letters (a fixed table of the Latin letters in use)."""
    return F.translate(
        text,
        "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿžšćčß",
        "aaaaaaceeeeiiiinoooooouuuuyyzsccs",
    )


def name_parts(value: Column) -> Column:
    """Array of cleaned name parts of a typed value: struct(key, short).

    ``key`` has letters only; ``short`` tells that the part ends in a full stop, as an abbreviation does. Forms, strengths, salts
    and remarks in brackets go; digits inside words count as the letters they look like. Nothing left gives an empty array.
    """
    text = _strip_accents(F.lower(value))
    text = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", " ")
    text = F.regexp_replace(text, rf"(?<![a-z0-9])\d+(?:[.,]\d+)?\s*(?:{UNITS})(?![a-z])", " ")
    text = F.regexp_replace(text, r"(?<![a-z0-9])[0-9][0-9.,/%]*(?![a-z0-9])", " ")
    pieces = F.split(text, r"\s*(?:[+&/;,|]|\s(?:and|with|und|et|y)\s)\s*")

    def clean(piece: Column) -> Column:
        piece = F.regexp_replace(F.trim(piece), rf"^(?:(?:{FORMS})(?:[.\-:]\s*|\s+))+", "")
        piece = F.trim(F.regexp_replace(piece, rf"(?:[\s\-]+(?:{SALTS})\b\.?)+\s*$", ""))
        short = piece.rlike(r"[a-z]\.$")
        word = F.translate(piece, "0158", "olsb")
        return F.struct(F.regexp_replace(word, "[^a-z]", "").alias("key"), short.alias("short"))

    return F.filter(F.transform(pieces, clean), lambda p: F.length(p["key"]) > 0)


def folded(key: Column) -> Column:
    """A key with letters that look or sound alike folded to one."""
    for a, b in ALIKE:
        key = F.replace(key, F.lit(a), F.lit(b))
    return F.regexp_replace(key, r"(.)\1", "$1")


def deletes(key: Column) -> Column:
    """All strings that at most two deletions make of a key, itself included."""
    at = F.sequence(F.lit(1), F.length(key))

    def drop(word: Column) -> Column:
        return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1_000))))).otherwise(
            F.array().cast("array<string>")
        )

    once = F.when(F.length(key) > 0, F.transform(at, lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.lit(1_000))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(key), once, F.flatten(F.transform(once, drop))))


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance with cheap exchanges of look-alikes, cheap doubling and undoubling, and dearer first letters."""
    prev2, prev = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else CHEAP.get(frozenset((x, y)), 1.0) + (0.2 if i == 1 or j == 1 else 0.0)
            gone = 0.5 if i > 1 and a[i - 2] == x else 1.0
            new = 0.5 if j > 1 and b[j - 2] == y else 1.0
            best = min(prev[j - 1] + swap, prev[j] + gone, row[j - 1] + new)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 0.7)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def plain_key(text: str) -> str:
    return re.sub("[^a-z]", "", unicodedata.normalize("NFKD", text.lower()))


def reference_spellings(reference: DataFrame) -> DataFrame:
    """(entry, spelling): canonical and brand names of the reference, as keys."""
    names = F.concat(F.array("canonicalName"), F.coalesce("brandNames", F.array().cast("array<string>")))
    each = reference.select(F.col("med_ref_id").alias("entry"), F.explode(names).alias("typed"))
    return each.select("entry", F.explode(name_parts(F.col("typed"))).alias("p")).select("entry", F.col("p.key").alias("spelling")).distinct()


def map_names(values: DataFrame, reference: DataFrame, reference_limit: int = 100_000) -> DataFrame:
    """(value, entry) for each distinct ``value``: one row for each entry it denotes, or one with entry 0.

    ``reference``: med_ref_id, canonicalName, brandNames; its spellings, at most ``reference_limit``, are broadcast. A part of a
    value denotes the entry of an equal spelling; else, where it ends in a full stop, the entry whose spelling it begins; else the
    nearest spelling within two edits, of the key or of its folded form, whose weighted distance is at most 2 (1 for keys of
    fewer than seven letters). Ties go to the entry used more often, then to the smaller id. Null and empty values give no row.
    """
    spellings = reference_spellings(reference)
    bound = bounded_rows(spellings.select("entry", "spelling"), reference_limit, "the reference list")
    longest = max((len(r.spelling) for r in bound), default=0) + 2 * MAX_EDITS
    dictionary = values.sparkSession.createDataFrame([(r.entry, r.spelling) for r in bound], "entry bigint, spelling string")

    counted = values.where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("uses"))
    parts = counted.select("value", "uses", F.posexplode_outer(name_parts(F.col("value"))).alias("part_no", "p")).select("value", "uses", "part_no", "p.key", "p.short")
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows, but much is made of each: spread over all tasks and kept for the three lookups
    keys = checkpointed(parts.where("key IS NOT NULL").groupBy("key", "short").agg(F.sum("uses").alias("uses")).repartition(tasks, "key"))

    exact = keys.join(F.broadcast(dictionary), keys.key == dictionary.spelling).select("key", "short", "entry", "uses")
    used = exact.groupBy("entry").agg(F.sum("uses").alias("entry_uses"))  # at most one row for each entry of the reference

    fit = F.length("key") <= longest  # longer keys are further than two edits from every spelling
    # abbreviations meet the prefixes of the spellings, as typed and folded, by equality
    prefixes = lambda c: F.transform(F.sequence(F.lit(3), F.greatest(F.length(c), F.lit(3))), lambda k: F.substring(c, F.lit(1), k))
    heads = dictionary.select("entry", "spelling", F.explode(prefixes(F.col("spelling"))).alias("head")).distinct()
    folded_heads = dictionary.select("entry", "spelling", F.explode(prefixes(folded(F.col("spelling")))).alias("head")).distinct()
    short = keys.where(F.col("short") & (F.length("key") >= 3)).select("key", "short")
    begun = short.withColumn("head", F.col("key")).join(heads, "head").unionByName(short.where("length(key) >= 5").withColumn("head", folded(F.col("key"))).join(folded_heads, "head"))
    begun = begun.select("key", "short", "entry", "spelling", F.lit(True).alias("begins")).distinct()

    def near(form) -> DataFrame:
        ours = keys.where(fit).select("key", "short", F.explode(deletes(form(F.col("key")))).alias("stub"))
        theirs = dictionary.select("entry", "spelling", F.explode(deletes(form(F.col("spelling")))).alias("stub"))
        theirs = F.broadcast(theirs) if len(bound) <= BROADCAST_SPELLINGS else theirs
        return ours.join(theirs, "stub").select("key", "short", "entry", "spelling").distinct()

    close = near(lambda k: k).unionByName(near(folded)).distinct().withColumn("begins", F.lit(False))

    @F.pandas_udf("double")
    def cost(key: pd.Series, spelling: pd.Series, begins: pd.Series) -> pd.Series:
        def fold(k):
            for a, b in ALIKE:
                k = k.replace(a, b)
            return re.sub(r"(.)\1", r"\1", k)

        def one(k, s, b):
            if b:
                return 0.05 if s.startswith(k) else 0.3
            f, g = fold(k), fold(s)
            return min(weighted_distance(k, s), weighted_distance(f, g) + 0.25 if k != s else 0.0)

        return pd.Series([one(*x) for x in zip(key, spelling, begins)], dtype="float64")

    candidates = begun.unionByName(close).repartition(tasks, "key", "spelling").withColumn("cost", cost.asNondeterministic()("key", "spelling", "begins"))  # else the filter below is pushed down and costs are made for every join row
    short_key = F.length("key") < 7
    kept = candidates.where(F.col("begins") | (F.col("cost") <= F.when(short_key, 1.0).otherwise(2.0)))
    ranked = kept.join(F.broadcast(used), "entry", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("key", "short").orderBy("cost", F.desc(F.coalesce("entry_uses", F.lit(0))), "entry"))
    )
    best = ranked.where("place = 1").select("key", "short", "entry", F.round("cost", 3).alias("cost"))
    mapped = parts.join(best, ["key", "short"], "left")
    out = mapped.groupBy("value").agg(F.collect_set("entry").alias("entries"))
    return out.select("value", F.explode(F.when(F.size("entries") > 0, F.col("entries")).otherwise(F.array(F.lit(0).cast("bigint")))).alias("entry"))
