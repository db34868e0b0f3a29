"""Column expressions on text, numbers and JSON fields; Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for a missing value.
PLACEHOLDERS = ("null", "undefined", "n/a", "na", "none", "not detected", "not available", "unknown", "-", "--", "nil", "not_detected")
# Words that the search index leaves out.
STOP_WORDS = ("the", "and", "for", "with", "from", "was", "were", "that", "this", "are", "has", "have")
# Words that retrieval leaves out.
RETRIEVAL_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "how", "in", "is", "it", "of", "on", "or", "patient", "the", "their", "this", "to", "was", "were", "what", "when", "which", "with",
)


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(x != "", x) for x in xs))


def without_placeholder(x: Column) -> Column:
    """Null where the trimmed value is empty or only stands for a missing one."""
    t = trimmed(x)
    return F.when((t != "") & ~F.lower(t).isin(*PLACEHOLDERS), t)


def compact(x: Column) -> Column:
    """Lower case, ASCII letters and digits only; the trimmed lower-case value where nothing of it is left."""
    key = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.when(key != "", key).otherwise(F.lower(trimmed(x)))


def slug(x: Column, length: int = 80) -> Column:
    cut = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(cut, "^-+|-+$", ""), 1, length)


def first_number(x: Column) -> Column:
    """The first number in a text, thousands commas dropped; null where there is none."""
    return F.expr("double(null)") if x is None else F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def tokens(x: Column) -> Column:
    """Search tokens: lower case, letters, digits and hyphens, longer than one, no stop words; repeats are kept."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def retrieval_tokens(x: Column) -> Column:
    """Distinct retrieval tokens: letters, digits and . % / + -, longer than one, no stop words."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9.%/+-]+", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*RETRIEVAL_STOP_WORDS)))


def tier(confidence: Column) -> Column:
    """Band of a confidence value; null counts as unable to tell."""
    return (
        F.when(confidence >= 0.92, "HIGH").when(confidence >= 0.80, "REVIEW_RECOMMENDED").when(confidence >= 0.50, "NEEDS_VERIFICATION").otherwise("UNABLE_TO_DETERMINE")
    )
