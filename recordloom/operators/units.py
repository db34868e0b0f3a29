"""Quantities recorded in different units.

A unit string is segmented by dynamic programming over tries of prefixes, roots and powers of ten; the decompositions are scored,
and those whose dimension is not one of the measured field are dropped (the field's priors). Two unit strings are the same unit
when dimension and scale agree. Rows are converted where they are read; no shuffle is needed but for the typical ranges, which
are a small aggregate by field and unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.skew import bounded_rows
from recordloom.session import checkpointed

# Prefixes and their power of ten.
PREFIXES = {"k": 3, "kilo": 3, "d": -1, "deci": -1, "c": -2, "centi": -2, "m": -3, "milli": -3, "u": -6, "mc": -6, "mcg": None, "micro": -6, "n": -9, "nano": -9, "p": -12, "pico": -12}
# Roots, their dimension and their power of ten (a float for a factor that is no power of ten).
ROOTS = {
    "g": ("mass", 0), "gm": ("mass", 0), "gms": ("mass", 0), "gram": ("mass", 0), "grams": ("mass", 0), "gs": ("mass", 0),
    "mol": ("amount", 0), "mole": ("amount", 0), "moles": ("amount", 0), "mols": ("amount", 0),
    "eq": ("charge", 0), "equiv": ("charge", 0),
    "l": ("volume", 0), "lt": ("volume", 0), "ltr": ("volume", 0), "litre": ("volume", 0), "litres": ("volume", 0), "liter": ("volume", 0), "liters": ("volume", 0),
    "cumm": ("volume", -6), "cmm": ("volume", -6), "mm3": ("volume", -6), "mm^3": ("volume", -6), "cubicmm": ("volume", -6),
    "metre": ("length", 0), "metres": ("length", 0), "meter": ("length", 0), "meters": ("length", 0), "mtr": ("length", 0), "mtrs": ("length", 0), "mt": ("length", 0), "mts": ("length", 0), "m": ("length", 0), "ms": ("length", 0),
    "in": ("inch", 0), "inch": ("inch", 0), "inches": ("inch", 0), "ins": ("inch", 0), '"': ("inch", 0), "''": ("inch", 0),
    "ft": ("foot", 0), "feet": ("foot", 0), "foot": ("foot", 0),
    "lb": ("pound", 0), "lbs": ("pound", 0), "pound": ("pound", 0), "pounds": ("pound", 0),
    "kg": ("mass", 3), "kgs": ("mass", 3), "kilo": ("mass", 3), "kilos": ("mass", 3), "cms": ("length", -2), "cm": ("length", -2),
    "c": ("celsius", 0), "celsius": ("celsius", 0), "celcius": ("celsius", 0), "centigrade": ("celsius", 0), "degc": ("celsius", 0),
    "f": ("fahrenheit", 0), "fahrenheit": ("fahrenheit", 0), "degf": ("fahrenheit", 0),
    "%": ("fraction", 0), "percent": ("fraction", 0), "pct": ("fraction", 0), "percentage": ("fraction", 0),
    "lakh": ("count", 5), "lakhs": ("count", 5), "lac": ("count", 5), "lacs": ("count", 5), "million": ("count", 6), "mill": ("count", 6), "thousand": ("count", 3), "thou": ("count", 3),
    "cells": ("count", 0), "cell": ("count", 0), "count": ("count", 0), "giga": ("count", 9),
    "molar": ("molar", 0),
}
# Words that say nothing on scale or dimension.
NOISE = ("ngsp", "dcct", "ifcc", "hb", "of", "total", "units", "unit", "deg", "degrees", "degree", "°", "º", ".", ",", "(", ")", "[", "]", "x", "×", "approx", "about")
# Pieces that are units only where nothing follows them.
SHORT_WORDS = ("in", "ms", "mt", "ft", "gs", "lt", "lb")
# What is read as a fraction bar.
BARS = ("/", "per", "÷")
# Fields by the way their names are typed, in this order, and the spaces of dimensions that a field can have.
FIELD_NAMES = [
    ("HBA1C", r"a1c|glyc(at|osylat)ed|glycoh"), ("GLU", r"gluc|\bfbs\b|\bfpg\b|\brbs\b|\bbsl?\b|sugar"), ("CREA", r"creat"), ("CHOL", r"chol(?!.*(hdl|ldl))"),
    ("TRIG", r"trigl|\btg\b|\btgl\b"), ("HGB", r"h(a)?emoglobin|\bhgb?\b|\bhb\b"), ("UREA", r"urea"), ("CALC", r"calcium|\bca\b"), ("POT", r"potassium|\bk\b"),
    ("VITD", r"vit[a-z.]*\s*-?d|25.?oh|25.?hydroxy|cholecalciferol"), ("BILI", r"bili|\bt\.? ?bil"), ("PLT", r"platelet|thrombocyte|\bplts?\b"), ("WT", r"weight|\bwt\b"),
    ("TEMP", r"temp"), ("HT", r"height|\bht\b|stature"),
]
# Placeholder spellings that name no unit.
NO_UNIT = {"", "-", "--", "n/a", "na", "nil", "none", "null", "unknown", "see range", "see report", "see below", "?", "as above", "same"}


def field_code(name: Column) -> Column:
    """The code of the measured field for a typed field name; null where it is none of the known fields."""
    typed = F.lower(name)
    out = F.lit(None).cast("string")
    for code, pattern in reversed(FIELD_NAMES):
        out = F.when(typed.rlike(pattern), F.lit(code)).otherwise(out)
    return out


@dataclass(frozen=True)
class Unit:
    """Dimension as sorted (base, power) pairs and the power of ten of the scale."""

    dims: tuple
    scale: float


def _trie(words) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[None] = word
    return root


_ROOT_TRIE, _PREFIX_TRIE, _NOISE_TRIE, _BAR_TRIE = _trie(ROOTS), _trie(k for k, v in PREFIXES.items() if v is not None), _trie(NOISE), _trie(BARS)
_POWER = re.compile(r"(?:x|\*)?10(?:\^|\*\*?|e)?\s?(\d{1,2})(?=[^0-9]|$)|(?:x|\*)?e(\d{1,2})(?=[^0-9a-z]|$)|1?000(?=/|per)")


def _matches(trie: dict, text: str, at: int) -> Iterator[str]:
    node = trie
    while at < len(text) and text[at] in node:
        node = node[text[at]]
        at += 1
        if None in node:
            yield node[None]


def plain(text: str) -> str:
    """Lower case, compatibility forms (superscripts, micro signs) folded, blanks single."""
    raised = re.sub(r"[⁰¹²³⁴-⁹]+", lambda m: "^" + m[0], text)
    folded = unicodedata.normalize("NFKC", raised).replace("µ", "u").replace("μ", "u").replace("−", "-")
    return " ".join(folded.lower().split())


@lru_cache(maxsize=50_000)
def segment(text: str) -> tuple[tuple[float, Unit], ...]:
    """All decompositions of a unit string with their cost, cheapest first; () where it can't be read. Words behind the unit are left
    out: the longest piece from the start that can be read counts.

    The state of the dynamic program is (position, below the bar?, dimension, scale); a step consumes a power of ten, a noise
    word, a bar, or an optional prefix with a root. Longer pieces cost less, noise and prefixes cost a little.
    """
    text = plain(text).strip(" .;:")
    if not text or text in NO_UNIT:
        return ()
    states: list[dict] = [{} for _ in range(len(text) + 1)]
    states[0][(False, (), 0.0)] = 0.0

    def put(at, key, cost):
        if cost < states[at].get(key, math.inf):
            states[at][key] = cost

    for at, ch in enumerate(text):
        for (below, dims, scale), cost in list(states[at].items()):
            sign = -1 if below else 1
            if ch == " ":
                put(at + 1, (below, dims, scale), cost)
                continue
            if (m := _POWER.match(text, at)) and m.end() > at:
                put(m.end(), (below, dims, scale + sign * float(m[1] or m[2] or 3)), cost + 0.1)
            for word in _matches(_NOISE_TRIE, text, at):
                put(at + len(word), (below, dims, scale), cost + (0.6 if word.isalpha() and len(word) > 1 else 0.9))
            if not below:
                for word in _matches(_BAR_TRIE, text, at):
                    put(at + len(word), (True, dims, scale), cost + 0.1)
            for start, power, extra in [(at, 0, 0.0), *((at + len(p), PREFIXES[p], 0.3) for p in _matches(_PREFIX_TRIE, text, at))]:
                while start < len(text) and start > at and text[start] == " ":
                    start += 1
                for word in _matches(_ROOT_TRIE, text, start):
                    base, own = ROOTS[word]
                    end = start + len(word)
                    if word.isalpha() and end < len(text) and text[end].isalpha() and not _starts(text, end):
                        continue
                    have = dict(dims)
                    have[base] = have.get(base, 0) + sign
                    put(end, (below, tuple(sorted((k, v) for k, v in have.items() if v)), scale + sign * (own + power)), cost + extra + 1.0 / len(word))
    # the whole text, else the longest piece from its start that ends with a word and is more than one letter
    for end in range(len(text), 1, -1):
        if not states[end] or (end < len(text) and (text[end].isalnum() or text[end - 1] == " " or text[:end].strip() in SHORT_WORDS)):
            continue
        out: dict = {}
        for (_, dims, scale), cost in states[end].items():
            for unit in _canonical(dims, scale):
                if cost < out.get(unit, math.inf):
                    out[unit] = cost
        if out:
            return tuple(sorted(((c, u) for u, c in out.items()), key=lambda x: (x[0], str(x[1]))))
    return _whole(states, text)


def _whole(states: list[dict], text: str) -> tuple[tuple[float, Unit], ...]:
    """The readings of a text of one letter."""
    found = {u: c for (_, dims, scale), c in states[len(text)].items() for u in _canonical(dims, scale)} if len(text) == 1 else {}
    return tuple(sorted(((c, u) for u, c in found.items()), key=lambda x: (x[0], str(x[1]))))


def _starts(text: str, at: int) -> bool:
    return any(True for t in (_ROOT_TRIE, _PREFIX_TRIE, _NOISE_TRIE, _BAR_TRIE) for _ in _matches(t, text, at))


def _canonical(dims: tuple, scale: float) -> list[Unit]:
    """Readings of a bare product: M is mol/L, 'g%' is g/dL, a count without a root is a pure power, a ratio of amounts has none."""
    d = dict(dims)
    out = []
    if d.get("molar") == 1 or d == {"length": 1} or d == {"length": 1, "volume": -1}:  # M, also where it could be a metre
        rest = {k: v for k, v in d.items() if k not in ("molar", "length", "volume")}
        if not rest:
            out.append(Unit((("amount", 1), ("volume", -1)), round(scale, 6)))
    if d.get("fraction") == 1 and len(d) == 2 and d.get("mass") == 1:
        out.append(Unit((("mass", 1), ("volume", -1)), round(scale + 1, 6)))
    if d == {"fraction": 1}:
        out.append(Unit((("fraction", 1),), round(scale, 6)))
        return out
    if d.get("volume") == -1 and set(d) <= {"volume", "count"}:
        out.append(Unit((("volume", -1),), round(scale, 6)))
        return out
    if d == {} and scale:
        return [Unit((), round(scale, 6))]
    if d and "molar" not in d and d != {"length": 1, "volume": -1}:
        out.append(Unit(tuple(sorted(d.items())), round(scale, 6)))
    return out


@dataclass
class UnitTable:
    """The units that each field may be recorded in, as read from the table of units."""

    by_field: dict[str, list[dict]]

    @classmethod
    def of(cls, units: DataFrame, limit: int = 10_000) -> "UnitTable":
        """``units``: test_code, unit_code, factor, offset_add, is_common; a fixed list, at most ``limit`` rows."""
        by_field: dict[str, list[dict]] = {}
        for r in bounded_rows(units.select("test_code", "unit_code", "factor", "offset_add", "is_common"), limit, "the table of units"):
            by_field.setdefault(r.test_code, []).append(r.asDict())
        for rows in by_field.values():
            rows.sort(key=lambda r: (not r["is_common"], r["unit_code"]))
        return cls(by_field)

    def common(self, code: str) -> str | None:
        return next((r["unit_code"] for r in self.by_field.get(code, []) if r["is_common"]), None)

    def read(self, code: str, text: str | None) -> str | None:
        """The unit_code that a unit string names for the field; None where it names none of the field's units."""
        if text is None or code not in self.by_field:
            return None
        readings = segment(text)
        best, found = math.inf, None
        for row in self.by_field[code]:
            for _, unit in segment(row["unit_code"])[:1]:
                for cost, got in readings:
                    if got == unit and cost < best:
                        best, found = cost, row["unit_code"]
        if found is None and readings and code == "HBA1C" and any(dict(u.dims).get("amount") == 0 or u.dims == () and u.scale == -3 for _, u in readings):
            found = next((r["unit_code"] for r in self.by_field[code] if "mol" in r["unit_code"]), None)
        return found


_FLAG = r"(?:(?<![/\w])(?<!/ )(?<!per )\(?[hl]{1,2}\)?(?!\w)|\*+|\(abn[a-z]*\)|\b(?:high|low|normal|abnormal|critical)\b|↑|↓)"
_TIME = re.compile(r"\s?-?\s?(?:hours?|hrs?|h|minutes?|mins?|days?|weeks?|months?)\b(?!\s*/)", re.I)  # after a number that is no result
_NUMBER = re.compile(r"[-+]?\d+(?:[.,·]\d+)*")


def split_value(text: str | None) -> tuple[float | None, str]:
    """The first number of a typed result that is no time, and the text behind it without flags and comparison words.

    '117,175' is read as thousands (three digits after every comma), '9,5' as a decimal comma. No number: (None, '').
    """
    if not text:
        return None, ""
    flat = plain(text)
    m = next((x for x in _NUMBER.finditer(flat) if not (_TIME.match(flat, x.end()) and _NUMBER.search(flat, x.end()))), None)
    if not m:
        return None, ""
    digits, rest = m[0], flat[m.end():]
    glued = re.match(r"^(\d+?)10$", digits)
    if glued and re.match(r"\s?[\^*]\s?\d", rest):  # '27710^9/L': the power of ten touches the value
        digits, rest = glued[1], "10" + rest
    elif digits == "10" and re.match(r"\s?[\^*]\s?\d", rest):
        return None, ""
    power = re.match(r"^(\d{1,4})109(?=/l)", flat[m.start():])
    if power:
        digits, rest = power[1], "10^9" + flat[m.start() + power.end():]
    rest = re.sub(_FLAG, " ", rest, flags=re.I)
    return to_number(digits), rest.strip(" .;:,")


def to_number(digits: str) -> float | None:
    digits = digits.replace("·", ".")
    if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", digits):
        digits = digits.replace(",", "")
    elif re.fullmatch(r"[-+]?\d{1,3}(\.\d{3}){2,}(,\d+)?", digits):
        digits = digits.replace(".", "").replace(",", ".")
    else:
        digits = digits.replace(",", ".")
    try:
        return float(digits)
    except ValueError:
        return None


def split_range(text: str | None) -> tuple[float | None, float | None, str]:
    """Low and high of a typed range, and the text beside its numbers; one number alone is the high end."""
    if not text:
        return None, None, ""
    flat = re.sub(r"(?<=\d)\s*(?:-|–|—|to)\s*(?=\d)", " ~ ", plain(text).strip("()[] "))
    m = re.search(r"(\d[\d.,]*)(?: ~ (\d[\d.,]*))?", flat)
    if not m:
        return None, None, flat
    first, second, rest = to_number(m[1].rstrip(".,")), m[2] and to_number(m[2].rstrip(".,")), flat[m.end():].strip(" )(]")
    return (first, second, rest) if m[2] else (None, first, rest)


WRITTEN = T.StructType([
    T.StructField("value", T.DoubleType()), T.StructField("written_unit", T.StringType()),
    T.StructField("range_low", T.DoubleType()), T.StructField("range_high", T.DoubleType()),
])


def with_written_unit(items: DataFrame, units: UnitTable) -> DataFrame:
    """Adds field, value, written_unit, range_low, range_high to rows with testName, resultValue, units, referenceRange.

    A unit beside the value counts first, then ``units``, then ``referenceRange``; a text that names no unit of the field counts
    as none. Null or non-numeric results have a null value.
    """

    @F.pandas_udf(WRITTEN)
    def read(code: pd.Series, result: pd.Series, unit: pd.Series, ref: pd.Series) -> pd.DataFrame:
        memo: dict = {}

        def name(c, text):
            if (c, text) not in memo:
                memo[c, text] = units.read(c, text)
            return memo[c, text]

        out = []
        for c, r, u, g in zip(code, result, unit, ref):
            value, beside = split_value(r)
            low, high, tail = split_range(g)
            written = None if c is None or value is None else name(c, beside) or name(c, u) or name(c, tail)
            out.append((value, written, low, high))
        return pd.DataFrame(out, columns=["value", "written_unit", "range_low", "range_high"])

    coded = items.withColumn("field", field_code(F.col("testName")))
    return coded.withColumn("_w", read("field", "resultValue", "units", "referenceRange")).select(
        *[c for c in items.columns if c not in ("field", "value", "written_unit", "range_low", "range_high")], "field", "_w.*"
    )


def typical_ranges(written: DataFrame) -> DataFrame:
    """Median low and high of the ranges of each field and written unit: at most one row for each entry of the unit table."""
    return written.where("written_unit IS NOT NULL AND range_high IS NOT NULL").groupBy("field", "written_unit").agg(
        F.percentile_approx("range_low", 0.5).alias("low"), F.percentile_approx("range_high", 0.5).alias("high"), F.count("*").alias("n")
    )


def recorded_units(items: DataFrame, unit_table: DataFrame) -> DataFrame:
    """Numeric results with recorded unit and value in the field's common unit.

    Adds field, value, unit_code, source ('written', 'range' or 'default'), common_unit, common_value to the columns of ``items``.
    Rows without a number, and fields that are not in the unit table, are left out; columns of the added names are replaced. Where no unit is written, the range is held
    against the typical ranges of the field's units (those that rows with a written unit show, moved by the factors of the
    table): the unit with the nearest range counts, the common one on a tie or without a range.
    """
    units = UnitTable.of(unit_table)
    items = items.drop("field", "value", "unit_code", "source", "common_unit", "common_value", "_w", "_u", "_units")
    # read twice, for the typical ranges and for the rows; the texts are looked through once
    written = checkpointed(with_written_unit(items, units).where(F.col("value").isNotNull() & F.col("field").isin(*units.by_field)))
    typical: dict[str, tuple[float, float | None, float]] = {}
    for r in bounded_rows(typical_ranges(written), 10_000, "the typical ranges"):
        row = next(x for x in units.by_field[r.field] if x["unit_code"] == r.written_unit)
        high, low = r.high * row["factor"] + row["offset_add"], None if r.low is None else r.low * row["factor"] + row["offset_add"]
        if r.n > typical.get(r.field, (0, None, 0))[2] or r.field not in typical:
            typical[r.field] = (high, low, r.n)

    def entry(code: str, order: int, row: dict) -> tuple:
        high, low, _ = typical.get(code, (None, None, 0))
        back = lambda x: None if x is None else (x - row["offset_add"]) / row["factor"]
        return order, row["unit_code"], float(row["factor"]), float(row["offset_add"]), back(high), back(low)

    known = items.sparkSession.createDataFrame(
        [(code, units.common(code), [entry(code, k, r) for k, r in enumerate(rows)]) for code, rows in units.by_field.items()],
        "field string, common_unit string, _units array<struct<place int, unit_code string, factor double, shift double, high double, low double>>",
    )
    at_high, at_low = F.col("range_high"), F.when(F.col("range_low") > 0, F.col("range_low"))

    def by_range(u: Column) -> Column:  # the common unit has place 0 and wins ties
        low = F.when(u["low"] > 0, F.abs(F.log(at_low / u["low"])))
        far = F.abs(F.log(at_high / u["high"])) + F.coalesce(low, F.lit(0.0))
        return F.struct(F.round(F.coalesce(far, F.lit(0.0)), 3).alias("far"), u["place"].alias("place"), u["unit_code"].alias("unit_code"), u["factor"].alias("factor"), u["shift"].alias("shift"))

    nearest = F.array_min(F.transform("_units", by_range))
    first = lambda keep: F.get(F.transform(F.filter("_units", keep), lambda u: F.struct(F.lit(0.0).alias("far"), u["place"].alias("place"), u["unit_code"].alias("unit_code"), u["factor"].alias("factor"), u["shift"].alias("shift"))), F.lit(0))
    ranged = F.coalesce(at_high > 0, F.lit(False))
    is_written = F.col("written_unit").isNotNull()
    picked = F.when(is_written, first(lambda u: u["unit_code"] == F.col("written_unit"))).when(ranged, nearest).otherwise(first(lambda u: u["place"] == 0))
    source = F.when(is_written, "written").when(ranged, "range").otherwise("default")
    out = written.join(F.broadcast(known), "field").withColumn("_u", picked).withColumn("source", source)
    return out.withColumn("unit_code", F.col("_u.unit_code")).withColumn("common_value", F.col("value") * F.col("_u.factor") + F.col("_u.shift")).drop(
        "written_unit", "range_low", "range_high", "_units", "_u"
    )
