r"""Texts that stop before their end.

The self-join by prefix: the last sentence (or line) of a text is a value. All sentences of all texts, sorted, stand beside those
that begin with it, so one pass over the sorted values counts, for each end, its longer copies and its equal copies elsewhere. An
end with longer copies and hardly any equal ones was cut. Words and numbers are masked (digits as '#', terms of an open class as
'<t>'), so that copies with other figures meet. Texts without sentences (dictations) have no such values; there the last word is
held against longer words after the same word, by the same sorted pass, and the last words against the places where they stop
elsewhere. All rules are shares, smoothed with the share of shorter contexts; all counts are over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordered import chunked, with_total_before
from recordloom.operators.skew import bounded_rows, salted_join
from recordloom.session import checkpointed, written

# Marks that are put where a text was cut, damaged characters, and rests of character references.
CUT_MARK = re.compile(r"(?:\s*(?:\[\s*)?(?:…|\.{3,}|\[cut\]|\[truncated\]|\(truncated\)|<truncated>|\[continued\]|\(cont(?:\.|inued)?\)|\(more\)|\[more\]|(?<=\w)[-‐])\s*\]?)+\s*$")
DAMAGED = re.compile(r"(?:�|&#?[a-zA-Z0-9]{0,6};?|[\x00-\x08\x0b-\x1f]|Ã.?|Â|â€?)\s*$")
TOKEN = re.compile(r"\w+(?:['’\-]\w+)*|#+(?:[.,:/]#+)*|\n|[^\s]")
WRAPPED = re.compile(r"\n[ \t]*(?=[a-zß-ÿ])")  # a line break inside a sentence
STOP, LINE, TERM, TERM_BEGUN, PAIR = "\x02", "\x03", "<t>", "<", "\x04"
_MASK = bytes(35 if 48 <= k < 58 else 32 if k < 32 and k not in (9, 10) else k for k in range(256))  # digits and control characters
_LAST = "\U0010ffff"
CLOSED, NUMBER_END, IS_DAMAGED, MARKED = 1, 2, 4, 8
PRIOR, WEIGHT = 0.02, 20.0  # share of places where a text may stop, and the weight of a shorter context in that of a longer one
PARTS = pa.schema([
    ("kind", pa.string()), ("source", pa.string()), ("v", pa.string()), ("n", pa.int64()), ("stops", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()),
    ("other", pa.string()), ("pair", pa.string()), ("other_pair", pa.string()), ("g2", pa.int64()), ("g3", pa.int64()), ("g4", pa.int64()), ("flags", pa.int32()),
])


def stem(text: str) -> tuple[str, int]:
    """The text without cut marks and damaged characters at its end, and the flags of these."""
    text = text.rstrip()
    whole = text[:-16] + DAMAGED.sub("", text[-16:])
    flags = IS_DAMAGED if whole != text else 0
    if whole.endswith(("…", "...", "]", ")", ">", "-", "‐", " ")):
        bare = whole[:-200] + CUT_MARK.sub("", whole[-200:])
        return bare, flags | (MARKED if bare != whole else 0)
    return whole, flags


def segments(text: str, meaning: dict[str, str]) -> tuple[list[str], bool]:
    """The sentences and lines of a text as masked words with single blanks, and whether the last one ends in a stop."""
    flat = WRAPPED.sub(" ", text).lower().encode("utf-8", "replace").translate(_MASK).decode("utf-8")
    found = " ".join([meaning.get(w, w) for w in TOKEN.findall(flat)])
    return [s for s in (x.strip() for x in found.replace(LINE, STOP).split(STOP)) if s], found.endswith(STOP)


def _gram(source: str, words: list[str]) -> int:
    return xxhash.xxh64_intdigest(source + "\x1f" + " ".join(words)) - (1 << 63)


def parts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """The parts of each text of ``texts`` (source, text, t1, t2), summed up within batches.

    kind 'S': a sentence v that is complete, n times; or PAIR + word + PAIR + next word inside a sentence or line. 'G': a context of two,
    three or four words (hash in g2) of all sentences and lines, seen n times, of these ``stops`` at the end of one. 'E': the end v of a text, ``other`` if
    its last word may be a term begun, the pairs of its last words, its contexts, and flags.
    """
    known = frozenset(terms)
    begun = frozenset(t[:k] for t in known for k in range(1, len(t)))
    meaning = {t: TERM for t in known} | dict.fromkeys(".?!。؟", STOP) | {"\n": LINE}

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            inside: dict[str, tuple] = {}  # by source: counts of runs of two, three and four words, and of those where a stretch stops
            cut: Counter = Counter()
            out = []
            for source, text, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("source", "text", "t1", "t2"))):
                bare, flags = stem(text)
                found, closed = segments(bare, meaning)
                if not found:
                    continue
                last = found[-1]
                if closed:
                    flags |= CLOSED | (NUMBER_END if last.rpartition(" ")[2].startswith("#") else 0)
                complete = found if flags & (CLOSED | NUMBER_END) == CLOSED else found[:-1]
                seen.update(zip([source] * len(complete), complete))
                held = inside.setdefault(source, (Counter(), Counter(), Counter(), Counter()))
                for s in found:
                    words = ["^", "^", "^", *s.split(" ")]
                    for size in (2, 3, 4):
                        held[size - 2].update(zip(*(words[i:] for i in range(4 - size, 4))))
                        held[3][tuple(words[-size:])] += 1
                cut[source, words[-2], words[-1]] += 1
                frag = words[-1] in begun and words[-1] not in known
                pair = PAIR + words[-2] + PAIR
                out.append(("E", source, last, 1, 0, t1, t2, last[: len(last) - len(words[-1])] + TERM_BEGUN if frag else None, pair + words[-1], pair + TERM_BEGUN if frag else None, *(_gram(source, words[-size:]) for size in (2, 3, 4)), flags))
            out += [("S", source, v, n, *[None] * 10) for (source, v), n in seen.items()]
            for source, (*counts, stops) in inside.items():
                out += [("S", source, PAIR + a + PAIR + b, n - cut[source, a, b], *[None] * 10) for (a, b), n in counts[0].items() if n > cut[source, a, b]]
                out += [("G", None, None, n, stops.get(g, 0), None, None, None, None, None, _gram(source, g), None, None, None) for count in counts for g, n in count.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(PARTS), PARTS)], schema=PARTS)

    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'bigint'}" for f in PARTS)
    return texts.mapInArrow(cut_up, schema)


def copies(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, v, equal, longer, next_word) for each distinct (source, v) of ``asked``: how many of ``values`` (source, v, n) are
    equal to v, strictly longer with v as their prefix, and longer by whole words.

    The values are sorted once with probes before and behind each asked value; what stands between two probes begins with it. Runs
    of equal or alike values are cut into chunks like any others.
    """
    probes = {"a": "", "b": "\x00", "c": " ", "d": "!", "e": _LAST}
    rows = asked.select("source", "v").where("v IS NOT NULL").distinct()
    asking = rows.select("source", F.col("v").alias("of"), F.explode(F.array(*(F.struct(F.lit(k).alias("probe"), F.concat("v", F.lit(x)).alias("v")) for k, x in probes.items()))).alias("x"))
    both = values.groupBy("source", "v").agg(F.sum("n").alias("n")).select("source", "v", F.lit(1).alias("is_value"), "n", F.lit(None).cast("string").alias("of"), F.lit(None).cast("string").alias("probe"))
    both = both.unionByName(asking.select("source", "x.v", F.lit(0).alias("is_value"), F.lit(0).cast("bigint").alias("n"), "of", "x.probe"))
    order = ["v", "is_value", "of", "probe"]
    placed = with_total_before(chunked(both, "source", order), "source", order, F.col("n"), "before").where("is_value = 0")
    at = {k: F.max(F.when(F.col("probe") == k, F.col("before"))) for k in probes}
    return placed.groupBy("source", F.col("of").alias("v")).agg((at["b"] - at["a"]).alias("equal"), (at["e"] - at["b"]).alias("longer"), (at["d"] - at["c"]).alias("next_word"))


def text_keys(texts: DataFrame) -> DataFrame:
    """``texts`` (source, text) with t1 and t2, hashes of 96 bits that stand for source and text; null texts are left out."""
    source = F.coalesce("source", F.lit(""))
    return texts.where("text IS NOT NULL").withColumn("source", source).withColumns({"t1": F.xxhash64("source", "text"), "t2": F.crc32(F.encode("text", "UTF-8"))})


def cut_keys(texts: DataFrame, terms: DataFrame | None = None, least_rate: float = 0.016, least_whole: float = 0.05) -> DataFrame:
    """(t1, t2) of the distinct (source, text) whose text stops inside a word, a sentence or a line (see ``text_keys``).

    ``texts``: source, text; texts of one source are written alike, and their ends are held against each other. ``terms`` (column
    term, at most 20,000) are names of an open class, as of medicines: they count as one word.

    Damaged characters at the end, and a mark without a stop, tell that a text was cut. A text that ends with a stop is whole, but
    for a last number (it may have been cut at its decimal point). Of an open end, w equal copies that are complete, o other texts that end so (where the
    last word is a whole word elsewhere: texts cut at one place may be many, and must not vouch for each other) and l longer
    copies are counted. With w = 0 it is cut if its last word never stands complete after the word before while longer words do.
    Else with longer copies it is cut iff (w + o + WEIGHT p) / (w + o + l + WEIGHT) < ``least_whole``, where p is the
    share of the places after its last two, three and four words at which a text or sentence stops, each smoothed by the shorter.
    Without any copy it is cut iff p < ``least_rate``.
    Null and empty texts, and texts without letters, are whole. Copies of a text count once.
    """
    known = [] if terms is None else [r.term for r in bounded_rows(terms.select(F.lower("term").alias("term")).where("term IS NOT NULL").distinct(), 20_000, "the list of terms")]
    distinct = text_keys(texts.select(F.coalesce("source", F.lit("")).alias("source"), "text").where("text IS NOT NULL AND text <> ''").distinct())
    cut_up = written(parts(distinct.where(F.col("text").rlike(r"\p{L}")).select("source", "text", "t1", "t2"), known))
    ends = cut_up.where("kind = 'E'")
    is_open = F.col("flags").bitwiseAND(CLOSED) == 0
    number_end = F.col("flags").bitwiseAND(NUMBER_END) != 0
    judged = ends.where(is_open | number_end)
    forms = judged.select("source", F.explode(F.array("v", "other", "pair", "other_pair")).alias("v"))
    met = checkpointed(copies(cut_up.where("kind = 'S'"), forms).where("equal > 0 OR longer > 0"))

    # copies of one end are judged once
    by_end = judged.groupBy("source", "v", "other", "pair", "other_pair", "g2", "g3", "g4", (~is_open).alias("closed")).agg(F.count("*").alias("same"))
    kinds = {"v": "end", "other": "other", "pair": "pair", "other_pair": "other_pair"}
    for column, name in kinds.items():
        one = met.select("source", F.col("v").alias(column), F.struct("equal", "longer", "next_word").alias(f"c_{name}"))
        by_end = by_end.join(one, ["source", column], "left")
    grams = cut_up.where("kind = 'G'").groupBy("g2").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))
    asked = by_end.where("NOT closed").select(F.explode(F.array("g2", "g3", "g4")).alias("g2")).distinct()
    told = checkpointed(grams.join(asked, "g2"))
    for g in ("g2", "g3", "g4"):
        by_end = by_end.join(told.select(F.col("g2").alias(g), F.struct("n", "stops").alias(f"t_{g}")), g, "left")

    zero = F.lit(0)
    picked = F.when(F.col("c_end").isNull(), F.col("c_other")).otherwise(F.col("c_end"))
    w, longer = F.coalesce(picked["equal"], zero), F.coalesce(picked["longer"], zero)
    o = F.when((w > 0) | (F.coalesce(picked["next_word"], zero) > 0), F.col("same") - 1).otherwise(0)
    p = F.lit(PRIOR)
    for g in ("g2", "g3", "g4"):  # less this text's own end
        n, stops = F.greatest(F.coalesce(F.col(f"t_{g}.n"), zero) - 1, zero), F.greatest(F.coalesce(F.col(f"t_{g}.stops"), zero) - 1, zero)
        p = (stops + WEIGHT * p) / (n + WEIGHT)
    pair = F.when(F.col("c_pair").isNull(), F.col("c_other_pair")).otherwise(F.col("c_pair"))
    fragment = (F.coalesce(pair["equal"], zero) == 0) & (F.coalesce(pair["longer"], zero) > 0)
    goes_on = F.when((w == 0) & fragment, True).when(longer > 0, (w + o + WEIGHT * p) / (w + o + longer + WEIGHT) < least_whole).otherwise((w == 0) & (p < least_rate))
    goes_on = F.when(F.col("closed"), (longer > 0) & (w < least_whole * (w + longer))).otherwise(goes_on)
    ends_cut = by_end.select("source", "v", "closed", goes_on.alias("goes_on")).where("goes_on").drop("goes_on")
    marked = F.col("flags").bitwiseAND(IS_DAMAGED) != 0
    marked = marked | ((F.col("flags").bitwiseAND(MARKED) != 0) & is_open)
    by_copies = salted_join(judged.withColumn("closed", ~is_open), ends_cut, ["source", "v", "closed"], F.col("t1"), "left_semi")
    return ends.where(marked).select("t1", "t2").unionByName(by_copies.select("t1", "t2")).distinct()


def cut_texts(texts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(source, text) for each distinct pair whose text was cut (see ``cut_keys``)."""
    found = text_keys(texts.select("source", "text").distinct()).join(cut_keys(texts, terms), ["t1", "t2"], "left_semi")
    return found.select("source", "text")
