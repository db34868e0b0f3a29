r"""Personal data inside free text, found by bootstrapping.

1. Candidates: one pass over the distinct texts lists e-mail addresses, street addresses, numbers with their shape, and runs of words
   that may be names, each with the words around it (its patterns).
2. Seeds: numbers with an international or trunk prefix are phones, numbers beside the name of a paper are identity
   numbers, names with a title or with one of the frequent given names of the people on record are names, a house number with a
   kind of street is an address.
3. Spark scores the graph of patterns and instances in rounds: a pattern is as good as the share of its instances that count, an
   instance (the shape of a number, the words of a name) as good as the patterns it occurs with. What the patterns
   and the shape tell of a number goes before its own look. Numbers without a seed, names never seen and addresses without a kind
   of street are accepted where their pattern or instance is good enough.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.entities import clean_name
from recordloom.operators.skew import bounded_rows, salted_join
from recordloom.session import checkpointed

# Titles; names of papers and numbers of persons; kinds of streets; words that begin a place of work.
TITLES = r"(?:dr|mr|mrs|ms|miss|prof|smt|shri|sri|sr|sra|srta|mme|mlle|herr|frau|madam|sir|mx|don|doña|señora?|docteur|doctor|doctora)"
PAPERS = (
    r"mrn|national id|nid|n\.?i\.?d|id no|id number|id card|identity|passport|passeport|pasaporte|reisepass|pass-?nr|licen[cs]e|licencia|führerschein|permis|insurance|policy|police|póliza|versicherung\w*|assurance|"
    r"aadhaar|aadhar|ssn|social security|nhs|dni|nie|nif|cni|ausweis\w*|personalausweis|carte d'identité|sécurité sociale|seguridad social|record number|patient (?:id|no|number)|hospital (?:id|no|number)|medical record|"
    r"abha|pan|voter id|health card|member(?:ship)? (?:id|no|number)|patientennummer|numéro de dossier|número de historia|tax id|uhid"
)
STREETS = (
    r"street|st|road|rd|lane|ln|avenue|ave|av|crescent|cres|terrace|terr?|close|drive|dr|way|court|ct|place|pl|square|sq|gardens?|gdns|grove|hill|row|walk|parade|mews|quay|boulevard|blvd|"
    r"highway|hwy|nagar|marg|rise|view|park|wharf|alley|circus|green|bank|yard"
)
# Words of which one stands in every address that the patterns below find; ends of German street names.
STREET_WORDS = set(re.sub(r"\w\?", "", STREETS).split("|")) | set(
    "garden terr ter rue bd chemin impasse allée allee quai cours route passage ruelle sentier calle avenida avda plaza paseo camino carrera ronda travesía callejón c pza glorieta cuesta rambla am an auf zum zur unter hinter".split()
)
STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "damm", "ufer", "steig", "pfad", "chaussee", "stieg", "markt", "hof", "graben", "wall")
CLINIC = r"clinic|hospital|centre|center|practice|surgery|unit|polyclinic|institute|ward|pharmacy|department|laboratory|lab"
CLINIC_WORDS, TITLE_WORDS = set(CLINIC.split("|")), set(re.sub(r"\w\?|[(?:)]", "", TITLES).split("|")) | {"señora"}
EMAIL = re.compile(
    r"[\w.+\-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|<at>|＠)\s?[\w\-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?)[a-z\-]{2,24}){1,4}"
    r"|[\w.+\-]{2,64}(?:\s+dot\s+[\w+\-]{1,64}){0,3}\s+(?:at|\[at\]|\(at\)|@)\s+[\w\-]+\s+(?:dot|\[dot\]|\(dot\)|\.)\s+[a-z]{2,12}",
    re.I,
)
_W = r"[A-Za-zÀ-ÿ'’\-]+"
_HOUSE = re.compile(r"\b(?:no\.?|house|flat\s*\w+,?|apt\.?\s*\w+,?|plot|unit\s*\w+,?|h\.?\s?no\.?)\s*$", re.I)
ADDRESS = [
    re.compile(rf"(?<![\w.,])\d{{1,5}}(?:\s?[/\-]?\s?[A-Z]\b)?(?:/\d+)?,?\s+(?:(?:[A-Za-z]{{1,2}}\.|{_W})\s+){{1,3}}?(?:{STREETS})\b\.?(?!\s+(?:{CLINIC}|practice))", re.I),
    re.compile(r"\b[A-ZÄÖÜa-zäöüß][\w\-äöüß]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|steig|pfad|chaussee|stieg|markt|hof|graben|wall)\s+\d{1,4}\s?[a-z]?\b", re.I),
    re.compile(r"\b(?i:am|an der|an den|auf dem|zum|zur|unter den|hinter der)\s+[A-ZÄÖÜ][\w\-äöüß]+(?:\s+[A-ZÄÖÜ][\w\-äöüß]+)?\s+\d{1,4}\s?[a-z]?\b(?!\s*(?:uhr|mg|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember))"),
    re.compile(r"\b\d{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|allee|quai|cours|route|passage|square|ruelle|sentier)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*)*[\wÀ-ÿ'’\-]+(?-i:\s[A-ZÀ-Þ][\wÀ-ÿ'’\-]+)?", re.I),
    re.compile(r"\b(?:calle|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|ronda|travesía|callejón|c/|pza\.?|glorieta|cuesta|rambla)\s+(?:(?:de|del|la|las|los|el)\s+)*[\wÀ-ÿ'’\-]+(?:\s+[\wÀ-ÿ'’\-]+){0,2}?,?\s*(?:n[.ºo°]*\s*)?\d{1,4}\b", re.I),
]
HOUSE = re.compile(r"(?<![\w.,/\-])\d{1,4}(?:\s?[/\-]?\s?[A-Z]\b)?,?\s(?:[A-ZÀ-ÖØ-Þ][\w'’\-]{2,}\b\s?){1,3}(?<!\s)(?![\w/])")
NUMBER = re.compile(r"(?<![\w.,/])[+(]?\d[\d\s().\-/]{0,40}(?:[A-Za-z]{1,2}\d[\d\-]{0,20})?\d(?:-?[A-Za-z]\b)?(?!\w|[.,]\d)|(?<![\w.,])[A-Za-z]{1,5}[-/ ]{0,2}\d[\d\s().\-/]{2,40}\d(?:-?[A-Za-z]\b)?(?!\w|[.,]\d)")
_DIGIT = re.compile(r"\d")
_SIX_DIGITS = re.compile(r"\d(?:\D{0,4}\d){5}")
_MR = re.compile(TITLES, re.I)
_GAP = re.compile(r"\.?[^\S\n]+")
_COMMA = re.compile(r",\s*")
_DOT_GAP = re.compile(r"\.\s")
_DATE = re.compile(r"[\d\s]*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}")
_PREFIX = re.compile(r"[A-Za-z]{1,5}(?=[-/ ]{0,2}[+(]?\d)")
_CHART = re.compile(r"(?:pt|mrn)[-/ o]{0,2}\d", re.I)
_PLACE = re.compile(rf"\b(?:{CLINIC})\b")  # of words in lower case
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?|\d+|[^\w\s]")
_PAPER = re.compile(rf"(?:\b|^)(?:{PAPERS})\b(?:\s+(?:number|no|nr|num|card|id|código|nummer))?[\s.:#°º\-]*$", re.I)
# Words that begin sentences and are no names.
PLAIN = set(
    "both and but the this that these is was were did has have had does do can could please why when what which who how where are there any show list draft explain compare summarise spoke name copy deliver send next "
    "bitte akte historia dossier merci por wohnhaft vive readings recent deliver card chart copied form lot ward seen see hello good dear thanks known according before after since two three yes no not for from with she he they we you my his her our your it its in on at to of as".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LIKE_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’\-]+$")

# Words after a number that show a measure or a sentence and no street.
NO_STREET = PLAIN - {"end"} | set(
    "mg g kg ml mcg l dl mmol cm mm percent week weeks day days hour hours minute minutes month months year years visit visits times tablets tablet dose doses january february march april may june july august september october november december "
    "asked page am pm uhr mal a an by is".split()
)


MONTHS = {m[:k] for m in "january february march april may june july august september october november december".split() for k in range(3, len(m) + 1)}


def _around(text: str, start: int, end: int, far: int = 2) -> tuple[str, str]:
    """The tokens before (``far``) and after a span (2), in lower case, numbers as '#'; '^' and '$' beyond the text."""
    left = [_fold(w) for w in _TOKEN.findall(text[max(0, start - 12 * far) : start])[-far:]]
    right = [_fold(w) for w in _TOKEN.findall(text[end : end + 24])[:2]]
    return " ".join(["^"] * (far - len(left)) + left), " ".join(right + ["$"] * (2 - len(right)))


@functools.lru_cache(maxsize=100_000)
def _fold(w: str) -> str:
    return "#" if w.isdigit() else w.lower().rstrip(".") or w


def shape(number: str) -> str:
    """The shape of a number: digits 9, letters A, runs of blanks one blank."""
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", number.strip())))


def _phone_like(number: str) -> bool:
    digits = re.sub(r"\D", "", number)
    if re.search(r"[A-Za-z]", number) or not 9 <= len(digits) <= 15:
        return False
    return bool(re.match(r"\s*\+\d", number)) or digits.startswith("00") or (re.match(r"\s*\(?0", number) is not None and 10 <= len(digits) <= 11)


def candidates(text: str, given: frozenset[str]) -> list[tuple]:
    """(kind, start, end, instance, left, right, seed) of a text; seed is the type that is certain, or ''.

    Kinds: 'E' e-mail, 'A' address, 'N' number, 'P' name. A name's instance is its longest word, a number's its shape.
    """
    out, taken = [], []

    def free(s, e):
        return all(e <= a or s >= b for a, b in taken)

    def add(kind, s, e, instance, seed):
        out.append((kind, s, e, instance, *_around(text, s, e, 4 if kind == "N" else 2), seed))

    words = [(*m.span(), m[0]) for m in _WORD.finditer(text)]
    lows = [w[2].lower() for w in words]
    met = set(lows)
    if "@" in text or "＠" in text or "at" in met:
        for m in EMAIL.finditer(text):
            taken.append(m.span())
            add("E", *m.span(), "", "EMAIL")
    if _DIGIT.search(text):
        for pattern in ADDRESS if not met.isdisjoint(STREET_WORDS) or any(w.endswith(STREET_ENDS) for w in met) else ():
            for m in pattern.finditer(text):
                s, e = m.span()
                if free(s, e) and not (pattern is ADDRESS[0] and any(len(w) > 1 and w in NO_STREET for w in _WORD.findall(m[0].lower())[:-1])):
                    if house := _HOUSE.search(text[max(0, s - 16) : s]):
                        s -= len(house[0])
                    taken.append((s, e))
                    add("A", s, e, "", "ADDRESS")
        for m in HOUSE.finditer(text):  # perhaps an address without a kind of street
            s, e = m.span()
            if free(s, e) and not any(w in NO_STREET or w in MONTHS for w in _WORD.findall(m[0].lower())):
                add("A", s, e, "", "")
    for m in NUMBER.finditer(text) if _SIX_DIGITS.search(text) else ():
        s, e = m.span()
        piece = m[0]
        word = _PREFIX.match(piece)
        if word and " " in piece[: word.end() + 1] and not (word[0].isupper() and len(word[0]) <= 3 and word[0].lower() not in ("mg", "no", "nr", "id")):
            s += word.end()
            piece = text[s:e]
            s += len(piece) - len(piece.lstrip(" -/"))
            piece = text[s:e]
        digits = re.sub(r"\D", "", piece)
        if len(digits) < 6 or not free(s, e) or _DATE.fullmatch(piece):
            continue
        before = text[max(0, s - 40) : s]
        seed = "ID_NUMBER" if _PAPER.search(before) or _CHART.match(piece) else "PHONE" if _phone_like(piece) else ""
        taken.append((s, e))
        add("N", s, e, shape(piece), seed)
    if taken:
        words = [w for w in words if free(w[0], w[1])]
        lows = [w[2].lower() for w in words]
    is_given = lambda low: low in given or ("-" in low and any(p in given for p in low.split("-")))
    n_words, done = len(words), 0
    for k in [k for k, low in enumerate(lows) if words[k][2][0] != low[0] and low not in PLAIN or low in given or len(low) == 1 or "-" in low]:
        if k < done:
            continue
        s, e, w = words[k]
        low = lows[k]
        upper = w[0].isupper()
        known = low in given or ("-" in low and is_given(low))
        if not known:
            if not upper and not (len(w) == 1 and text[e : e + 1] == "."):
                continue
            after = words[k + 1][2] if k + 1 < n_words else "-"
            if len(w) > 2 and not after[0].isupper() and len(after) > 1 and low not in TITLE_WORDS and "-" not in after and lows[k + 1 if k + 1 < n_words else k] not in given:
                if low not in PLAIN and low not in CLINIC_WORDS:  # a word alone
                    add("P", s, e, low, "")
                continue
        titled = upper and len(w) < 9 and _MR.fullmatch(low) is not None and k + 1 < n_words and _GAP.fullmatch(text, e, words[k + 1][0]) is not None
        capital = upper and len(w) > 1 and low not in PLAIN
        initial = len(w) == 1 and text[e : e + 1] == "." and k + 1 < n_words and words[k + 1][0] - e <= 2 and len(words[k + 1][2]) > 3
        if not (titled or known or capital or initial):
            continue
        j, parts, seed = k, [], known or titled
        if titled:
            j += 1
        while j < n_words:
            s2, e2, w2 = words[j]
            low2 = w2.lower()
            if j > k:
                last_end, last = words[j - 1][1], words[j - 1][2]
                if not _GAP.fullmatch(text, last_end, s2) and not (low2 in given and _COMMA.fullmatch(text, last_end, s2)):
                    break
                if len(last) > 1 and text[last_end] == "." and not (titled and j == k + 1):
                    break
                if low2 in PLAIN and not is_given(low2):
                    break
                after_initial = len(last) == 1 and text[last_end] == "." and len(w2) > 3
            else:
                after_initial = False
            ok = (
                w2[0].isupper() or (len(w2) == 1 and text[e2 : e2 + 1] == ".") or is_given(low2) or after_initial
                or (titled and j == k + 1 and len(w2) > 3)
            )
            if not ok:
                break
            seed = seed or low2 in given
            parts.append(low2)
            j += 1
        if not parts:
            continue
        end = words[j - 1][1]
        longest = max(parts, key=len)
        if len(longest) > 2:
            after = words[j][2] if j < n_words and words[j][0] - end == 1 else ""
            if not _PLACE.search(" ".join(parts)) and not (after[:1].isupper() and _PLACE.fullmatch(after.lower())):
                add("P", s, end, longest, "NAME" if seed else "")
            elif seed and any(p in given for p in parts):
                add("P", s, end, longest, "")
        done = j
    return out


def frequent_given_names(names: DataFrame, share: float = 0.001) -> frozenset[str]:
    """Words that make up at least ``share`` of all words of the ``names`` (column name): at most 1 / share words, whatever the data."""
    words = names.where("name IS NOT NULL").select(F.explode(F.split(clean_name(F.col("name")), " ")).alias("word")).where("length(word) > 2")
    total = words.agg(F.count("*").alias("all"))  # one row
    often = words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") >= share * F.col("all"))
    return frozenset(r.word for r in bounded_rows(often.select("word"), int(1 / share) + 1, "the frequent names"))


FOUND = pa.schema([
    ("t1", pa.int64()), ("t2", pa.int64()), ("uses", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("left", pa.string()), ("right", pa.string()), ("seed", pa.string()),
])
TYPES = {"PHONE": "phone", "ID_NUMBER": "paper", "NAME": "person", "ADDRESS": "address"}
LEAST_SHAPE = 0.9  # share of the numbers of one shape that must count before the shape alone tells what a number is


def text_keys(texts: DataFrame) -> DataFrame:
    """``texts`` with t1 and t2, hashes of 96 bits that stand for the text; null and empty texts are left out."""
    return texts.where("text IS NOT NULL AND text <> ''").withColumns({"t1": F.xxhash64("text"), "t2": F.crc32(F.encode("text", "UTF-8"))})


def candidate_spans(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    """The candidates of each distinct text (see ``candidates``) with t1 and t2 of the text and the number of its rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for text, *keys in zip(*(rows.column(c).to_pylist() for c in ("text", "t1", "t2", "uses"))):
                out += [(*keys, *c) for c in candidates(text, given)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(FOUND), FOUND)], schema=FOUND)

    unique = text_keys(texts.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.count("*").alias("uses")))
    return unique.select("text", "t1", "t2", "uses").mapInArrow(find, "t1 bigint, t2 bigint, uses bigint, kind string, start int, end int, instance string, left string, right string, seed string")


def _edge() -> Column:
    return F.xxhash64("kind", "instance", "left", "right")


def _shares(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """For each key the number of occurrences and the share of them that count, by type."""
    sums = df.groupBy(*keys).agg(F.sum("n").alias("all"), *(F.sum(f"mass_{c}").alias(f"m_{c}") for c in names.values()))
    return sums.select(*keys, "all", *(((F.col(f"m_{c}") - 0.5) / F.col("all")).alias(f"p_{c}") for c in names.values()))


def believed_edges(edges: DataFrame, rounds: int, least: float) -> DataFrame:
    """(edge, p_phone, p_paper, p_person, p_address): the edges that count for some type after ``rounds`` rounds.

    ``edges``: edge, kind, instance, left, right, n, seed_*: occurrences of an instance between two patterns. A
    number or an address is judged by what stands before it, a name also by what stands after it; marks alone tell nothing on
    names. The words of a name, and the shape of a number where nearly all numbers of the shape count, speak too; a word that
    mostly stands where no names stand is no name.
    """
    near = F.substring_index("left", " ", -2)
    # what stands before the name of a paper, of one word or two, is a pattern too: it leads to names of papers not yet known
    frames = F.array(F.concat(F.lit("F "), F.substring_index("left", " ", 2)), F.concat(F.lit("F "), F.substring_index(F.substring_index("left", " ", 3), " ", -2)))
    before = F.concat(
        F.array(F.concat(F.lit("L "), near), F.concat(F.lit("M "), F.substring_index("left", " ", -1))),
        F.when(F.col("kind") == "N", F.filter(F.array_distinct(frames), lambda x: F.substring(x, 3, 1000).rlike(r"\p{L}{2}"))).otherwise(F.array().cast("array<string>")),
    )
    both = F.concat_ws(" ", F.substring_index("left", " ", -1), F.lit("|"), F.substring_index("right", " ", 1))
    about = F.filter(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"), F.concat(F.lit("B "), both)), lambda x: F.substring(x, 3, 1000).rlike(r"\p{L}{2}"))
    patterns = F.when(F.col("kind") == "P", about).otherwise(before)
    links = checkpointed(edges.select("edge", F.explode(F.transform(patterns, lambda x: F.xxhash64("kind", x))).alias("pattern")))
    columns = [f"p_{c}" for c in TYPES.values()]
    counts = lambda df, least: df.where(functools.reduce(Column.__or__, (F.col(c) >= least for c in columns)))
    rest = F.col("n") - sum((F.col(f"seed_{c}") for c in TYPES.values()), F.lit(0))
    believed = edges.select("edge", *(F.lit(0.0).alias(c) for c in columns)).limit(0)
    for _ in range(rounds):
        massed = checkpointed(edges.join(believed, "edge", "left").select(
            "edge", "kind", "instance", "n", *((F.col(f"seed_{c}") + rest * F.when(F.col(f"p_{c}") >= least, F.col(f"p_{c}")).otherwise(0.0)).alias(f"mass_{c}") for c in TYPES.values())
        ))
        # only patterns and instances that reach the threshold can lift an edge over it, and these are few
        good = counts(_shares(links.join(massed, "edge"), ["pattern"], TYPES).where("all >= 4"), least).drop("all")
        shapes = _shares(massed, ["kind", "instance"], TYPES)
        is_name = F.col("kind") == "P"
        telling = counts(shapes.where(is_name), least).unionByName(counts(shapes.where((F.col("kind") == "N") & (F.col("all") >= 20)), LEAST_SHAPE)).drop("all")
        by_pattern = links.join(good, "pattern").select("edge", *columns)
        by_shape = massed.select("edge", "kind", "instance").join(telling, ["kind", "instance"]).select("edge", *columns)
        raised = counts(by_pattern.unionByName(by_shape).groupBy("edge").agg(*(F.max(c).alias(c) for c in columns)), least)
        ordinary = shapes.where(is_name & (F.col("all") >= 5) & (F.col("p_person") < 0.2)).select("kind", "instance")
        named = raised.join(massed.select("edge", "kind", "instance"), "edge")
        believed = checkpointed(named.join(ordinary, ["kind", "instance"], "left_anti").select("edge", *columns))
    return believed


def text_spans(texts: DataFrame, names: DataFrame, rounds: int = 3, least: float = 0.5) -> DataFrame:
    """(t1, t2, start, end, pii_type) of the personal data in the distinct texts of ``texts`` (see ``text_keys``)."""
    spans = checkpointed(candidate_spans(texts, frequent_given_names(names)))
    seeds = [F.sum(F.when(F.col("seed") == t, F.col("uses")).otherwise(0).cast("double")).alias(f"seed_{c}") for t, c in TYPES.items()]
    edges = spans.where("kind <> 'E'").groupBy("kind", "instance", "left", "right").agg(F.sum("uses").alias("n"), *seeds)
    believed = believed_edges(checkpointed(edges.withColumn("edge", _edge())), rounds, least)
    best = F.array_max(F.array(*(F.struct(F.col(f"p_{c}").alias("p"), F.lit(t).alias("t")) for t, c in TYPES.items())))
    judged = spans.where("seed = '' OR kind = 'N'").withColumn("edge", _edge()).join(believed.select("edge", best["t"].alias("learned")), "edge", "left")
    # what the patterns tell of a number goes before its own look
    kind = F.coalesce("learned", F.when(F.col("seed") != "", F.col("seed")))
    found = judged.select("t1", "t2", "start", "end", kind.alias("pii_type")).where("pii_type IS NOT NULL")
    return found.unionByName(spans.where("seed <> '' AND kind <> 'N'").select("t1", "t2", "start", "end", F.col("seed").alias("pii_type")))


def personal_spans(texts: DataFrame, names: DataFrame, rounds: int = 3, least: float = 0.5) -> DataFrame:
    """(table_name, row_id, field_name, start, end, pii_type) of the personal data in ``texts``.

    ``texts``: table_name, row_id, field_name, text; ``names``: name, the people on record, whose frequent words are the seeds for
    names. Null and empty texts hold nothing; repeated rows come out once; copies of a text are looked through once.
    """
    by_text = text_spans(texts, names, rounds, least).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end", "pii_type")).alias("x"))
    keyed = text_keys(texts).select("table_name", "row_id", "field_name", "t1", "t2").distinct()
    return salted_join(keyed, by_text, ["t1", "t2"], F.col("row_id"), salts=8).select("table_name", "row_id", "field_name", F.explode("x").alias("x")).select("table_name", "row_id", "field_name", "x.*")


def personal_types(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, pii_type): the types of personal data in each row of ``texts``, once."""
    by_text = text_spans(texts, names).groupBy("t1", "t2").agg(F.collect_set("pii_type").alias("x"))
    keyed = text_keys(texts).select("table_name", "row_id", "field_name", "t1", "t2")
    found = salted_join(keyed, by_text, ["t1", "t2"], F.col("row_id"), salts=8)
    return found.select("table_name", "row_id", "field_name", F.explode("x").alias("pii_type")).distinct()


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with each span replaced by its type in square brackets; spans that touch or overlap become one placeholder."""

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spots in zip(text, found):
            if t is None or spots is None or len(spots) == 0:
                out.append(t)
                continue
            pieces, at = [], 0
            for s in sorted(spots, key=lambda s: (s["start"], -s["end"])):
                if s["start"] < at or (pieces and s["start"] == at):
                    at = max(at, s["end"])
                    continue
                pieces += [t[at : s["start"]], f"[{s['pii_type']}]"]
                at = s["end"]
            out.append("".join(pieces) + t[at:])
        return pd.Series(out, dtype="object")

    by_text = spans.groupBy("table_name", "row_id", "field_name").agg(F.collect_list(F.struct("start", "end", "pii_type")).alias("found"))
    joined = texts.select("table_name", "row_id", "field_name", "text").distinct().join(by_text, ["table_name", "row_id", "field_name"], "left")
    return joined.select("table_name", "row_id", "field_name", replace("text", "found").alias("text"))
