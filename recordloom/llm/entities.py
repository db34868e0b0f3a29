"""Variants of names that refer to one entity.

Names become vectors of character trigrams weighted by their rarity. The sparse cosine join runs over (context, trigram), where a
context is a second field that the two rows share: birth date, phone, or record number but for one slip. Every pair above
the threshold is kept, so there is no top n to lose one, and hot keys are split. Pairs are scored on their cosine and all fields and grouped by average-linkage clustering, carried out as rounds of joins
that merge all pairs of mutually nearest clusters.
"""

from __future__ import annotations

import datetime
import itertools
import operator
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from recordloom.llm.names import ALIKE, CHEAP, _strip_accents, weighted_distance
from recordloom.session import checkpointed

#: Rows of one key of the self-join that one task may hold on one side; larger keys are split, and no pair is lost.
SPLIT = 500
#: Larger keys, at most, that are sent to all tasks; more are joined by a shuffle.
SENT_KEYS = 100_000
LEAST_COSINE = 0.2
# Titles and suffixes that are no part of a name.
TITLES = "mr|mrs|ms|miss|dr|prof|smt|shri|sri|sr|sra|mme|mlle|m lle|herr|frau|kumari|master|baby|md|phd|jr|senior|junior|mx|sir|madam"
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha xander lex sandy al", "alexandra": "alex sandra lexi", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davy", "dmitri": "dima dimitri mitya", "dimitri": "dima mitya", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth eliza lizzie betty libby lisa", "esperanza": "espe",
    "frederick": "fred freddie", "gabriela": "gaby gabi", "gabriel": "gabe", "george": "georgie", "gregory": "greg", "harold": "harry hal", "henry": "harry hank", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "katherine": "kate kathy katie kat kit", "kenneth": "ken kenny",
    "lawrence": "larry", "leonard": "leo len", "margaret": "maggie meg peggy marge rita", "maria": "mia", "matthew": "matt matty", "michael": "mike mick mikey", "nicholas": "nick nicky", "nalini": "nal", "oksana": "oksy", "olivia": "liv livvy",
    "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "philippa": "pippa pip", "quentin": "quin", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samantha": "sam", "samuel": "sam sammy", "stephanie": "steph steffi", "stephen": "steve", "steven": "steve", "susan": "sue susie suzie", "tamsin": "tam tammy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim",
    "victoria": "vicky tori vic", "vincent": "vince", "virginia": "ginny", "walter": "walt", "william": "bill will billy liam willy", "zachary": "zach zack", "abigail": "abby gail", "amanda": "mandy", "barbara": "barb", "catherine": "cathy kate cat",
    "deborah": "deb debbie", "dorothy": "dot dolly", "eleanor": "ellie nell nora", "emily": "em emmy", "farid": "fred", "ismail": "ish", "kavita": "kavi", "leila": "lee", "mateo": "teo", "meenal": "meenu", "mireille": "mimi", "hortense": "hortie",
    "padma": "paddy", "ravindra": "ravi", "suresh": "suri", "tariq": "tari", "celeste": "cel", "bogdan": "bogie", "ingrid": "inga", "anaya": "anu", "francis": "frank", "francisco": "paco pancho frank cisco", "lorenzo": "enzo larry", "jose": "pepe", "gunnar": "gunni", "haruki": "haru", "odette": "odi", "yusra": "yus", "franklin": "frank", "raymond": "ray", "donald": "don", "douglas": "doug",
}
_FORMAL: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_full)


def clean_name(name: Column) -> Column:
    """Lower case without accents, titles, digits and marks; look-alike digits inside words count as letters."""
    apart = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")  # words typed without a blank
    text = F.translate(_strip_accents(F.lower(apart)), "0158", "olsb")
    text = F.regexp_replace(text, r"[^a-z]+", " ")
    return F.trim(F.regexp_replace(text, rf"\b(?:{TITLES})\b", " "))


def folded_name(name: Column) -> Column:
    for a, b in ALIKE:
        if a.isalpha():
            name = F.replace(name, F.lit(a), F.lit(b))
    return F.regexp_replace(name, r"([a-z])\1", "$1")


def record_number(mrn: Column) -> Column:
    """Digits of a typed record number; letters that stand for digits count as these; null where none is left."""
    text = F.regexp_replace(F.regexp_replace(F.upper(mrn), r"[^A-Z0-9]", ""), "^(?:PT|MRN|P|ID)+", "")
    digits = F.regexp_replace(F.translate(text, "OILSB", "01158"), "[^0-9]", "")
    return F.when(F.length(digits) > 0, digits)


def phone_number(phone: Column) -> Column:
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def _same_slip(a: str, b: str) -> bool:
    """Equal but for one slip: a digit exchanged, dropped, added, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        return len(diff) == 1 or (len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])
    if abs(len(a) - len(b)) == 1:
        if len(a) > len(b):
            a, b = b, a
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    return False


def _letter_classes() -> dict[str, int]:
    """Letters that cheap exchanges can turn into each other, directly or over others, have one number."""
    classes = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}
    for p, q in map(sorted, CHEAP):
        classes = {c: classes[p] if k == classes[q] else k for c, k in classes.items()}
    numbers = {k: n for n, k in enumerate(sorted(set(classes.values())))}
    return {c: numbers[k] for c, k in classes.items()}


_CLASS = _letter_classes()


@lru_cache(maxsize=200_000)
def _class_counts(word: str) -> tuple[int, ...]:
    counts = [0] * (max(_CLASS.values()) + 2)
    for c in word:
        counts[_CLASS.get(c, -1)] += 1
    return tuple(counts)


def distance_within(a: str, b: str, limit: float) -> float:
    """``weighted_distance``, or some number above ``limit`` where it is above that: a letter too many in a class costs 0.5 at least."""
    least = 0.5 * sum(map(abs, map(operator.sub, _class_counts(a), _class_counts(b))))
    return least if least > limit else weighted_distance(a, b)


@lru_cache(maxsize=200_000)
def word_likeness(a: str, b: str) -> float:
    """1 for equal words, less for short forms, initials and slips, 0 for different words."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.8 if b[0] == a else 0.0
    if b in _FORMAL.get(a, ()) or a in _FORMAL.get(b, ()) or (_FORMAL.get(a, set()) & _FORMAL.get(b, set())):
        return 0.9
    if len(a) >= 3 and b.startswith(a):
        return 0.88
    longest = len(b)
    if longest > 60 or longest - len(a) > 3:
        return 0.0
    d = distance_within(a, b, 3.0 if longest >= 9 else 2.3 if longest >= 6 else 1.25)
    if d <= 1.25 and longest >= 4:
        return 0.92
    if d <= 2.3 and longest >= 6:
        return 0.82
    if d <= 3.0 and longest >= 9:
        return 0.7
    return 0.0


@lru_cache(maxsize=200_000)
def name_likeness(a: str, b: str) -> tuple[float, float]:
    """(likeness of the whole names in 0..1, share of it that rests on initials), order of the words aside.

    A name of one long word is also tried as two words, in case the blank was left out.
    """
    x, y = a.split(), b.split()
    best = _words_likeness(x, y)
    if best[0] < 0.78:
        for one, other in ((x, y), (y, x)):
            if len(one) == 1 and 8 <= len(one[0]) <= 60 and 2 <= len(other) <= 12:
                best = max([best, *(_words_likeness([one[0][:i], one[0][i:]], other) for i in range(2, len(one[0]) - 2))])
    return best


def _words_likeness(x: list[str], y: list[str]) -> tuple[float, float]:
    if not x or not y:
        return 0.0, 0.0
    if sorted(x) == sorted(y):
        return 1.0, 0.0
    if len(x) > 12 or len(y) > 12:  # no name of a person; equal or nothing
        return (1.0, 0.0) if x == y else (0.0, 0.0)
    ties = sorted(((word_likeness(p, q), i, j) for i, p in enumerate(x) for j, q in enumerate(y)), reverse=True)
    left, right, got, by_initial, met = set(range(len(x))), set(range(len(y))), 0.0, 0, 0
    for s, i, j in ties:
        if s > 0 and i in left and j in right:
            left.discard(i)
            right.discard(j)
            met += 1
            if min(len(x[i]), len(y[j])) == 1:
                by_initial += max(len(x[i]), len(y[j])) > 1
            got += s
    lone = [w for w in [x[i] for i in left] + [y[j] for j in right]]
    left_over = sum(0.1 if len(w) == 1 else 1.0 for w in lone)
    if left and right and any(len(x[i]) > 1 for i in left) and any(len(y[j]) > 1 for j in right):
        left_over += 1.0  # both have a word that the other lacks
    elif lone and met >= 2:
        left_over *= 0.5  # one name has words more
    score = max(0.0, got - left_over) / max(1, met)
    whole, other = "".join(x), "".join(y)
    if score < 0.8 and 8 <= len(whole) <= 200 and abs(len(whole) - len(other)) <= 3 and (joined := distance_within(whole, other, 2.5)) <= 2.5:
        score, by_initial = max(score, 0.85 if joined <= 1.5 else 0.78), 0
    return min(1.0, score), by_initial / max(1, met)


def date_likeness(a, b) -> str:
    if a is None or b is None or pd.isna(a) or pd.isna(b):
        return "missing"
    p, q = (a.year, a.month, a.day), (b.year, b.month, b.day)
    if p == q:
        return "same"
    if p[0] == q[0] and p[1] == q[2] and p[2] == q[1]:
        return "near"
    apart = abs((a - b).days)
    if abs(apart - 365.25) <= 2 or abs(apart - 3652.5) <= 3:  # a year or ten years off
        return "near"
    differ = [k for k in range(3) if p[k] != q[k]]
    if len(differ) == 1:
        k = differ[0]
        return "near" if k > 0 or abs(p[0] - q[0]) <= 1 or str(p[0])[:2] + str(p[0])[:1:-1] == str(q[0]) or abs(p[0] - q[0]) in (10, 100) else "other"
    return "other"


def name_points(name_a, name_b, cosine=1.0) -> float:
    """Words of names are held against each other; the cosine of the whole names weighs in where that leaves doubt."""
    likeness, initials = name_likeness(name_a or "", name_b or "")
    if likeness >= 0.78:
        return 3.0 if not initials else 1.7
    return 0.8 + 2.0 * (cosine - 0.5) if likeness >= 0.6 else -4.0


def pair_score(name_a, name_b, birth_a, birth_b, mrn_a, mrn_b, phone_a, phone_b, sex_a, sex_b, cosine=1.0) -> float:
    """Evidence that two rows are one person, as a number in 0..1; 0.4 and more speaks for it."""
    points = name_points(name_a, name_b, cosine)
    born = date_likeness(birth_a, birth_b)
    points += {"same": 3.0, "near": 1.2, "missing": 0.0, "other": -3.5}[born]
    if mrn_a and mrn_b:
        points += 5.0 if mrn_a == mrn_b else 3.5 if _same_slip(mrn_a, mrn_b) else -0.5
    if phone_a and phone_b:
        points += 2.5 if phone_a == phone_b else 1.5 if _same_slip(phone_a, phone_b) else -0.5
    if sex_a in ("m", "f") and sex_b in ("m", "f") and sex_a != sex_b:
        points -= 1.5
    return max(0.0, min(1.0, points / 8.0))


def name_vectors(people: DataFrame) -> DataFrame:
    """(id, gram, v): the trigrams of each folded name with their weights, each name's vector of length one."""
    padded = F.transform(F.filter(F.split("folded", " "), lambda w: w != ""), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))))
    each = people.select("id", F.explode(grams).alias("gram"))
    n_rows = people.agg(F.count("*").alias("n_rows"))  # one row
    weight = each.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n_rows)).select("gram", (F.log(F.col("n_rows") / F.col("df")) + 1).alias("w"))
    weighed = each.join(F.broadcast(weight), "gram")  # at most 28 ** 3 trigrams of a to z, ^ and $
    listed = weighed.groupBy("id").agg(F.collect_list(F.struct("gram", "w")).alias("g"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select("id", "norm", F.explode("g").alias("g")).select("id", F.xxhash64("g.gram").alias("gram"), (F.col("g.w") / F.col("norm")).alias("v"))


def met(keyed: DataFrame, also: list[str], others: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Each two ids a < b that share a key, once for each shared key; ``keyed``: key, id and the columns ``also``, which come out with
    the endings _a and _b. With ``others`` (like ``keyed``) a is of ``keyed``, b of ``others``, and either may be the smaller. The rows of a key with more than
    SPLIT of them are spread over as many tasks as that asks for, against copies of the others. Such keys are looked for among the rows ``counted``,
    if that is given: those of ``keyed`` that can have one.

    Rows come from explode, which Spark's estimate of sizes leaves out, so neither side may be broadcast.
    """
    counted = keyed if counted is None else counted
    hot = checkpointed(counted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    n_hot = hot.count()
    left = keyed.select("key", F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in also))
    right = (keyed if others is None else others).select("key", F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in also))
    on = ["key"]
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= SENT_KEYS else hot.hint("merge")
        left, right = (x.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (left, right))
        left = left.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        on = ["key", "part"]
    return left.join(right.hint("merge"), on).where("a < b" if others is None else "a <> b")


@F.pandas_udf(ArrayType(StringType()))
def _word_keys(names: pd.Series) -> pd.Series:
    """What alike words have in common: beginning or end, what one deletion leaves of a short word, the beginnings of full names."""

    def of(word: str) -> set[str]:
        keys = {x[:3] for x in (word, *_FORMAL.get(word, ()))}
        w = word
        for a, b in ALIKE:
            w = w.replace(a, b) if a.isalpha() else w
        w = re.sub(r"(.)\1", r"\1", w)
        keys |= {w[:3]} | ({"$" + w[-3:]} if len(w) >= 7 else set())
        return keys | ({"~" + w} | {"~" + w[:i] + w[i + 1 :] for i in range(len(w))} if 3 <= len(w) <= 7 else set())

    return names.map(lambda name: sorted(set().union(*(of(w) for w in name.split() if len(w) > 1))) if name else [])


def one_slip(text: str) -> Column:
    """Hashes of a string and of all that one deletion leaves of it: strings that differ by one slip share one."""
    dropped = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(F.col(text), i + 1, F.length(text))))
    return F.transform(F.array_distinct(F.concat(F.array(text), dropped)), lambda x: F.xxhash64(x))


def slipped(people: DataFrame, field: str) -> DataFrame:
    """(slip, id) for the rows whose ``field`` equals that of another row but for one slip."""
    slips = people.where(F.col(field).isNotNull()).select("id", F.explode(one_slip(field)).alias("slip"))
    return slips.join(slips.groupBy("slip").agg(F.count("*").alias("n")).where("n > 1").select("slip").hint("merge"), "slip")


def date_keys(date: Column) -> Column:
    """Keys of which two dates that are near each other (see ``date_likeness``) share one, if they are not about a year or ten years apart."""
    y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    tens, ones = F.pmod(F.floor(y / 10), F.lit(10)), F.pmod(y, F.lit(10))
    keys = [(0, y, m), (1, y, d), (2, m, d, F.least(tens, ones), F.greatest(tens, ones))]  # other day; other month; a hundred years off, or digits of the year swapped
    swapped = F.when((d <= 12) & (d != m), F.xxhash64(F.lit(3), y, F.least(m, d), F.greatest(m, d)))
    return F.filter(F.array(*(F.xxhash64(F.lit(k), *parts) for k, *parts in keys), swapped), lambda x: x.isNotNull())


def day_keys(date: Column) -> tuple[Column, Column]:
    """Keys of a date, and of dates before it, so that each two dates about a year or ten years apart share one: of the later the first, of the earlier the second."""
    days = F.datediff(date, F.lit("1900-01-01").cast("date"))

    def of(x: int) -> Column:
        return F.xxhash64(F.lit("n"), F.floor((days + x) / 6))

    return F.array(of(0)), F.array_distinct(F.array(*map(of, (364, 367, 3650, 3655))))


def near_dates(a: Column, b: Column) -> Column:
    """Whether two dates are equal or near each other (see ``date_likeness``)."""
    same = [f(a) == f(b) for f in (F.year, F.month, F.dayofmonth)]
    swapped = same[0] & (F.month(a) == F.dayofmonth(b)) & (F.month(b) == F.dayofmonth(a))
    apart, years = F.abs(F.datediff(a, b)), F.abs(F.year(a) - F.year(b))
    turned = (F.floor(F.year(a) / 100) == F.floor(F.year(b) / 100)) & (F.pmod(F.year(a), F.lit(10)) == F.pmod(F.floor(F.year(b) / 10), F.lit(10))) & (F.pmod(F.year(b), F.lit(10)) == F.pmod(F.floor(F.year(a) / 10), F.lit(10)))
    return (same[0] & same[1]) | (same[0] & same[2]) | (same[1] & same[2] & (years.isin(0, 1, 10, 100) | turned)) | swapped | apart.between(364, 367) | apart.between(3650, 3655)


def other_pairs(people: DataFrame) -> DataFrame:
    """(a, b) with a < b, beside the pairs by cosine and by record number: rows with alike words in their names and a common birth date or phone, birth dates near each
    other, or phones or record numbers that are equal but for one slip; initials count for words but with birth dates that are only near, where they score too
    little; and rows of one record number whose birth dates are near each other, whatever their names.
    """
    words = F.filter(F.split("name", " "), lambda w: w != "")
    named = checkpointed(people.select("id", "birth", "phone", "mrn", _word_keys("name").alias("w"), F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 1))).alias("letters"), F.exists(words, lambda w: F.length(w) == 1).alias("short")))
    contexts = named.select("id", F.explode(F.array(F.concat(F.lit("b"), F.col("birth").cast("string")), F.concat(F.lit("p"), F.col("phone")))).alias("context")).where("context IS NOT NULL").select("id", F.xxhash64("context").alias("context"))
    contexts = contexts.unionByName(slipped(named, "phone").select("id", F.xxhash64(F.lit("phone"), "slip").alias("context"))).unionByName(slipped(named, "mrn").select("id", F.xxhash64(F.lit("mrn"), "slip").alias("context")))
    contexts = contexts.join(contexts.groupBy("context").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "context").join(named.select("id", "w", "letters", "short").hint("merge"), "id")
    contexts = checkpointed(contexts)

    def worded(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode("w").alias("x"), "context").select("id", F.xxhash64("context", "x").alias("key"))

    def lettered(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode("letters").alias("x"), "context").select("id", F.xxhash64("context", "x").alias("key"))

    by_word = met(worded(contexts), [], counted=worded(contexts.where(F.col("n") > SPLIT))).select("a", "b")
    by_letter = met(lettered(contexts.where("short")), [], others=lettered(contexts), counted=lettered(contexts.where(F.col("short") & (F.col("n") > SPLIT))))
    by_letter = by_letter.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    beside = F.when(F.col("mrn").isNotNull(), F.array(F.concat(F.lit("#"), F.col("mrn")))).otherwise(F.array().cast("array<string>"))
    born = named.where("birth IS NOT NULL").select("id", "birth", F.concat("w", beside).alias("w"))

    def dated(dates: Column) -> tuple[DataFrame, DataFrame]:
        """The rows with a key for each date and word, and those of them whose date alone has more than SPLIT rows."""
        each = born.select("id", "birth", "w", F.explode(dates).alias("date"))
        large = each.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
        return tuple(x.select("id", "birth", "date", F.explode("w").alias("x")).select("id", "birth", F.xxhash64("date", "x").alias("key")) for x in (each, each.join(large, "date", "left_semi")))

    later, earlier = map(dated, day_keys(F.col("birth")))
    keyed, counted = dated(date_keys(F.col("birth")))
    by_date = met(keyed, ["birth"], counted=counted).unionByName(met(later[0], ["birth"], others=earlier[0], counted=later[1]), allowMissingColumns=True)
    by_date = by_date.where(near_dates(F.col("birth_a"), F.col("birth_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return by_word.unionByName(by_letter).unionByName(by_date).distinct()


def most_points(l: Column, r: Column) -> Column:
    """Points that ``pair_score`` gives two rows at the most for all but their names."""

    def number(a: Column, b: Column, same: float, slip: float) -> Column:
        # one slip is at most two edits
        close = (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 2) >= 0)
        return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(F.coalesce(b, F.lit("")) == "", 0.0).when(a == b, same).when(close, slip).otherwise(-0.5)

    born = F.when(l["birth"].isNull() | r["birth"].isNull(), 0.0).when(l["birth"] == r["birth"], 3.0).when(near_dates(l["birth"], r["birth"]), 1.2).otherwise(-3.5)
    return born + number(l["mrn"], r["mrn"], 5.0, 3.5) + number(l["phone"], r["phone"], 2.5, 1.5) - F.when(l["sex"] != r["sex"], 1.5).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _name_points(n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([name_points(*x) for x in zip(n1, n2)], dtype="float64")


def likely(pairs: DataFrame, people: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) but for those whose score would be less than ``least`` even if the cosine of their names were 1.

    Names, the dearest to compare, get 3 points at the most: what this can't make good is left out before."""
    fields = F.struct("name", "birth", "mrn", "phone", "sex")
    both = pairs.join(people.select(F.col("id").alias("a"), fields.alias("l")).hint("merge"), "a").join(people.select(F.col("id").alias("b"), fields.alias("r")).hint("merge"), "b")
    both = both.select("a", "b", F.col("l.name").alias("n1"), F.col("r.name").alias("n2"), (8 * least - 1e-6 - most_points(F.col("l"), F.col("r"))).alias("asked")).where("asked <= 3.0")
    return checkpointed(both.where(_name_points("n1", "n2") >= F.col("asked")).select("a", "b"))


def candidate_pairs(people: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine, exact, told) with a < b: rows that can score high enough to be linked; ``cosine`` is a sum over the contexts that the
    two share where it is not ``exact``.

    Rows whose names have a cosine of LEAST_COSINE or more and that share a birth date or a phone, and rows whose record numbers are equal but for one slip (a
    digit left out, added, exchanged or two swapped) and that share birth date, phone, or the first letter of a word of the name: ``told``, a low score of
    these speaks against them. And ``others``, by default the ``other_pairs``, of which only those that score high enough are to count.
    ``people``: id, name, folded, mrn, phone, birth.
    """
    vectors = checkpointed(name_vectors(people))
    birth, phone = F.concat(F.lit("b"), F.col("birth").cast("string")), F.concat(F.lit("p"), F.col("phone"))
    contexts = people.select("id", F.explode(F.array(birth, phone)).alias("context")).where("context IS NOT NULL").select("id", F.xxhash64("context").alias("context"))
    common = contexts.groupBy("context").agg(F.count("*").alias("n")).where("n > 1")
    named = contexts.join(common.hint("merge"), "context").join(vectors.hint("merge"), "id").select("id", "v", "n", F.xxhash64("context", "gram").alias("key"))
    dots = met(named, ["v"], counted=named.where(F.col("n") > SPLIT)).groupBy("a", "b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("cosine"))  # twice the cosine where both contexts are shared
    near = dots.where(F.col("cosine") >= LEAST_COSINE).select("a", "b", "cosine", F.lit(True).alias("by_context"), F.lit(True).alias("told"))

    letters = F.transform(F.split("folded", " "), lambda w: F.concat(F.lit("w"), F.substring(w, 1, 1)))
    about = F.array_distinct(F.filter(F.concat(F.array(birth, phone), F.coalesce(letters, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "w")))
    by_slip = met(slipped(people, "mrn").join(people.select("id", F.explode(about).alias("x")), "id").select("id", F.xxhash64("slip", "x").alias("key")), []).select("a", "b", F.lit(True).alias("told"))
    by_slip = by_slip.unionByName((other_pairs(people) if others is None else others).withColumn("told", F.lit(False)))
    numbered = checkpointed(by_slip.groupBy("a", "b").agg(F.max("told").alias("told")))
    ours = numbered.join(vectors.withColumnsRenamed({"id": "a", "v": "v_a"}).hint("merge"), "a")
    shared_grams = ours.join(vectors.withColumnsRenamed({"id": "b", "v": "v_b"}).hint("merge"), ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("cosine"))
    by_number = numbered.join(shared_grams, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.lit(False).alias("by_context"), "told")
    return near.unionByName(by_number).groupBy("a", "b").agg(F.coalesce(F.max(F.when(~F.col("by_context"), F.col("cosine"))), F.max("cosine")).alias("cosine"), F.max(~F.col("by_context")).alias("exact"), F.max("told").alias("told"))


def average_linkage(pairs: DataFrame, least: float, absent: float = 0.25, weights: DataFrame | None = None) -> DataFrame:
    """(id, cluster): average-linkage clustering of the ids in ``pairs`` (a, b, score); pairs that are not given
    score ``absent``, which is less than ``least`` (nothing is known of them). ``weights`` (id, n): the rows an id stands for, 1
    where it is not named.

    In each round every cluster names the cluster with the highest average score, at least ``least``, and all pairs that name each
    other are merged. As average linkage never draws a merged pair nearer to a third cluster than the nearer of the two was, these
    merges are those of the one-by-one procedure under some order of equal averages. Ties go by a hash of the pair and the round, so that of n
    clusters that are all equally near about half are merged in a round. The first of all pairs is always mutual, so each round
    merges one pair at least; it ends only when no pair is left.
    """
    members = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("cluster", F.col("id")))
    edges = pairs.select("a", "b", "score")
    for side in ("a", "b"):
        edges = edges.withColumn(f"n_{side}", F.lit(1).cast("bigint")) if weights is None else edges.join(weights.select(F.col("id").alias(side), F.col("n").cast("bigint").alias(f"n_{side}")), side, "left").fillna(1, [f"n_{side}"])
    # the sizes of clusters go with the pairs, so that a round needs no join for them
    edges = checkpointed(edges.select("a", "b", (F.col("score") * F.col("n_a") * F.col("n_b")).alias("total"), (F.col("n_a") * F.col("n_b")).alias("known"), "n_a", "n_b"))
    for turn in itertools.count():
        near = edges.withColumn("mean", F.round((F.col("total") + absent * (F.col("n_a") * F.col("n_b") - F.col("known"))) / (F.col("n_a") * F.col("n_b")), 9)).where(F.col("mean") >= least)
        both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "mean", (F.col("n_a") + F.col("n_b")).alias("n")).select("e.a", "e.b", "mean", "n")
        # the same pair has the same place seen from either side
        low, high = F.least("a", "b"), F.greatest("a", "b")
        nearest = both.groupBy("a").agg(F.min_by(F.struct("b", "n"), F.struct(-F.col("mean"), F.xxhash64(low, high, F.lit(turn)), low, high)).alias("to")).select("a", "to.b", "to.n")
        # two that name each other are the two rows of one pair
        mutual = nearest.groupBy(low.alias("new"), high.alias("old")).agg(F.count("*").alias("named"), F.max("n").alias("n")).where("named = 2").select("old", "new", "n")
        mutual = checkpointed(mutual)
        if mutual.isEmpty():
            return members.select("id", "cluster")
        members = checkpointed(members.join(mutual, members.cluster == mutual.old, "left").select("id", F.coalesce("new", "cluster").alias("cluster")))
        to = mutual.select(F.explode(F.array("old", "new")).alias("id"), F.col("new").alias("to"), "n")
        moved = edges.join(to.select(F.col("id").alias("a"), F.col("to").alias("a_new"), F.col("n").alias("n_a_new")).hint("merge"), "a", "left").join(to.select(F.col("id").alias("b"), F.col("to").alias("b_new"), F.col("n").alias("n_b_new")).hint("merge"), "b", "left")
        p, q, n_p, n_q = F.coalesce("a_new", "a"), F.coalesce("b_new", "b"), F.coalesce("n_a_new", "n_a"), F.coalesce("n_b_new", "n_b")
        merged = moved.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), "total", "known", F.when(p < q, n_p).otherwise(n_q).alias("n_a"), F.when(p < q, n_q).otherwise(n_p).alias("n_b")).where("a <> b")
        edges = checkpointed(merged.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("known").alias("known"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")))


def people_of(patients: DataFrame) -> DataFrame:
    name = clean_name(F.col("fullName"))
    sex = F.lower(F.substring("gender", 1, 1))
    once = patients.groupBy("_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("fullName", "mrn", "phone", "dateOfBirth", "gender")))
    return once.select(
        F.col("_id").alias("id"), name.alias("name"), folded_name(name).alias("folded"), record_number(F.col("mrn")).alias("mrn"), phone_number(F.col("phone")).alias("phone"),
        F.col("dateOfBirth").alias("birth"), F.when(sex.isin("m", "f"), sex).alias("sex"),
    )


@F.pandas_udf(DoubleType())
def _score(n1: pd.Series, n2: pd.Series, b1: pd.Series, b2: pd.Series, m1: pd.Series, m2: pd.Series, p1: pd.Series, p2: pd.Series, s1: pd.Series, s2: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([pair_score(*x) for x in zip(n1, n2, b1, b2, m1, m2, p1, p2, s1, s2, c)], dtype="float64")


def scored_pairs(people: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b, cosine, score) of the candidate pairs, of the other pairs among them those that score ``least`` or more."""
    fields = F.struct("name", "birth", "mrn", "phone", "sex")
    left, right = people.select(F.col("id").alias("a"), fields.alias("l")), people.select(F.col("id").alias("b"), fields.alias("r"))
    both = candidate_pairs(people, likely(other_pairs(people), people, least)).join(left, "a").join(right, "b")
    contexts = F.coalesce((F.col("l.birth") == F.col("r.birth")).cast("int"), F.lit(0)) + F.coalesce((F.col("l.phone") == F.col("r.phone")).cast("int"), F.lit(0))
    both = both.withColumn("cosine", F.when(F.col("exact"), F.col("cosine")).otherwise(F.col("cosine") / contexts)).where((F.col("cosine") >= LEAST_COSINE) | F.col("exact"))
    scored = both.select("a", "b", "cosine", "told", _score("l.name", "r.name", "l.birth", "r.birth", "l.mrn", "r.mrn", "l.phone", "r.phone", "l.sex", "r.sex", "cosine").alias("score"))
    return scored.where(F.col("told") | (F.col("score") >= least)).drop("told")


def linked(patients: DataFrame, least: float = 0.4) -> DataFrame:
    """(id, cluster) for the rows of ``patients`` that are linked with another row; ``cluster`` is the smallest id of its group.

    ``patients``: _id, fullName, mrn, phone, dateOfBirth, gender; nulls in any of them are no evidence. Rows with one _id count
    once. Rows that agree in all fields are scored as one row that weighs as many: no row scores higher with another than with its
    copy, so copies are the first to be merged. Rows that score under ``least`` even with a copy can be linked with none.
    """
    people = people_of(patients)
    same = ["name", "folded", "birth", "mrn", "phone", "sex"]
    self_score = _score("name", "name", "birth", "birth", "mrn", "mrn", "phone", "phone", "sex", "sex", F.lit(1.0))
    kept = checkpointed(people.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("self", self_score).where(F.col("self") >= least).drop("self"))
    groups = average_linkage(scored_pairs(kept.drop("n"), least), least, weights=kept.select("id", "n"))
    # a group of copies alone has no pair of its own
    of_kept = kept.where("n > 1").select("id").unionByName(groups.select("id")).distinct().join(groups, "id", "left").select(F.col("id").alias("first"), F.coalesce("cluster", "id").alias("cluster"))
    met = of_kept.join(kept.withColumnRenamed("id", "first"), "first").select("cluster", *(F.col(c).alias(f"k_{c}") for c in same))
    alike = people[same[0]].eqNullSafe(met[f"k_{same[0]}"])
    for c in same[1:]:
        alike = alike & people[c].eqNullSafe(met[f"k_{c}"])
    return people.join(met, alike).select("id", "cluster")
