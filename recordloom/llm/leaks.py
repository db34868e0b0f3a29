"""Held-out passages inside texts.

The items are cut into runs of a few words; one Aho-Corasick automaton holds all runs without their blanks and marks. Each text is
scanned once in the same form (lower case, letters and digits only, offsets kept), so that case, punctuation, spacing, hyphens and
line breaks do not matter. Hits that follow each other are joined, extended word by word over single edits, and chained in order;
the length of the running part of the item that the chain spans decides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.skew import bounded_rows

RUN = 3
EDIT_CHARS = 60  # text between two stretches that may stand for several exchanged, added or dropped words
SENTENCE_STOPS = 3  # ends of sentences about a foreign sentence: of the text before, its own, one for an abbreviation
_CACHE: dict = {}


_LETTERS = re.compile(r"[^\W_]+")


def flattened(text: str) -> str:
    """Letters and digits of a text, without case and accents."""
    folded = text.casefold()
    return "".join(_LETTERS.findall(folded if folded.isascii() else unicodedata.normalize("NFKD", folded)))


def squeezed(text: str) -> tuple[str, list[int]]:
    """The same as ``flattened``, and the offset in the text of each of its characters."""
    out, at = [], []
    for k, ch in enumerate(text):
        for c in flattened(ch):
            out.append(c)
            at.append(k)
    return "".join(out), at


def item_words(text: str) -> list[str]:
    return [w for w in map(flattened, text.split()) if w]


def automaton(items: tuple[tuple[int, str], ...]):
    """The automaton over all runs of RUN words of the items, whose values are lists of (item, word number), and the items' words."""
    key = hash(items)
    if key not in _CACHE:
        runs: dict[str, list] = {}
        spelled: dict[int, list[str]] = {}
        for number, (item, text) in enumerate(items):
            words = spelled[number] = item_words(text)
            for k in range(max(1, len(words) - RUN + 1)):
                runs.setdefault("".join(words[k : k + RUN]), []).append((number, k, len(words[k : k + RUN])))
        machine = ahocorasick.Automaton()
        for run, places in runs.items():
            if run:
                machine.add_word(run, (len(run), places))
        if len(machine):
            machine.make_automaton()
        _CACHE.clear()
        _CACHE[key] = (machine, spelled, [item for item, _ in items])
    return _CACHE[key]


def _extended(words: list[str], flat: str, edges: set[int], k: int, at: int, step: int) -> tuple[int, int, int]:
    """Where a stretch ends that goes on from item word ``k`` at place ``at``, forwards (``step`` 1) or backwards (-1), over edits
    of a single word each, exchanged, dropped or added, and the number of these. Only whole words of the text count."""
    edits = 0

    def match(k: int, at: int) -> int | None:
        if not 0 <= k < len(words):
            return None
        w = words[k]
        lo, hi = (at, at + len(w)) if step > 0 else (at - len(w), at)
        return (hi if step > 0 else lo) if lo in edges and hi in edges and flat.startswith(w, lo) else None

    def run(k: int, at: int) -> int:
        n = 0
        while n < RUN and (to := match(k, at)) is not None:
            k, at, n = k + step, to, n + 1
        return n

    while True:
        if (to := match(k, at)) is not None:
            k, at = k + step, to
            continue
        over = at + step
        while 0 < over < len(flat) and over not in edges:
            over += step
        if not 0 <= over <= len(flat):
            over = at
        ways = [(run(k + step, over), k + step, over), (run(k + step, at), k + step, at), (run(k, over), k, over)]
        n, k2, at2 = max(ways, key=lambda x: x[0])
        if not n:
            return k, at, edits
        k, at, edits = k2, at2, edits + 1


def passages(text: str, held, least: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, span, edits) for each item of which a running part of at least ``least`` words stands in the text.

    ``start`` and ``end`` are offsets of the text. ``span`` is the length in words of the part of the item, ``edits`` the number of
    single words in it that were exchanged, added or dropped. One edit is free; each further one asks for three words more, as
    items share turns of phrase: a part counts if span >= least and span - 3 * edits >= least - 3. A foreign sentence where the item
    goes on counts as one edit, once in a part. Where several words in a row are exchanged or dropped, these do not count in ``span``,
    and each is an edit.
    """
    machine, spelled, names = held
    flat = flattened(text)
    if not flat or not len(machine):
        return []
    by_item: dict[int, set] = {}
    for end, (size, places) in machine.iter(flat):
        for item, k, n in places:
            by_item.setdefault(item, set()).add((k, end + 1 - size, n))
    # a part that counts has an unedited run of a third of ``least`` words at least, and RUN words make one hit
    by_item = {item: hits for item, hits in by_item.items() if len(hits) > least // 3 - RUN and len(spelled[item]) >= least}
    if not by_item:
        return []
    flat, offsets = squeezed(text)
    edges = {0, len(flat)}
    edges.update(i for i in range(1, len(flat)) if offsets[i] - offsets[i - 1] > 1)
    stops = [m.start() for m in re.finditer(r"[.!?](?=\s)|\n\s*\n", text)]
    found = []
    for item, hits in by_item.items():
        words = spelled[item]
        starts, stretches = {(k, s) for k, s, _ in hits}, set()
        for k, s, n in hits:
            if k and (k - 1, s - len(words[k - 1])) in starts:
                continue
            b, e = k, s
            while (b, e) in starts:
                e += len(words[b])
                b += 1
            e += sum(map(len, words[b : b + n - 1]))
            b += n - 1
            stretches.add((e, s, k, b, 0))
            b2, e2, after = _extended(words, flat, edges, b, e, 1)
            a2, s2, before = _extended(words, flat, edges, k - 1, s, -1)
            stretches.update({(e2, s, k, b2, after), (e, s2, a2 + 1, b, before), (e2, s2, a2 + 1, b2, before + after)})
        ended: dict[int, list] = {}  # by last word: end, and worth, span, edits, start and foreign sentences of the best chain to there
        top = None
        for e, s, a, b, edits in sorted(stretches):
            best = (b - a - 3 * edits, b - a, edits, s, 0)
            for b2 in range(a - 6, b):
                known = ended.get(b2, [])
                skipped = a - b2
                for i in range(bisect_right(known, s, key=lambda x: x[0]) - 1, -1, -1):
                    end, _, span, had, start, foreign = known[i]
                    alone = skipped <= 1  # at most one word exchanged or dropped
                    longer = span + b - b2 - (0 if alone else skipped)
                    if s - end <= EDIT_CHARS:
                        way = (longer, had + edits + (1 if alone else skipped), start, foreign)
                    elif not alone or bisect_left(stops, offsets[s]) - bisect_left(stops, offsets[end - 1]) > SENTENCE_STOPS:
                        break
                    elif foreign:
                        continue
                    else:
                        way = (longer, had + edits + abs(skipped) + 1, start, 1)
                    best = max(best, (way[0] - 3 * way[1], *way))
            ended.setdefault(b, []).append((e, *best))
            if best[1] >= least and (top is None or best > top[:5]):
                top = (*best, e)
        if top is not None and top[0] >= least - 3:
            found.append((names[item], offsets[top[3]], offsets[top[5] - 1] + 1, top[1], top[2]))
    return found


def leaked(texts: DataFrame, items: DataFrame, least: int = 12, item_limit: int = 20_000) -> DataFrame:
    """(id, item_id, start, end, span, edits): the items whose passage, or a running part of it, stands in a text.

    ``texts``: id, text. ``items``: item_id, text; a fixed list of at most ``item_limit`` rows, which every task holds. ``least``
    is the least length in words of a running part (see ``passages``). At least RUN words in a row must be unedited, also on each
    side of foreign text. Null and empty texts and items give nothing.
    """
    held = tuple((r.item_id, r.text) for r in bounded_rows(items.where("text IS NOT NULL").select("item_id", "text").distinct(), item_limit, "the list of items"))

    @F.pandas_udf("array<struct<item_id: bigint, start: int, end: int, span: int, edits: int>>")
    def scan(text: pd.Series) -> pd.Series:
        found = automaton(held)
        return pd.Series([[dict(zip(("item_id", "start", "end", "span", "edits"), x)) for x in passages(t, found, least)] if t else [] for t in text], dtype="object")

    return texts.select("id", F.explode(scan("text")).alias("x")).select("id", "x.*")
