import datetime as dt
import random

from recordloom.llm import mixing as M
from recordloom.llm.entities import average_linkage, linked, name_likeness, pair_score, people_of, scored_pairs
from recordloom.llm.leaks import automaton, leaked, passages

ITEM = "A seventy-one-year-old seamstress notices brittle nails after a winter of overtime. Rejecting graft rejection, they call the renal team before swelling closes the airway."
OTHER = "Examination reveals clubbed nails, yet phosphate is unreadable by day twenty two, and the palpable spleen gives way to cold intolerance of the left hand."


def test_leaks(spark):
    words = ITEM.split()
    foreign = "The stay in ward four lasted a few days."
    edited = words[:18]
    edited[6] = "sudden"
    texts = {
        1: "Note. " + ITEM + " End.", 2: ITEM.upper().replace(" ", "\n"), 3: " ".join(words[3:17]), 4: " ".join(edited), 5: " ".join(words[:10]) + ". " + foreign + " " + " ".join(words[10:]), 6: " ".join(words[:9]), 7: None, 8: "",
        9: "x " * 50000, 10: ITEM + " " + OTHER, 11: "brit-\ntle nails af ter a winter of over time. Rejecting graft rejection, they call the renal team",
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0)], "id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, OTHER), (8, OTHER), (9, None)], "item_id bigint, text string")
    got = {(r.id, r.item_id) for r in leaked(docs, items).collect()}
    assert got == {(1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (10, 7), (10, 8), (11, 7)}
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0


def test_offsets():
    text = "Xyz. " + ITEM + " tail"
    (_, s, e, span, edits), = passages(text, automaton(((1, ITEM),)), 12)
    assert text[s:e].rstrip(".") == ITEM.rstrip(".") and span - edits >= 20


def test_parts_of_twelve_words():
    words, held = ITEM.split(), automaton(((1, ITEM),))
    part = words[4:16]

    def edited(*places):
        return " ".join("sudden" if k in places else w for k, w in enumerate(part))

    foreign = "The stay in ward four lasted a few days, " * 3
    for text, edits in (
        (" ".join(part), 0), (edited(5), 1), (edited(1), 1), (" ".join(part[:5] + part[6:]), 1), (" ".join(part[:5] + ["so"] + part[5:]), 1), (" ".join(part[:6]) + ". " + foreign + " ".join(part[6:]), 1),
        (" ".join(part[:6]) + ". " + foreign * 6 + " ".join(part[6:]), 1),
    ):
        got = passages(f"Zeta note, {text}, omega note.", held, 12)
        assert len(got) == 1 and got[0][3:] == (12, edits), text
    # too short, a second edit in so short a part, a first word that is another (eleven words are left), text that goes on elsewhere
    for text in (" ".join(part[:9]), edited(5, 8), edited(0), edited(0, 1, 2), edited(2, 5, 8), " ".join(part[:4]) + " omega " * 30 + " ".join(part[7:])):
        assert not passages(f"Zeta note, {text}, omega note.", held, 12), text
    longer = words[2:20]
    assert passages(" ".join("sudden" if k in (5, 12) else w for k, w in enumerate(longer)), held, 12)[0][3:] == (18, 2)
    many = passages((ITEM + " ") * 500, held, 12)
    assert len(many) == 1


def test_mixing(spark):
    rng = random.Random(4)
    sizes = {"a": 900, "b": 300, "c": 60}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, "word " * rng.randrange(1, 60), 9))
            k += 1
    rows += [(k, "unknown", "word", 9), (k + 1, "a", None, 9), (k + 2, "a", "", 9), (k + 3, None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    copies, shares = M.mixed(docs, targets, M.tokenizer_file())
    got = {r.source: r for r in shares.collect()}
    assert all(abs(got[s].actual_share - t) < 0.03 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert got["a"].most_copies <= 1 and got["b"].most_copies <= 2 and got["c"].most_copies <= 4
    out = [(r.doc_id, r.copy_no) for r in copies.collect()]
    assert len(out) == len(set(out)) == sum(r.n_copies for r in got.values())
    assert out != sorted(out)
    assert M.mixed(docs.limit(0), targets, M.tokenizer_file())[0].count() == 0


def test_poisson_inverse():
    for mean in (0.2, 1.0, 3.5):
        steps = M.poisson_steps(mean, 4)
        for u in (0.0, 0.1, 0.5, 0.9, 0.999):
            assert sum(1 for s in steps if s <= u) == M.capped_poisson(u, mean, 4)


PEOPLE = "_id bigint, fullName string, mrn string, phone string, dateOfBirth date, gender string, id int, name string"


def people(spark, rows):
    return spark.createDataFrame([(*r, 0, "n") for r in rows], PEOPLE)


def test_links(spark):
    d = dt.date(1973, 8, 23)
    rows = [
        (1, "Michael Galmibury", "PT0007397512", "+9996386693480", d, "M"), (2, "GALMIBURY, Mike", "PT/0007397512", None, d, "M"), (3, "Michael Galmeebury", "PTO008189420", "6386 693 480", d, "M"), (4, "M. Galmibury", "pt0008189420", None, None, None),
        (5, "Anna Galmibury", "PT0055555555", "6386693480", dt.date(1975, 1, 2), "F"), (6, "Michael Galmibury", "PT0099999999", "6100000000", dt.date(1999, 5, 5), "M"), (7, None, None, None, None, None), (8, None, None, None, None, None), (9, "", "", "", None, ""),
        (10, "x" * 3000, "PT1", None, d, None), (1, "Michael Galmibury", "PT0007397512", "+9996386693480", d, "M"),
    ]
    groups = {}
    for r in linked(people(spark, rows)).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 2, 3, 4})}
    assert linked(people(spark, [])).count() == 0


def test_every_pair_that_scores_enough_is_found(spark):
    """Two rows of each person: near dates, phones with a slip, short forms and initials without a common trigram; against all pairs."""
    d = dt.date(1973, 8, 5)
    couples = [
        (("Ann Orlowska", None, None, d, "F"), ("Ann Orlowska", None, None, dt.date(1973, 5, 8), "F")), (("Mark Tolliver", None, None, d, "M"), ("Mrak Toliver", None, None, dt.date(1974, 8, 4), "M")),
        (("Bob Yarphiland", None, "6071234567", None, "M"), ("Robert Yarphiland", None, "6071243567", None, "M")), (("Bob", None, None, dt.date(1950, 1, 9), "M"), ("Robert", None, None, dt.date(1950, 1, 9), "M")),
        (("Q Z", None, None, dt.date(1961, 2, 3), None), ("Quentin Zorbas", None, None, dt.date(1961, 2, 3), None)), (("Liz", "PT0031415926", None, None, None), ("Elizabeth", "PT0031415926", None, None, None)),
        (("Ulla Varga", "PT0027182818", "6099999991", dt.date(1988, 4, 4), "F"), ("Petra Simko", "PT0027182818", "609999991", dt.date(1988, 4, 14), "F")),
    ]
    df = people(spark, [(2 * k + j, *row) for k, couple in enumerate(couples) for j, row in enumerate(couple)])
    rows = sorted(people_of(df).collect(), key=lambda r: r.id)
    want = {(a.id, b.id) for a in rows for b in rows if a.id < b.id and pair_score(a.name, b.name, a.birth, b.birth, a.mrn, b.mrn, a.phone, b.phone, a.sex, b.sex, 0.0) >= 0.4}
    assert want >= {(2 * k, 2 * k + 1) for k in range(len(couples))}
    assert {(r.a, r.b) for r in scored_pairs(people_of(df)).where("score >= 0.4").collect()} >= want


def test_name_likeness():
    assert name_likeness("michael a galmibury", "galmibury mike")[0] >= 0.78
    assert name_likeness("m galmibury", "michael galmibury")[1] > 0
    assert name_likeness("michael galmibury", "anna galmibury")[0] < 0.6


def naive_average_linkage(pairs, least):
    sim = {}
    for a, b, s in pairs:
        sim[frozenset((a, b))] = s
    clusters = [{x} for x in sorted({x for a, b, _ in pairs for x in (a, b)})]
    while True:
        best = max(((round(sum(sim.get(frozenset((x, y)), 0.25) for x in p for y in q) / (len(p) * len(q)), 9), -min(p), -min(q), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j), default=None)
        if best is None or best[0] < least:
            return {frozenset(c) for c in clusters}
        i, j = best[3], best[4]
        clusters[i] |= clusters.pop(j)


def test_average_linkage_equals_one_by_one(spark):
    rng = random.Random(9)
    pairs = [(a, b, round(rng.random(), 3)) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.5]
    got = {}
    for r in average_linkage(spark.createDataFrame(pairs, "a bigint, b bigint, score double"), 0.4).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == naive_average_linkage(pairs, 0.4)


def clusters(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(g) for g in groups.values()}


def test_average_linkage_ends_only_without_pairs(spark):
    pairs = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60)]
    assert clusters(average_linkage(spark.createDataFrame(pairs, "a bigint, b bigint, score double"), 0.4)) == {frozenset(range(60))}


def test_average_linkage_weighs_ids(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.0), (2, 3, 0.8)], "a bigint, b bigint, score double")
    assert clusters(average_linkage(pairs, 0.4)) == {frozenset({1, 2, 3})}
    assert clusters(average_linkage(pairs, 0.4, weights=spark.createDataFrame([(1, 5)], "id bigint, n bigint"))) == {frozenset({1, 2}), frozenset({3})}


def test_many_rows_of_one_person(spark):
    d = dt.date(1973, 8, 23)
    copies = [(k, "Michael Galmibury", "PT0007397512", None, d, "M") for k in range(100, 145)]
    named = [(k, "Michael Galmibury", "PT0007397512", f"70{k}0{k}9", d, "M") for k in range(200, 204)]
    got = clusters(linked(people(spark, copies + named + [(7, "Anna Orlowska", None, None, dt.date(1980, 1, 2), "F"), (8, "Anna Orlowska", None, None, dt.date(1980, 1, 2), "F"), (9, "Olga", None, None, None, None), (10, "Olga", None, None, None, None)])))
    assert {g for g in got if len(g) > 1} == {frozenset([*range(100, 145), *range(200, 204)]), frozenset({7, 8})}
