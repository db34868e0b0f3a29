import pytest

from recordloom.llm import endings as E
from recordloom.llm import pairs as P
from recordloom.llm.endings import cut_texts


@pytest.mark.parametrize(
    "answer, refused",
    [
        ("I'm sorry, but I can't help with that request.", True), ("I must decline to comment on this patient.", True), ("That is not something I can answer here.", True), ("Diese Frage darf ich leider nicht beantworten.", True),
        ("Je suis désolé, je ne peux pas répondre à cette demande.", True), ("Lo siento, no puedo ayudar con esa petición.", True), ("As an automated helper I am not able to discuss that.", True), ("I won't be able to give information about it.", True),
        ("I cannot find migraine among the approved diagnoses.", False), ("The patient was unable to tolerate Veltapril.", False), ("The clinic declined the slot on 17 March.", False), ("No, it was filed on 15 March.", False), ("None documented.", False), ("", False),
    ],
)
def test_refusals(answer, refused):
    assert P.refuses(answer) == refused


@pytest.mark.parametrize(
    "question, answer, same",
    [
        ("Is TSH pending?", "Is TSH pending?", True), ("Is TSH pending?", "IS  TSH PENDING", True), ("Is TSH pending?", 'Question: "Is TSH pending?"', True), ("Is TSH pending?", "You asked: Is TSH pending?", True),
        ("Is TSH pending?", "You asked: Is TSH pending? No, it was filed on 15 March.", False), ("Did the patient tolerate Veltapril?", "The patient was unable to tolerate Veltapril. It was replaced.", False), ("", "", False), ("a b c " * 2000, "a b c " * 2000, True),
    ],
)
def test_copies(question, answer, same):
    assert P.copied(question, answer) == same


def test_languages():
    assert P.other_language("When was potassium last measured?", "Sí, la consulta recoge mareos desde hace 18 días.")
    assert not P.other_language("When was potassium last measured?", "The last value is of 4 May.")
    assert not P.other_language("¿Cuándo es la próxima revisión?", "La próxima revisión será dentro de 13 días.")
    assert not P.other_language("", "La próxima revisión será dentro de 13 días.")


@pytest.mark.parametrize("text, left", [("a (b", "bracket"), ("a (b) c", ""), ('he said "x', "quotation"), ("```py\nx", "fence"), ("```py\nx```", ""), ("<b>x", "tag"), ("x\n- a\n-", "list"), ("", "")])
def test_pushdown(text, left):
    assert P.left_open(text) == left


def corpus():
    whole = ["The wound is healing well. Repeat the test in %d weeks." % k for k in range(60)] + ["advised a daily walk we will repeat it in %d weeks impression is mild asthma" % k for k in range(60)]
    whole += ["The wound is healing well. Repeat the test in %d weeks.\nSigned electronically" % k for k in range(60)]
    return whole


def test_cut_texts(spark):
    cut = ["The wound is healing well. Repeat the te", "The wound is healing well. Repeat the", "The wound is heal…", "advised a daily walk we will rep", "The wound is healing w�", "The wound is healing well. Repeat the test i-"]
    odd = ["", None, "   ", "...", "x" * 30000 + ".", "Reviewed by Zorbas Quentil"]
    rows = [("s", t, 1) for t in corpus() + cut + odd + cut[:2] + corpus()[:5]] + [(None, "Lone text.", 1)]
    df = spark.createDataFrame(rows, "source string, text string, t int")
    assert {r.text for r in cut_texts(df).collect()} == set(cut)
    assert cut_texts(df.limit(0)).count() == 0


def test_places_of_all_sentences_are_counted(spark):
    texts = ["The dose is low. The dose is high\nThe dose is as before. Seen today."] * 3
    got = E.parts(E.text_keys(spark.createDataFrame([("s", t) for t in texts], "source string, text string")), []).collect()
    grams = {words: tuple(sum(x) for x in zip(*((r.n, r.stops) for r in got if r.kind == "G" and r.g2 == E._gram("s", words.split())))) for words in ("dose is", "is low", "the dose is high", "seen today")}
    assert grams == {"dose is": (9, 0), "is low": (3, 3), "the dose is high": (3, 3), "seen today": (3, 3)}
    assert sum(r.n for r in got if r.v == E.PAIR + "dose" + E.PAIR + "is") == 9


def test_defective(spark):
    rows = [(1, "No, it was filed on 15 March.", "Is TSH pending?", False), (2, None, "Is TSH pending?", True), (3, "Is TSH pending?", "Is TSH pending?", False), (4, "I must decline to comment.", None, False), (5, "La próxima revisión será dentro de 13 días.", "When is the next visit of the patient?", False)]
    df = spark.createDataFrame(rows, "answer_id int, answer string, question string, answer_blank boolean")
    assert {(r.answer_id, r.defect) for r in P.defective(df).collect()} == {(2, "empty"), (3, "copied_question"), (4, "refusal"), (5, "other_language")}
    assert P.defective(df.limit(0)).count() == 0
