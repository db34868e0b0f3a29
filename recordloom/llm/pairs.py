"""Defects of question and answer pairs: refusals, copied questions, other languages, open structure.

The functions here look at one pair; the pairs come from ``conversations.answer_pairs``, and answers that stop early from
``endings.cut_texts`` over all answers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.endings import cut_keys, text_keys
from recordloom.operators.skew import salted_join

# Frequent words of languages.
COMMON_WORDS = {
    "en": "the of and to in is was are it for with on at that this from by be has have had not no or an as which what when who why how does did do can been between after before about any there please list show current your my i you we they he she its current last first".split(),
    "de": "der die das und ist im in den dem des ein eine einer einem einen mit von zu zur zum auf für nicht hat wurde wird seit bei über auch nach vor welche welcher wann was wie wo war sind es ich sie er wir bitte keine noch zurzeit steht".split(),
    "fr": "le la les de des du un une et est en à au aux il elle ils a été ne pas pour par sur dans avec que qui quel quelle quand ce cette ces depuis dernier dernière sont je nous vous aucun lieu dossier".split(),
    "es": "el la los las de del un una y es en al se ha por para con que qué cuál cuándo desde hace no lo su sus fue son hay está yo usted dentro figura última próxima sí otro".split(),
    "it": "il lo la gli le di del della dei un una e è in al che non per con da su sono ha stato quale quando come questo questa dal nel più anche ultimo".split(),
    "pt": "o os as de do da dos das um uma e é em no na nos ao que não para com por se foi são há qual quando desde está seu sua mais também último".split(),
    "nl": "de het een van en is in op te dat die voor met niet aan er was zijn door bij naar ook heeft werd wordt welke wanneer hoe wat dit deze sinds geen".split(),
}
# Letters that only some of these languages use.
OWN_LETTERS = {"de": "äöüß", "fr": "çèêëîïœûùàâô", "es": "ñ¿¡áíóú", "pt": "ãõçáêâ", "it": "òìùàè"}
# The grammar of refusals, by language: who declines, how, and what kind of act.
_ACT = r"(?:answer|comment|respond|reply|discuss|help|assist|advis|speculat|give (?:you )?(?:any )?(?:an )?(?:information|answer|advice)|giving (?:an )?(?:answer|information|advice)|provid\w* (?:you )?(?:with )?(?:any )?(?:an )?(?:information|answer|advice|that)|share|do (?:that|this)|say|go into|address|deal with|take (?:this|that) (?:question|one)|talk about|fulfil|comply|engage|weigh in|offer)"
_UNABLE = r"(?:can ?not|can['’]?t|could not|couldn['’]t|(?:am|['’]m|are) (?:not )?(?:un)?able to|(?:am|['’]m) not (?:able|allowed|permitted|in a position|authori[sz]ed|supposed|comfortable|qualified|going)(?: to)?|(?:am|['’]m) (?:unable|barred|prevented|prohibited|forbidden)(?: to| from)?|(?:will|would) not|won['’]t|may not|must not|must decline|have to (?:decline|refuse|pass)|decline|refuse|would rather not|['’]d rather not|prefer not)(?: (?:be able|to|from|be))*"
REFUSALS = [
    rf"\b(?:i|we)\b ?{_UNABLE} (?:\w+ ){{0,2}}?{_ACT}",
    rf"\bi (?:must|have to|need to|will|am going to|would like to) (?:respectfully |politely )?(?:decline|refuse|pass|abstain)",
    r"\bi ?(?:am|['’]m) (?:not in a position|barred|not allowed|not permitted|not authori[sz]ed|prohibited|not able) (?:to|from)\b(?! (?:find|see|locate|detect))",
    r"\bi (?:decline|refuse) to\b",
    r"\b(?:my|the|these|our) (?:guidelines|instructions|rules|policy|policies|settings|configuration)\b.{0,20}\b(?:do not|don['’]t|does not|prevent|forbid|prohibit)\b.{0,10}(?:allow|permit|let)?",
    r"\b(?:outside|beyond|not (?:within|part of)|falls outside|exceeds?) (?:of )?(?:my|what i|the scope of)\b",
    r"\bnot (?:a|the|something|anything|an?) ?(?:topic|question|subject|matter|something|thing)? ?(?:that )?i (?:can|may|am able to|am allowed to|am permitted to|could) (?:answer|discuss|help|comment|speak|talk|address|respond)",
    r"\bnot something i (?:can|may|am)\b",
    r"\b(?:leave|leaving|has to (?:stay|remain|go)|must (?:stay|remain|go)|will (?:stay|remain|go)) (?:the|that|this|your)? ?(?:question )?unanswered\b",
    r"\b(?:would be|is) (?:wrong|inappropriate|improper|not appropriate) (?:of|for) me to\b",
    r"\bas an? (?:\w+ )?(?:helper|assistant|model|ai|language model|program|bot|system|tool|software)\b.{0,40}\b(?:not|cannot|can['’]t|unable|pass|decline|won['’]t)\b",
    r"^\s*(?:sorry|apologies|regrettably|unfortunately)[,.]? (?:but )?(?:no|that is not possible|not possible)\b",
    r"\bplease (?:put|direct|address|take) (?:this|that|your|the) (?:question|request)s? to\b",
    r"\b(?:leider|tut mir leid)\b.{0,60}\b(?:nicht|keine)\b.{0,40}\b(?:helfen|beantworten|antworten|auskunft|sagen|äußern|äussern|möglich|geben|eingehen|dienen|weiterhelfen)\b",
    r"\b(?:ich|wir) (?:kann|darf|möchte|werde|können|dürfen)\b.{0,50}\b(?:nicht|keine)\b.{0,40}\b(?:helfen|beantworten|antworten|auskunft|sagen|äußern|geben|eingehen|kommentieren|besprechen|weiterhelfen)\b",
    r"\bfrage\b.{0,30}\b(?:darf|kann) ich\b.{0,20}\b(?:nicht)\b",
    r"\b(?:außerhalb|ausserhalb) (?:dessen|meiner|meines)\b|\bliegt nicht in meine[rm]\b|\bist mir nicht (?:gestattet|erlaubt|möglich)\b|\bmuss ich (?:ablehnen|unbeantwortet)\b",
    r"\bje ne (?:peux|puis|suis|saurais|souhaite|dois)\b.{0,30}\b(?:pas|répondre|aider|autoris)|\bil (?:ne )?m['’]est (?:pas )?(?:interdit|impossible|permis)\b.{0,40}(?:répondre|aider|donner|traiter|commenter|dire)?",
    r"\bdépasse ce qu|\bje (?:dois|préfère) (?:décliner|refuser|ne pas)\b|\bdésolée?\b.{0,40}\b(?:ne|pas)\b.{0,30}\b(?:répondre|aider|donner)\b|\bhors de mon (?:domaine|champ|rôle)\b|\bmes (?:règles|consignes|instructions) ne\b",
    r"\bno (?:puedo|podemos|me es posible|me está permitido|estoy autorizad[oa]|debo|soy capaz)\b.{0,40}\b(?:responder|contestar|ayudar|dar|comentar|hablar|opinar|ofrecer)",
    r"\b(?:no me está permitido|me temo que no|debo rechazar|prefiero no)\b|\blo siento\b.{0,40}\bno\b.{0,30}\b(?:puedo|ayudar|responder|contestar|posible)|\b(?:fuera|más allá) de (?:mi|lo que|mis)\b|\bmis (?:reglas|normas|instrucciones) no\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I | re.S)
# Words that frame a repeated question.
FRAME = set("you your asked ask asking question was is the q user said want to know wanted so repeat repeating frage sie fragten demande vous avez demandé pregunta usted preguntó regarding concerning re understood noted received thanks thank ok okay sure i see would like".split())


# Words of which one stands in every refusal of the grammar.
REFUSAL_WORDS = frozenset(
    "i we guidelines instructions rules policy policies settings configuration outside beyond within part falls exceed exceeds leave leaving stay remain go me helper assistant model ai language program bot system tool software "
    "sorry apologies regrettably unfortunately put direct address take leider leid ich wir frage außerhalb ausserhalb liegt mir muss je m dépasse désolé désolée hors mes puedo podemos posible permitido autorizado autorizada "
    "debo soy temo prefiero siento fuera allá mis".split()
)
_LANGUAGES: dict[str, list[str]] = {}
for _k, _ws in COMMON_WORDS.items():
    for _w in _ws:
        _LANGUAGES.setdefault(_w, []).append(_k)


@lru_cache(maxsize=20_000)
def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@lru_cache(maxsize=20_000)
def language(text: str) -> dict[str, float]:
    """A score for each language, from its common words and letters."""
    score = dict.fromkeys(COMMON_WORDS, 0.0)
    for w in tokens(text):
        for k in _LANGUAGES.get(w, ()):
            score[k] += 1.0
    if not text.isascii():
        low = text.lower()
        for k, letters in OWN_LETTERS.items():
            score[k] += 0.5 * sum(c in letters for c in low)
    return score


def other_language(question: str, answer: str) -> bool:
    q, a = language(question), language(answer)
    ours = max(q, key=lambda k: (q[k], k == "en"))
    theirs = max(a, key=lambda k: (a[k], k == ours))
    if ours == theirs or q[ours] < 1 or a[theirs] < 2:
        return False
    return a[theirs] >= 1.5 * a[ours] + 1 and q[ours] > q[theirs]


def script(text: str) -> str:
    """Name of the script of most letters, by code ranges."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            o = ord(c)
            name = "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "hebrew" if o < 0x600 else "arabic" if o < 0x780 else "indic" if o < 0xE00 else "other"
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=counts.get) if counts else ""


def tiles(a: list[str], b: list[str], least: int = 2) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which tokens of ``a`` and of ``b`` lie in common tiles, long tiles first.

    The length searched for falls by halves: windows of that length of ``b`` are held by their tokens, each window of ``a`` takes
    the first that is free and grows to the right. A token is marked once, so a level takes linear time whatever the texts repeat.
    """
    in_a, in_b = [False] * len(a), [False] * len(b)
    size = 1 << (max(1, min(len(a), len(b))).bit_length() - 1)
    while True:
        size = max(size, least)
        where: dict[tuple, list[int]] = {}
        free = 0  # free tokens of b up to here
        for j, taken in enumerate(in_b):
            free = 0 if taken else free + 1
            if free >= size:
                where.setdefault(tuple(b[j - size + 1 : j + 1]), []).append(j - size + 1)
        for starts in where.values():
            starts.reverse()
        i = 0
        while i + size <= len(a):
            starts = where.get(tuple(a[i : i + size])) if not in_a[i] and not in_a[i + size - 1] else None
            while starts and (in_b[starts[-1]] or in_b[starts[-1] + size - 1]):
                starts.pop()
            if not starts:
                i += 1
                continue
            j = starts.pop()
            while i < len(a) and j < len(b) and a[i] == b[j] and not in_a[i] and not in_b[j]:
                in_a[i] = in_b[j] = True
                i, j = i + 1, j + 1
        if size == least:
            return in_a, in_b
        size //= 2


def copied(question: str, answer: str) -> bool:
    """The answer only gives back the question: its tokens, frame words aside, lie in tiles of the question or beside all of it."""
    q, a = tokens(question), tokens(answer)
    if not q or not a or len(a) > 3 * len(q) + 20 or set(q).isdisjoint(a):
        return False
    in_a, in_b = tiles(a, q, 1 if len(q) < 4 else 2)
    rest = [w for w, t in zip(a, in_a) if not t and w not in FRAME]
    return sum(in_a) >= max(2, 0.6 * len(q)) and len(rest) <= 0.1 * len(a) + 0.5


_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "“": "„"}


@lru_cache(maxsize=10_000)
def left_open(text: str) -> str:
    """What a pushdown parse leaves open at the end: a fence, a bracket, a quotation, a tag or a list mark; '' where nothing is."""
    if text.count("```") % 2:
        return "fence"
    stack: list[str] = []
    for m in re.finditer(r"```.*?```|<(/?)([a-z][a-z0-9]*)\b[^<>]*?(/?)>|[()\[\]{}«»“”„\"]", text, re.S):
        piece = m[0]
        if piece.startswith("```"):
            continue
        if m[2]:
            if m[3] or m[2] in ("br", "hr", "img", "p", "li"):
                continue
            if m[1]:
                if ("<" + m[2]) in stack:
                    while stack.pop() != "<" + m[2]:
                        pass
            else:
                stack.append("<" + m[2])
        elif piece == '"':
            if m.start() and text[m.start() - 1].isdigit() and '"' not in stack:
                continue  # inches
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
        elif piece in "([{«„" or (piece == "“" and "„" not in stack):
            stack.append(piece)
        elif stack and stack[-1] == _PAIRS.get(piece):
            stack.pop()
    if stack:
        return {"(": "bracket", "[": "bracket", "{": "bracket"}.get(stack[-1], "tag" if stack[-1][0] == "<" and len(stack[-1]) > 1 else "quotation")
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d{1,3}[.)])\s*$", text) and "\n" in text.strip():
        return "list"
    return ""


def refuses(answer: str) -> bool:
    return not REFUSAL_WORDS.isdisjoint(tokens(answer)) and bool(_REFUSAL.search(answer))


def defective(pairs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(answer_id, defect, evidence) for the defective rows of ``pairs`` (answer_id, answer, question, answer_blank), at most one for each.

    In this order: 'empty', 'refusal', 'copied_question', 'other_language' (also: another script), 'truncated' (``evidence``: 'open
    structure' where the pushdown parse of the whole answer leaves something open, 'end' where the end of the answer goes on in other answers, see
    ``endings.cut_keys``). A null question has no language and nothing to copy.
    """

    @F.pandas_udf("string")
    def judge(question: pd.Series, answer: pd.Series) -> pd.Series:
        def one(q, a):
            q = q or ""
            if refuses(a):
                return "refusal"
            if copied(q, a):
                return "copied_question"
            if q and (other_language(q, a) or (script(q) and script(a) and script(q) != script(a))):
                return "other_language"
            return "truncated" if left_open(a) else None

        return pd.Series([one(q, a) for q, a in zip(question, answer)], dtype="object")

    said = text_keys(pairs.where("NOT answer_blank").select("answer_id", "question", F.lit("answers").alias("source"), F.col("answer").alias("text")))
    cut = cut_keys(said.select("source", "text"), terms).withColumn("cut", F.lit(True))
    judged = salted_join(said.select("answer_id", "t1", "t2", judge("question", "text").alias("defect")), cut, ["t1", "t2"], F.col("answer_id"), "left")
    evidence = F.when(F.col("defect") == "truncated", "open structure").when(F.col("defect").isNull(), "end")
    found = judged.where("defect IS NOT NULL OR cut").select("answer_id", F.coalesce("defect", F.lit("truncated")).alias("defect"), evidence.alias("evidence"))
    return found.unionByName(pairs.where("answer_blank").select("answer_id", F.lit("empty").alias("defect"), F.lit(None).cast("string").alias("evidence")))
