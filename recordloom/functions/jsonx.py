"""JSON text that broke off, and what can be read of it."""

from __future__ import annotations

import itertools
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_THOUGHTS = re.compile(r"<think>.*?</think>", re.S)
_FENCE = re.compile(r"```\w*\s*\n?(.*?)```", re.S)


def repair(text: str | None) -> str | None:
    """What can be read of a JSON object in text, also where it was cut: a member whose value broke off goes, what is open is closed.

    Thoughts between tags are left out; of the fenced pieces and then the whole text, the first that holds an object or a list
    counts. Null where nothing can be read.
    """
    if not text:
        return None
    text = _THOUGHTS.sub("", text)
    return next((x for x in map(_object, [*_FENCE.findall(text), text]) if x is not None), None)


def _object(text: str) -> str | None:
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = text[start:]
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return _flat(value)
    except ValueError as error:
        wrong = error.pos
    commas, stack, inside, escaped = [], [], False, False
    for i, ch in enumerate(body):
        if inside:
            if ch == '"' and not escaped:
                inside = False
            escaped = ch == "\\" and not escaped
            continue
        if ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack and stack[-1] == ch:
            stack.pop()
        elif ch == ",":
            commas.append((i, "".join(reversed(stack))))
    tries = []
    if commas and not any(c in body[commas[-1][0] :] for c in "}]"):  # the last member broke off
        tail = body[commas[-1][0] + 1 :].lstrip()
        if tail == "" or tail.startswith('"'):
            tries.append(body[: commas[-1][0]] + commas[-1][1])
    tries.append(body + ('"' if inside else "") + "".join(reversed(stack)))
    # what stands before the first mistake can be read up to a comma
    for attempt in itertools.chain(tries, (body[:i] + ends for i, ends in reversed(commas) if i <= wrong)):
        try:
            return _flat(json.loads(attempt))
        except ValueError:
            continue
    return None


def _flat(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def repaired(text: Column) -> Column:
    """``repair`` of a text column, in Arrow batches."""

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(repair).astype("object")

    return fix(text)
