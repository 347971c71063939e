"""Strict extraction of the one JSON object in a model's raw output, with a code for each refusal.

Codes: empty, no_object, repetition, truncated, trailing_text, second_object, duplicate_key, not_json,
not_object. Markdown fences around the object are taken off first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
#: A block of 6 to 160 characters four times in a row, in the last 960 characters.
_BLOCK = (6, 160)
_TAIL = 960
_SCHEMA = "json string, code string"


class _Twice(ValueError):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Twice
    return out


def object_end(text: str, start: int) -> int:
    """Where the object that opens at start ends; -1 if it doesn't. Braces inside strings don't count."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def looped(text: str) -> bool:
    """Whether a block stands four times in a row: its first characters then stand four times too, and only such places are compared."""
    least, most = _BLOCK
    places: dict[str, list[int]] = {}
    for i in range(len(text) - least + 1):
        places.setdefault(text[i : i + least], []).append(i)
    for starts in places.values():
        for k, i in enumerate(starts[:-3]):
            for j in starts[k + 1 :]:
                if j - i > most:
                    break
                if j - i >= least and text[i : 3 * j - 2 * i] == text[j : 4 * j - 3 * i]:
                    return True
    return False


def extract(raw: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, None) or (None, code)."""
    if raw is None or not raw.strip():
        return None, "empty"
    fenced = _FENCE.match(raw)
    text = fenced[1] if fenced else raw
    if looped(text[-_TAIL:]):
        return None, "repetition"
    start = text.find("{")
    if start < 0:
        return None, "no_object"
    end = object_end(text, start)
    if end < 0:
        return None, "truncated"
    rest = text[end:].strip()
    if rest:
        return None, "second_object" if rest.startswith("{") else "trailing_text"
    try:
        value = json.loads(text[start:end], object_pairs_hook=_unique)
    except _Twice:
        return None, "duplicate_key"
    except ValueError:
        return None, "not_json"
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")), None


def _many(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([extract(x) for x in s], columns=["json", "code"], dtype=object)


def extract_json(x: Column) -> Column:
    """STRUCT<json, code> of a raw output."""
    return F.pandas_udf(_many, _SCHEMA)(x)


def greedy_json(x: Column) -> Column:
    """First brace to last brace, unchecked; null without one."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))
