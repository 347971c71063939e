"""Python functions of a row as column functions over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F


def rowwise(schema: str, f: Callable[..., Any]) -> Callable[..., Column]:
    """A column function for f, whose arguments are a row's values; a tuple becomes a struct of `schema` ("a int, b string")."""
    struct = " " in schema.strip()
    names = [x.strip().split()[0] for x in _split(schema)] if struct else []

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield _out(map(f, s))

    def one_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield _out(map(f, s))

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield _out(f(*r) for r in zip(*columns, strict=True))

    def many_struct(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield _out(f(*r) for r in zip(*columns, strict=True))

    def _out(rows):
        rows = list(rows)
        return pd.DataFrame(rows, columns=names, dtype=object) if struct else pd.Series(rows, dtype=object)

    def column(*columns: Column) -> Column:
        run = (one_struct if struct else one) if len(columns) == 1 else (many_struct if struct else many)
        return F.pandas_udf(run, schema)(*columns)

    return column


def _split(schema: str) -> list[str]:
    """The fields of a schema; commas inside <> don't part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def loaded(raw: str | None) -> Any:
    """The value of a JSON text, or None."""
    try:
        return json.loads(raw) if isinstance(raw, str) else None
    except ValueError:
        return None


_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def dumped(value: Any) -> str:
    return _ENCODER.encode(value)
