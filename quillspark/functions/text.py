"""Text keys as column expressions: folding, token sets, digests and clock strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F


def _folded() -> tuple[str, str]:
    """Lower-case letters that decompose into a base letter and marks, and their base letters."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and c == c.lower():
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _folded()


def strip_accents(x: Column) -> Column:
    """Letters without their marks; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(x, _FROM, _TO), "\\p{Mn}", "")


def flat(x: Column) -> Column:
    """Lower case, no accents, blanks collapsed; symbols stay."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(x)), r"\s+", " "))


def plain(x: Column) -> Column:
    """ASCII alone: lower case, letters without marks, other symbols dropped, blanks collapsed."""
    folded = F.replace(strip_accents(F.lower(x)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\x00-\x7F]", ""), r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case, no accents, runs of anything but a-z and 0-9 as one blank, trimmed. Symbols vanish."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(x)), "[^a-z0-9]+", " "))


def token_set(normalized: Column) -> Column:
    """Distinct words of a normalized text."""
    return F.array_remove(F.array_distinct(F.split(normalized, " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _folded_text(x: str | None) -> str | None:
    return None if x is None else " ".join((x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold()).split())


def _fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch's texts become Python strings a run of 64 at a time; all else stays packed."""
    for batch in batches:
        runs = [pa.array([_folded_text(x) for x in batch.slice(i, 64).to_pylist()], pa.string()) for i in range(0, len(batch), 64)]
        yield pa.concat_arrays(runs) if runs else pa.array([], pa.string())
        del batch, runs
        pa.default_memory_pool().release_unused()


def text_key(x: Column) -> Column:
    """NFKC, case folded, blanks collapsed. Symbols stay, so '<10' and '>10' differ."""
    return F.arrow_udf(_fold, "string")(x)


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def short_id(*known: Column, text: Column) -> Column:
    """The first known id, else 16 digits of the text's digest."""
    return F.coalesce(*known, F.substring(digest(text), 1, 16))


def clock_minutes(x: Column) -> Column:
    """Minutes of an H:MM string; null where it is none or out of range."""
    h, m = (F.regexp_extract(x, r"^\s*(\d{1,2}):(\d{2})\s*$", i) for i in (1, 2))
    h, m = (F.when(v != "", v).cast("int") for v in (h, m))
    return F.when((h < 24) & (m < 60), h * 60 + m)


def clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def service_seconds(x: Column) -> Column:
    """Seconds of an H:M:S string after the service day's midnight; may exceed a day."""
    p = F.split(x, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def next_weekday(anchor: Column, weekday: Column) -> Column:
    """The next date with that weekday (0 is Monday), the anchor included."""
    return F.date_add(anchor, F.pmod(weekday - F.weekday(anchor), F.lit(7)))
