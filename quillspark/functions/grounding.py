"""Whether a contract's values are said in the user's text, as column expressions.

All of it is built-in expressions over the folded text: arrays of words and numbers, searched by
higher-order functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.text import normalize_text, strip_accents

#: Number words.
NUMBER_WORDS = {
    "zero": 0, "uno": 1, "una": 1, "un": 1, "due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6, "sette": 7, "otto": 8, "nove": 9,
    "dieci": 10, "undici": 11, "dodici": 12, "tredici": 13, "quattordici": 14, "quindici": 15, "sedici": 16, "diciassette": 17,
    "diciotto": 18, "diciannove": 19, "venti": 20, "trenta": 30, "quaranta": 40, "cinquanta": 50, "sessanta": 60, "settanta": 70,
    "ottanta": 80, "novanta": 90, "cento": 100, "duecento": 200, "trecento": 300, "quattrocento": 400, "cinquecento": 500,
    "mille": 1000, "duemila": 2000, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "twenty": 20, "fifty": 50, "hundred": 100, "thousand": 1000,
}
#: What in a text allows a currency.
CURRENCY_ANCHORS = {"EUR": ["€", "euro", "eur", "euri"], "USD": ["$", "dollar", "usd"], "GBP": ["£", "sterlin", "gbp", "pound"], "CHF": ["chf", "franch"]}
#: Other words that mean a value.
ALIASES = {
    "female": ["femmina", "femminile", "f", "female"], "male": ["maschio", "maschile", "m", "male"],
    "new": ["nuovo", "nuova", "new"], "used": ["usato", "usata", "used", "second hand", "seconda mano"],
    "refurbished": ["ricondizionato", "ricondizionata", "refurbished"],
    "direct": ["diretto", "diretta", "senza scalo", "senza scali", "direct", "nonstop", "non stop"],
    "diretto": ["diretto", "diretta", "senza scalo", "senza scali", "direct", "nonstop", "non stop", "no stopover"],
    "eur": ["euro", "eur", "€", "euri"], "usd": ["dollari", "dollaro", "usd", "$"], "gbp": ["sterline", "gbp", "£"],
}
#: Operators and properties that decide a bucket.
NEGATIVE = ["neq", "excludes", "not_in"]
ORDERING = ["lt", "lte", "gt", "gte", "between", "within", "before", "after"]
SELECTION = ["price", "budget", "cost", "location", "distance", "radius", "area", "time", "date", "deadline", "destination", "origin", "route", "departure_time", "arrival_time", "departure_date", "return_date", "check_in", "check_out", "availability", "delivery", "delivery_time"]


def folded(text: Column) -> Column:
    return strip_accents(F.lower(text))


def words_of(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the folded text."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def numbers_of(text: Column) -> Column:
    """Numbers that a text holds: digits with a decimal point or comma, number words, hours and minutes."""
    flat = folded(text)
    digits = F.transform(F.regexp_extract_all(flat, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    table = _map({k: float(v) for k, v in NUMBER_WORDS.items()})
    said = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"(\w+)"), F.lit(1)), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    hours = F.transform(F.regexp_extract_all(flat, F.lit(r"(\d{1,2})[:.]\d{2}"), F.lit(1)), lambda x: x.cast("double"))
    minutes = F.transform(F.regexp_extract_all(flat, F.lit(r"\d{1,2}[:.](\d{2})"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_distinct(F.concat(digits, said, hours, minutes))


def _inflects(word: Column, other: Column) -> Column:
    """One word is the other but for its ending: same first three letters, lengths within three."""
    stem = F.substring(word, F.lit(1), F.length(word) - 1)
    tail = F.when(F.length(other) > 3, F.substring(other, F.lit(1), F.length(other) - 1)).otherwise(other)
    near = (F.abs(F.length(word) - F.length(other)) <= 3) & (F.substring(word, 1, 3) == F.substring(other, 1, 3))
    return (word == other) | ((F.length(word) >= 4) & near & (F.startswith(other, stem) | F.startswith(word, tail)))


def _said(part: Column, words: Column, numbers: Column, flat: Column) -> Column:
    """Whether one scalar, as text, is said."""
    as_number = F.replace(part, F.lit(","), F.lit(".")).try_cast("double")
    hour = F.regexp_extract(part, r"^(\d{1,2})[:.]\d{2}$", 1).try_cast("double")
    tokens = F.filter(F.regexp_extract_all(folded(part), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1)
    other = F.try_element_at(F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), folded(part))
    return (
        F.when(part == "", True)
        .when(part.rlike(r"^-?\d+(?:[.,]\d+)?$"), F.array_contains(numbers, as_number))
        .when(part.rlike(r"^\d{1,2}[:.]\d{2}$"), F.array_contains(numbers, hour))
        .when(F.coalesce(F.exists(other, lambda a: F.contains(flat, a)), F.lit(False)), True)
        .otherwise(F.forall(tokens, lambda t: F.exists(words, lambda w: _inflects(t, w))))
    )


def value_is_grounded(value: Column, text: Column) -> Column:
    """Whether a value (as text; lists as a|b|c) is said in the text; null values are, and so are booleans, which callers know by their kind."""
    return said_in(value, words_of(text), numbers_of(text), folded(text))


def said_in(value: Column, words: Column, numbers: Column, flat: Column) -> Column:
    """The same over a text's words, numbers and folded form, made once for many values."""
    parts = F.filter(F.transform(F.split(value, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(value.isNull(), True).otherwise(F.forall(parts, lambda p: _said(p, words, numbers, flat)))


def currency_is_grounded(currency: Column, text: Column) -> Column:
    """Whether the text names the currency; no currency needs no name, an unknown one has none."""
    anchors = F.create_map(*(x for k, v in CURRENCY_ANCHORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    flat = folded(text)
    found = F.try_element_at(anchors, F.upper(currency))
    return F.when(currency.isNull() | (currency == ""), True).when(found.isNull(), False).otherwise(F.exists(found, lambda a: F.contains(flat, a)))


def action_is_grounded(raw: Column, text: Column) -> Column:
    """Whether the words of an action are the user's; one word may differ in its ending."""
    action, flat = normalize_text(raw), normalize_text(text)
    tokens = F.split(action, " ")
    one = (F.size(tokens) == 1) & (F.length(action) >= 4)
    stem = F.exists(F.split(flat, " "), lambda w: F.startswith(w, F.substring(action, 1, 4)))
    return F.when(raw.isNull() | (raw == ""), False).when(action == "", True).when(F.contains(flat, action), True).when(one, stem).otherwise(F.forall(tokens, lambda t: F.contains(flat, t)))


def has_any(text: Column, markers: list[str]) -> Column:
    """Whether the folded text holds one of the markers (folded here)."""
    flat = folded(text)
    return F.exists(F.transform(F.array(*map(F.lit, markers)), folded), lambda m: F.contains(flat, m))


def literal_span(value: Column, text: Column) -> Column:
    """STRUCT<start, end> (0-based, end exclusive) of a value's first whole-word mention, or null; case doesn't count."""
    quoted = F.concat(F.lit(r"(?iu)(?<!\w)\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    at = F.regexp_instr(text, quoted)
    return F.when((F.length(value) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end")))


def bucket(property_name: Column, operator: Column) -> Column:
    """The bucket that operator and property alone decide."""
    return F.when(operator.isin(NEGATIVE) | property_name.isin(SELECTION) | operator.isin(ORDERING), "constraints").otherwise("attributes")
