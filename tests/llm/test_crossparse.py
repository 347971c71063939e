import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm.crossparse import languages, references

R = random.Random(11)
WORDS = {k: ["".join(R.choice("abcdefgh") for _ in range(R.randint(3, 9))) for _ in range(400)] for k in ("aa", "bb")}


def prose(lang, n):
    return " ".join(R.choice(WORDS[lang]) for _ in range(n))


def right(spark, labelled):
    """The share of 60 unlabelled texts whose language is found, by language."""
    asked = [(k, prose(k, 40)) for k in ("aa", "bb") for _ in range(60)]
    rows = [*((i, t, k, True) for i, (k, t) in enumerate(labelled)), *((10_000 + i, t, None, False) for i, (_, t) in enumerate(asked))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean").repartition(3)
    got = {x.doc_id: x.lang_pred for x in languages(df, F.col("learn")).collect()}
    return {k: sum(got[10_000 + i] == k for i, (x, _) in enumerate(asked) if x == k) / 60 for k in ("aa", "bb")}


CASES = {
    # copies of one short text are most of the rows
    "copies": lambda: [(k, prose(k, 60)) for k in ("aa", "bb") for _ in range(80)] + [("bb", prose("bb", 8))] * 2000,
    # texts of a few words each
    "short": lambda: [("aa", prose("aa", 200)) for _ in range(80)] + [("bb", prose("bb", 4)) for _ in range(1500)],
    # every text begins with the same 3,000 bytes
    "header": lambda: [(k, "header line " * 250 + prose(k, 400)) for k in ("aa", "bb") for _ in range(80)],
    # one language has little labelled text in all
    "little": lambda: [("aa", prose("aa", 400)) for _ in range(80)] + [("bb", prose("bb", 50)) for _ in range(3)],
}


@pytest.mark.parametrize("case", CASES)
def test_languages_with_uneven_labelled_text(spark, case):
    assert min(right(spark, CASES[case]()).values()) >= 0.95


def test_references_are_full_distinct_and_from_anywhere(spark):
    texts = [prose("aa", 300) for _ in range(60)] + [prose("aa", 3) for _ in range(40)]
    rows = [(t, "aa") for t in texts] + [("One short text", "aa"), ("one SHORT text", "aa")] * 2000 + [(t, "bb") for t in texts[:3]] + [(None, "bb"), (" ", "bb"), ("x y", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = references(df.repartition(5), F.lit(True), "text", "lang", 16_384, 512)
    assert got == references(df.repartition(2), F.lit(True), "text", "lang", 16_384, 512)
    assert len(got["aa"]) == 16_384 and len(got["bb"]) == 3 * 512 + 2 and sorted(got) == ["aa", "bb"]
    assert got["aa"].count(b"one short text") <= 1
    starts = [next(t.find(x.decode()) for t in texts if x.decode() in t) for x in (got["bb"][i * 513 : i * 513 + 512] for i in range(3))]
    assert max(starts) > 0
