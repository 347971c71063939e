"""Divergence against plain Python over every kept term."""

import random
import re
from collections import Counter, defaultdict

from quillspark.llm.divergence import divergence, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, least, top):
    counts, seen, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        g = (lang or "", source or "")
        counts[g].update(terms(text))
        whole[g[0]].update(terms(text))
        seen[g[0]].update(set(terms(text)))
    out = []
    kept = {lang: [t for t, n in seen[lang].items() if n >= least] for lang, _ in counts}

    def prices(c, lang):
        v, total = len(kept[lang]), sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept[lang]}

    p = {g: prices(c, g[0]) for g, c in counts.items()}
    for g, c in counts.items():
        q = prices(whole[g[0]], g[0])
        pairs = sorted(((-sum(abs(p[g][t] - p[h][t]) for t in p[g]), h[1].encode()) for h in counts if h != g and h[0] == g[0]))
        found = sorted((q[t] - p[g][t], t.encode()) for t in p[g] if c[t] > 0 and p[g][t] > q[t])[:top]
        for part, rows in (("pair", pairs), ("term", found)):
            out += [(*g, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


def corpus(seed=2):
    r = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Été", "日本", "ÜBER", "Same", "same", "don't", "x9y"]
    docs = []
    for _ in range(260):
        source = r.choice(["hot", "hot", "hot", "a", "b", "é", None])
        mine = words if source != "a" else words[:20]
        docs.append((" ".join(r.choice(mine) + r.choice(["", ",", ".", "\n"]) for _ in range(r.randint(0, 25))), r.choice(["en", "en", "de", None]), source))
    return [*docs, (None, "en", "empty"), ("", "fr", "x"), ("rare words here", "fr", "y"), (None, None, ""), ("wak " * 30_000, "en", "long"), *[("wak wbk same Same", "en", "hot")] * 90]


def test_divergence_is_that_of_every_kept_term(spark):
    docs = corpus()
    table = spark.createDataFrame([(i, *d, "z", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in divergence(table, least_docs=12, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected(docs, 12, 7)
    assert any(r[2] == "term" for r in got) and any(r[4] == 0 and r[2] == "pair" for r in got)


def test_no_term_is_kept_and_no_rows(spark):
    docs = [("a b", "en", "x"), ("b c", "en", "y")]
    table = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r)[:5] for r in divergence(table).collect()) == [("en", "x", "pair", "y", 0), ("en", "y", "pair", "x", 0)]
    assert divergence(table.limit(0)).collect() == []


def test_prices_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.divergence import price

    n, total, kept = 4 * 10**15, 9 * 10**18, 10**6
    row = spark.range(1).select(price(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_blocks_change_nothing(spark):
    docs = corpus(4)
    table = spark.createDataFrame(docs, "text string, lang string, source string")
    a, b = (sorted(tuple(r) for r in term_counts(table, block=n).collect()) for n in (1, 1 << 20))
    assert a == b
