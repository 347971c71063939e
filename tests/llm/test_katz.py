import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.katz import Unigrams, alpha_of, discounts, katz_scores
from quillspark.llm.queries import held_out


def tokens(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\r\x0b\x0c":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, *([word] if word else []), None]


def brute(docs, k=5):
    """Scores by dictionaries, and the probabilities that each history gives to the known and the unknown words."""
    train = [tokens(t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter((h, w) for t in train for h, w in zip(["<s>", *t[:-1]], t, strict=True))
    model = Unigrams(sum(uni.values()), len(uni), np.array([sum(c == i for c in uni.values()) for i in range(1, k + 2)]), k)
    d = discounts(np.array([sum(c == i for c in bi.values()) for i in range(1, k + 2)]), k)

    def p_uni(w):
        return float(model.p(np.array([uni.get(w, 0)]))[0])

    by_h = {}
    for (h, w), c in bi.items():
        by_h.setdefault(h, {})[w] = c

    def p(h, w):
        seen = by_h.get(h, {})
        total, small = sum(seen.values()), [sum(c == i for c in seen.values()) for i in range(1, k + 1)]
        scale, alpha = alpha_of(np.array([total]), np.array([small]), np.array([sum(p_uni(x) for x in seen)]), d)
        if w in seen:
            c = seen[w]
            return float(scale[0]) * (d[c - 1] if c <= k else 1.0) * c / total
        return float(alpha[0]) * p_uni(w)

    n, v = sum(uni.values()), len(uni)
    rows = {}
    for i, t in docs:
        t = tokens(t)
        rows[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)))
    return rows, uni, by_h, p


def corpus(n=300, seed=3):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "The THE the\nthe"), (n + 4, "hot " * 3000), (n + 5, docs[0][1])]


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_matches_brute_force(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, id string, train double")
    got = {r.doc_id: r for r in katz_scores(df, ~held_out(7, 2), block_tokens=block).collect()}
    want, *_ = brute(docs)
    assert len(got) == len(docs)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one():
    _, uni, by_h, p = brute(corpus())
    for h in [*list(by_h)[:40], "never"]:
        assert sum(p(h, w) for w in uni) + p(h, "an unknown word") == pytest.approx(1, abs=1e-9)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz_scores(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = katz_scores(one, F.lit(False)).collect()
    assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (None, 3, 0, 0, 0.0, 0.0)
