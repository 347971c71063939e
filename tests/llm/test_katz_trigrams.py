"""The trigram model against dictionaries, with nothing of the module's own."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm.katz import discounts, katz_scores
from quillspark.llm.queries import held_out

K = 5


def good_turing(counts):
    """Katz's ratios for counts 1..cut, the largest cut up to K for which all are in (0, 1]."""
    n = Counter(counts)
    for cut in range(K, 1, -1):
        if all(n[i] for i in range(1, cut + 1)):
            tail = (cut + 1) * n[cut + 1] / n[1]
            if tail != 1:
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, cut + 1)}
                if all(0 < x <= 1 for x in d.values()):
                    return d
    return {r: (r - 0.5) / r for r in range(1, K + 1)}


class Model:
    def __init__(self, texts):
        self.counts = [Counter(), defaultdict(Counter), defaultdict(Counter)]
        for t in texts:
            for i, w in enumerate(t):
                self.counts[0][w] += 1
                self.counts[1][t[i - 1] if i else "<s>"][w] += 1
                if i:
                    self.counts[2][(t[i - 2] if i > 1 else "<s>"), t[i - 1]][w] += 1
        self.d = [good_turing(self.counts[0].values()), *(good_turing([c for x in level.values() for c in x.values()]) for level in self.counts[1:])]
        self.alphas = {}

    def after(self, seen, d, lower):
        total = sum(seen.values())
        left = sum((1 - d.get(c, 1)) * c for c in seen.values())
        scale = 1.0 if left > 0 else total / (total + 1)
        return scale, (left / total if left > 0 else 1 / (total + 1)) / (1 - sum(lower(w) for w in seen))

    def p(self, history, w):
        """P after a history of 0, 1 or 2 words."""
        order, d = len(history), self.d[len(history)]
        if not order:
            n, left = sum(self.counts[0].values()), sum((1 - d.get(c, 1)) * c for c in self.counts[0].values())
            c = self.counts[0].get(w, 0)
            return d.get(c, 1) * c / n if c else left / n
        seen = self.counts[order].get(history if order > 1 else history[0])
        if not seen:
            return self.p(history[1:], w)
        if history not in self.alphas:
            self.alphas[history] = self.after(seen, d, lambda x: self.p(history[1:], x))
        scale, alpha = self.alphas[history]
        c = seen.get(w, 0)
        return scale * d.get(c, 1) * c / sum(seen.values()) if c else alpha * self.p(history[1:], w)

    def score(self, t):
        marked = ["<s>", *t]
        return sum(math.log10(self.p(tuple(marked[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))


def texts(n=260, seed=5):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(1500)]
    phrases = [[r.choice(words) for _ in range(r.randint(2, 6))] for _ in range(150)]
    docs = [" ".join(w for _ in range(r.randint(0, 9)) for w in r.choice(phrases)) for _ in range(n)]
    return [*docs, "", None, "hot " * 2000, "The the THE", "hot cold hot", docs[0], "only here " * 6]


def split(t):
    return [*(t or "").lower().split(), None]


@pytest.mark.parametrize("block", [10, 300, 1_000_000])
def test_trigrams_match_dictionaries(spark, block):
    docs = list(enumerate(texts()))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    model = Model([split(t) for i, t in docs if not held[i]])
    got = {r.doc_id: r for r in katz_scores(spark.createDataFrame(docs, "doc_id long, text string"), ~held_out(7, 2), order=3, block_tokens=block).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        t = split(t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known) == (held[i], len(t), sum(model.counts[0][w] > 0 for w in t))
        assert got[i].score == pytest.approx(model.score(t), rel=1e-9), i


def test_dictionaries_sum_to_one():
    model = Model([split(t) for t in texts()])
    histories = [*list(model.counts[2])[::40], ("never", "w1"), ("w1", "never")]
    for h in histories:
        assert sum(model.p(h, w) for w in model.counts[0]) + model.p(h, "an unknown word") == pytest.approx(1, abs=1e-9)


def test_the_query_uses_two_words_of_history(spark, tmp_path):
    """After "a b" comes x, after "c b" comes y; of bigram order, both go on alike."""
    from quillspark.llm.queries import op1_katz_backoff

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, "a b x" if i % 2 else "c b y") for i in ids] + [(1000 + i, "a b x" if i % 2 else "a b y") for i in range(80)]
    rows = [(i, t) for i, t in rows if i < 1000 or zlib.crc32(str(i).encode()) % 7 == 2]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.text: r.score for r in op1_katz_backoff(spark, str(tmp_path)).join(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id").where("held_out").collect()}
    assert got["a b x"] - got["a b y"] > 1


def test_discounts_lower_the_cutoff_before_they_give_up_good_turing():
    d = discounts(np.array([100, 40, 20, 12, 8, 30]), 5)
    tail = 5 * 8 / 100
    assert d[:4] == pytest.approx([((r + 1) * b / a / r - tail) / (1 - tail) for r, a, b in ((1, 100, 40), (2, 40, 20), (3, 20, 12), (4, 12, 8))])
    assert d[4] == 1
