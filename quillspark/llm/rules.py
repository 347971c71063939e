"""Quality scores by a sparse rule ensemble over text statistics.

1. A kernel over the Arrow buffers makes a row of statistics of each text: first of a bounded sample of
   labelled rows (`sample`, chosen by a hash of the id; their labels are broadcast), then of all.
2. On the sample boosted trees of depth `depth` are grown; each path from a root is a rule, a conjunction
   of comparisons of statistics.
3. A lasso-penalised logistic regression over the rules keeps few of them; the penalty is the one of
   least loss on a fifth of the sample.
4. The kept rules are compiled into a Spark column expression over the statistics.

Null and empty texts have all statistics 0 and are scored as such. Statistics use whole texts. Rows of
`labels` without id or label are left out, of repeated ids the lowest label holds; with no labels, or
only one, every score is the share of label 1 (1.0 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared
from quillspark.llm.setsketch import shingles

STATISTICS = ["n_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "shouts", "stops", "lines", "distinct", "top_word", "twice", "repeated"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@[]^_`{|}~\\/")] = True


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, len(STATISTICS)); shares are of bytes, words or lines and lie in [0, 1]."""
    data, offsets = K.buffers(column)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)))
    keys, at = K.words(column)
    bytes_n, words_n = np.diff(offsets), np.diff(at)
    full, some = bytes_n > 0, words_n > 0

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    letters, upper, newline = per_row(_LETTER[data]), per_row(_UPPER[data]), per_row(data == 10)
    marks = per_row(_MARK[data])
    n = np.maximum(bytes_n, 1)
    w = np.maximum(words_n, 1)
    gaps = per_row((data == 32) | ((data >= 9) & (data <= 13)))
    put = {name: i for i, name in enumerate(STATISTICS)}
    out[:, put["n_words"]] = words_n
    out[:, put["word_length"]] = np.where(some, (bytes_n - gaps) / w, 0)
    out[:, put["letters"]] = letters / n
    out[:, put["upper"]] = upper / np.maximum(letters, 1)
    out[:, put["digits"]] = per_row(_DIGIT[data]) / n
    out[:, put["marks"]] = marks / n
    out[:, put["symbols"]] = per_row(_SYMBOL[data]) / n
    out[:, put["shouts"]] = per_row(data == 33) / w
    out[:, put["stops"]] = per_row(data == 46) / w
    out[:, put["lines"]] = np.where(full, newline + 1, 0) / w
    # repetition needs a row at a time
    grams, gram_at = shingles(keys, at, 5)
    for i in np.flatnonzero(some):
        own = np.sort(keys[at[i] : at[i + 1]])
        runs = np.diff(K.segments(own), append=len(own))
        out[i, put["distinct"]] = len(runs) / len(own)
        out[i, put["top_word"]] = runs.max() / len(own)
        raw = keys[at[i] : at[i + 1]]
        out[i, put["twice"]] = np.count_nonzero(raw[1:] == raw[:-1]) / len(raw)
        g = np.sort(grams[gram_at[i] : gram_at[i + 1]])
        out[i, put["repeated"]] = np.count_nonzero(g[1:] == g[:-1]) / len(g)
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_over, cut): over means value > cut, else value <= cut."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for i, over, cut in self.tests:
            ok &= x[:, i] > cut if over else x[:, i] <= cut
        return ok

    def column(self) -> Column:
        ok = None
        for i, over, cut in self.tests:
            one = F.col(STATISTICS[i]) > float(cut) if over else F.col(STATISTICS[i]) <= float(cut)
            ok = one if ok is None else ok & one
        return F.when(ok, F.lit(float(self.weight))).otherwise(F.lit(0.0))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, least: int) -> list[tuple[tuple, np.ndarray, float]]:
    """Nodes (tests, rows, mean residual) of a least-squares tree, the root left out."""
    nodes, todo = [], [((), rows)]
    while todo:
        tests, at = todo.pop()
        if tests:
            nodes.append((tests, at, float(residual[at].mean())))
        if len(tests) == depth or len(at) < 2 * least:
            continue
        best = (1e-12, None)
        total, n = residual[at].sum(), len(at)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            count = np.bincount(binned[at, f], minlength=len(c) + 1).cumsum()[:-1]
            left = np.bincount(binned[at, f], residual[at], len(c) + 1).cumsum()[:-1]
            ok = (count >= least) & (n - count >= least)
            gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k))
        if best[1]:
            f, k = best[1]
            low = binned[at, f] <= k
            todo += [((*tests, (f, False, float(cuts[f][k]))), at[low]), ((*tests, (f, True, float(cuts[f][k]))), at[~low])]
    return nodes


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic weights (intercept first, unpenalised) by accelerated proximal gradient.

    Rows on which the same rules hold are one row with a weight.
    """
    n = len(y)
    bits = np.ascontiguousarray(np.packbits(z > 0, axis=1))
    _, first, where = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_index=True, return_inverse=True)
    weight = np.bincount(where).astype(np.float32)
    good = np.bincount(where, y).astype(np.float32)
    x = np.hstack([np.ones((len(first), 1), np.float32), z[first]])
    w = start.copy()
    v, t = w.copy(), 1.0
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        probe = x.T @ (weight * (x @ probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    rate = 4.0 * n / max(norm, 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ v)))
        step = v - rate * (x.T @ (weight * p - good)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w, t = new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.15, seed: int = 4) -> tuple[float, list[Rule]]:
    """(intercept, weighted rules) from statistics and 0/1 labels."""
    share = float(y.mean()) if len(y) else 1.0
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(edge / (1 - edge))), []
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold, train = order[: len(y) // 5], order[len(y) // 5 :]
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[train, f], np.linspace(0.02, 0.98, 33)))
        cuts.append(q[q < x[train, f].max()])
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[tuple, Rule] = {}
    for _ in range(trees):
        rows = rng.choice(train, max(len(train) // 2, min(len(train), 50)), replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        nodes = _grow(binned, cuts, residual, rows, depth, max(5, len(rows) // 500))
        curve = np.maximum((lambda p: p * (1 - p))(1 / (1 + np.exp(-score))), 1e-3)
        parents = {tests[:-1] for tests, _, _ in nodes}
        for tests, _, _ in nodes:
            key = tuple(sorted(tests))
            rules.setdefault(key, Rule(key))
            if tests not in parents:
                inside = Rule(tests).holds(x)
                own = inside & np.isin(np.arange(len(y)), rows)
                score = score + inside * rate * np.clip(residual[own].sum() / curve[own].sum(), -4, 4)
    kept = list(rules.values())
    if not kept:
        return float(np.log(share / (1 - share))), []
    z = np.stack([r.holds(x) for r in kept], axis=1).astype(np.float32)
    best, weights, start = np.inf, None, np.zeros(z.shape[1] + 1, np.float32)
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        start = _lasso(z[train], y[train].astype(np.float32), penalty, start)
        s = start[0] + z[hold] @ start[1:]
        loss = float(np.mean(np.logaddexp(0, s) - y[hold] * s)) if len(hold) else 0.0
        if loss < best - 1e-4 or weights is None:
            best, weights = loss, start.copy()
    return float(weights[0]), [Rule(r.tests, float(w)) for r, w in zip(kept, weights[1:], strict=True) if abs(w) > 1e-3]


def with_statistics(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The carried columns and the statistics of each text, from one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, "__text"):
            x = statistics(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(x[:, i]) for i in range(x.shape[1]))], [*carry, *STATISTICS])

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return docs.select(*carry, F.col(text_col).alias("__text")).mapInArrow(work, schema)


@dataclass(frozen=True)
class RuleModel:
    """A fitted ensemble; `score` compiles it into a column over the statistics."""

    base: float
    rules: list[Rule]

    def score(self) -> Column:
        total = F.lit(self.base)
        for r in self.rules:
            total = total + r.column()
        return 1 / (1 + F.exp(-total))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> RuleModel:
    """A model of the labelled documents where `learn` (over the id) holds; of more than `sample` labels a hash draws about that many."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__y"))
    marked = shared.keep(marked.where(learn), "rule-labels")
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64(id_col, F.lit(4)), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    chosen = docs.select(id_col, F.col(text_col).alias("__words")).join(F.broadcast(marked), id_col)
    # about `sample` rows, put in one order here: a sort by the executors would make the statistics twice
    found = with_statistics(chosen, "__words", [id_col, "__y"]).toPandas().sort_values([id_col, *STATISTICS], kind="stable")
    rows = found[["__y", *STATISTICS]].to_numpy(dtype=float)
    return RuleModel(*fit(rows[:, 1:], (rows[:, 0] > 0).astype(float)))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, cut: float = 0.7) -> DataFrame:
    """Per document: id, held_out, score in [0, 1] and predicted (1 where score >= cut).

    `learn` (over the id) tells which rows labels are learned from; `sample` bounds, up to chance, how many.
    """
    model = learned(docs, labels, learn, id_col, text_col, label_col, sample)
    held = F.coalesce(~learn, F.lit(False))
    table = with_statistics(docs, text_col, [id_col])
    return table.select(id_col, held.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def quality_filter(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, cut: float = 0.7) -> DataFrame:
    """The documents that score at least cut, all columns, without a shuffle of the texts."""
    model = learned(docs, labels, learn, id_col, text_col, label_col, sample)
    # columns travel under names of their own, so that none clashes with a statistic
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    scored = with_statistics(docs.withColumnsRenamed(names), names[text_col], list(names.values()))
    return scored.where(model.score() >= cut).select(*(F.col(n).alias(c) for c, n in names.items()))
