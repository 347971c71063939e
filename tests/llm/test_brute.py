"""Operators and pipeline stages without SQL against plain Python that works another way."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillspark.llm.crossparse import _FOLD, languages, references
from quillspark.llm.curriculum import invert, mix, ramps, targets
from quillspark.llm.packing import place, shard
from quillspark.llm.queries import held_out
from quillspark.llm.rotacode import near_vectors
from quillspark.llm.rules import STATISTICS, Rule, RuleModel, learned, quality_scores, statistics, with_statistics
from quillspark.llm.setsketch import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return WORD.findall(lower(text or ""))


# ---------------------------------------------------------------- quality


def plain_statistics(text):
    data, words = (text or "").encode(), words_of(text)
    n, w = max(len(data), 1), max(len(words), 1)
    letters = sum(chr(b).isalpha() or b >= 128 for b in data if b < 128 or b >= 128)
    counts = Counter(words)
    grams = Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))
    return {
        "n_words": len(words),
        "word_length": sum(len(x.encode()) for x in words) / w if words else 0,
        "letters": letters / n,
        "upper": sum(65 <= b <= 90 for b in data) / max(letters, 1),
        "digits": sum(48 <= b <= 57 for b in data) / n,
        "marks": sum(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in data) / n,
        "symbols": sum(chr(b) in "#$%&*+<=>@[]^_`{|}~\\/" for b in data) / n,
        "shouts": data.count(b"!") / w,
        "stops": data.count(b".") / w,
        "lines": (data.count(b"\n") + 1 if data else 0) / w,
        "distinct": len(counts) / len(words) if words else 0,
        "top_word": max(counts.values()) / len(words) if words else 0,
        "twice": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if words else 0,
        "repeated": sum(c - 1 for c in grams.values()) / sum(grams.values()) if words else 0,
    }


def test_statistics_equal_plain_python():
    r = random.Random(1)
    texts = ["", None, " \n ", "a", "Ä!!", "one one one two. Three\n\nFOUR 5% [x]"] + ["".join(r.choice("ab cD1.!\n\té#") for _ in range(r.randint(0, 200))) for _ in range(300)]
    got = statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        want = plain_statistics(text)
        assert np.allclose(row, [want[s] for s in STATISTICS]), text


def test_rules_as_columns_equal_rules_as_arrays(spark):
    r = random.Random(2)
    x = np.round(np.random.default_rng(2).random((200, len(STATISTICS))), 2)
    rules = [Rule(tuple((r.randrange(len(STATISTICS)), r.random() < 0.5, round(r.random(), 2)) for _ in range(r.randint(1, 3))), r.uniform(-3, 3)) for _ in range(40)]
    rules.append(Rule(((0, True, float(x[5, 0])), (1, False, float(x[5, 1]))), 1.5))  # ties at the cut
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], STATISTICS).coalesce(1)
    got = [row[0] for row in df.select(RuleModel(0.25, rules).score()).collect()]
    want = [1 / (1 + math.exp(-(0.25 + sum(q.weight for q in rules if q.holds(x[i : i + 1])[0])))) for i in range(len(x))]
    assert np.allclose(got, want)


def test_quality_scores_are_the_model_of_each_text(spark):
    r = random.Random(3)
    docs = [(i, ("good words here and there " if i % 3 else "BUY!! ") * r.randint(1, 30)) for i in range(300)] + [(400, None), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    learn = ~held_out(4, 2)
    model = learned(df, labels, learn, "doc_id", "text", "quality", 20_000)
    assert model.rules
    for x in quality_scores(df, labels, learn).collect():
        text = next(t for i, t in docs if i == x.doc_id)
        row = np.array([[plain_statistics(text)[s] for s in STATISTICS]])
        assert x.score == pytest.approx(1 / (1 + math.exp(-(model.base + sum(q.weight for q in model.rules if q.holds(row)[0])))))
    assert with_statistics(df, "text", ["doc_id"]).count() == len(docs)


# ---------------------------------------------------------------- languages


def test_languages_equal_a_greedy_parse(spark):
    r = random.Random(4)
    vocabulary = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(120)] for k, a in {"aa": "abcdefgh", "bb": "efghijkl"}.items()}
    docs = [(i, " ".join(r.choice(vocabulary[k]) for _ in range(r.choice([3, 30, 300]))), k) for i, k in ((i, ("aa", "bb")[i % 2]) for i in range(60))]
    docs += [(100, docs[0][1][:300] + docs[1][1][:400], None), (101, "ÀÉ xyz 12", None), (102, None, "aa"), (103, "!?", "bb")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    learn = ~held_out(3, 1)
    refs = references(df, F.coalesce(learn, F.lit(False)), "text", "lang", 4096, 200)
    bits = {k: math.log2(len(v) + 256) for k, v in refs.items()}
    got = {x.doc_id: x for x in languages(df, learn, reference=4096, excerpt=200).collect()}
    seen = {b for v in refs.values() for b in v}
    for i, text, _ in docs:
        if not text or not re.search(r"[^\W\d_]", text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        folded = bytes(_FOLD[list(text.encode())])
        counts = {}
        for name, ref in refs.items():
            at = n = 0
            while at < len(folded):
                size = 1
                while folded[at] in seen and at + size < len(folded) and folded[at : at + size + 1] in ref:
                    size += 1
                n, at = n + 1, at + size
            counts[name] = n * bits[name] / max(bits.values())
        assert got[i].lang_pred == min(sorted(counts), key=counts.get), (i, counts)
        score = 1 / sum(2 ** (-60.0 * (c - min(counts.values())) / len(folded)) for c in counts.values())
        assert got[i].score == pytest.approx(score)


# ---------------------------------------------------------------- sharding


def test_placing_takes_the_shard_of_the_largest_dot_product():
    r = random.Random(5)
    items = np.array([[r.randint(1, 50), r.randint(0, 9), r.randint(1, 3)] for _ in range(60)], float)
    got = place(items, 4)
    total = items.sum(axis=0)
    share = items / total
    left = [[0.25] * 3 for _ in range(4)]
    for i in sorted(range(60), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        dots = [sum(a * b for a, b in zip(room, share[i], strict=True)) for room in left]
        room = [k for k in range(4) if left[k][0] >= share[i][0] - 1e-12]
        if room:
            assert got[i] in room and dots[got[i]] == pytest.approx(max(dots[k] for k in room))
        else:
            assert left[got[i]][0] == pytest.approx(max(x[0] for x in left))
        left[got[i]] = [a - b for a, b in zip(left[got[i]], share[i], strict=True)]
    loads = np.array([items[got == s].sum(axis=0) for s in range(4)]) / total
    assert loads.max() < 0.3


def test_a_group_over_a_shard_is_cut_evenly(spark):
    docs = [(None, "the same text")] * 4000 + [(i, f"t{i}") for i in range(1000)]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    load, slots = Counter(), defaultdict(list)
    for x in rows:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert len(rows) == 5000 and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# ---------------------------------------------------------------- mixing


def test_mixing_covers_each_target_end_to_end(spark):
    r = random.Random(6)
    docs = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", "hot", "hot", None])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mix(df, cell_rows=50, carry=["source"]).collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    names = [*sorted(x for x in size if x is not None), None]
    goal = targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for rank, (name, want) in enumerate(zip(names, goal, strict=True)):
        mine = [x for x in rows if x.source == name]
        whole = int(want + 0.5)
        # the first passes lie end to end over the demand, in the order of their positions
        first = sorted((x.positions[0], x["size"]) for x in mine if x.positions)
        at, starts = 0, []
        for _, n in first:
            starts.append(at)
            at += n
        assert np.allclose([p for p, _ in first], invert(ramps(rank), np.array(starts) / whole), atol=1e-9)
        for x in mine:
            assert len(x.positions) == sum(p < 1.0 or x["size"] > 0 for p in x.positions) and x.positions == sorted(x.positions)
        assert sum(x.taken for x in mine) == whole
        cut = [x for x in mine if x.taken not in (0, x["size"], 2 * x["size"], 3 * x["size"])]
        assert len(cut) <= 1


# ---------------------------------------------------------------- row identity


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(items, linked):
    """Component of each item, by linking every pair."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def alike(percent):
    def test(a, b):
        both, every = len(a & b), len(a | b)
        return both > 0 and 100 * both >= percent * every

    return test


def family(r, tag, n, copies, edits):
    base = [f"{tag}{r.randrange(9999)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        x = list(base)
        for _ in range(r.randint(0, edits)):
            x[r.randrange(n)] = f"{tag}new{r.randrange(9999)}"
        out.append(" ".join(x))
    return out


def test_near_duplicates_by_rows_equal_all_pairs(spark):
    r = random.Random(7)
    texts = [t for k in range(12) for t in family(r, f"k{k}", r.choice([6, 40, 120]), r.randint(1, 9), 4)] + ["", None, "one two", "ONE  two", "one two"]
    rows = [(r.choice([None, r.randrange(30), r.randrange(30)]), t) for t in texts]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=8).collect()
    sets = [shingle_set(t) for _, t in rows]
    label = groups(sets, alike(85))
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, len(s), least[c] if s else i) for (i, _), s, c in zip(rows, sets, label, strict=True))
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    assert sum(x.kept for x in got) == len({c for s, c in zip(sets, label, strict=True) if s}) + sum(not s for s in sets)


def test_a_large_cluster_of_near_copies_loses_no_link(spark):
    """Many distinct near copies, of which few are near the first: stars alone don't join them."""
    r = random.Random(8)
    rows = [(i, t) for i, t in enumerate(family(r, "a", 200, 160, 3))]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=16).collect()}
    label = groups([shingle_set(t) for _, t in rows], alike(85))
    least = {c: min(i for (i, _), d in zip(rows, label, strict=True) if d == c) for c in set(label)}
    assert got == {i: least[c] for (i, _), c in zip(rows, label, strict=True)}


def test_near_vectors_by_rows_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6, 16))
    vectors = [(base[i % 6] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.08])).tolist() for i in range(90)]
    vectors += [vectors[0]] * 20 + [[0.0] * 16, None, [math.nan] * 16, [2 * x for x in vectors[1]], []]
    r = random.Random(9)
    rows = [(r.choice([None, r.randrange(40), r.randrange(40)]), r.choice(["x", "y", None]) if i >= 90 else "x", v) for i, v in enumerate(vectors)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3), chunk=16).collect()

    def usable(v):
        return v and all(math.isfinite(c) for c in v) and any(v)

    def linked(a, b):
        (_, la, va), (_, lb, vb) = a, b
        if la is None or la != lb or not usable(va) or not usable(vb):
            return False
        return np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98

    label = groups(rows, linked)
    least = {}
    for (i, *_), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((x[0], sum(linked(x, y) for k, y in enumerate(rows) if k != j), least[label[j]]) for j, x in enumerate(rows))
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == want
    assert sum(x.kept for x in got) == len(set(label))


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(10)
    at = tmp_path_factory.mktemp("tables")
    texts = [t for k in range(25) for t in family(r, f"w{k}", 60, r.randint(1, 4), 3)]
    items = [[f"q{k}x{i}" for i in range(30)] for k in range(4)]
    texts += [" ".join([*(f"c{k}{i}" for i in range(20)), *items[k], "end"]) for k in range(4)] + ["", None, " ", "BUY NOW!! " * 40]
    rows = [(r.choice([None, i, i, 5]), t, "en", r.choice(["a", "b", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, items


def test_near_dedup_keeps_a_row_of_each_group(spark, folder):
    at, rows, _ = folder
    kept = pipeline.near_dedup(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()
    sets = [shingle_set(x[1]) for x in rows]
    label = groups(sets, alike(80))
    want = len({c for s, c in zip(sets, label, strict=True) if s}) + sum(not s for s in sets)
    assert len(kept) == want and not Counter(map(tuple, kept)) - Counter(rows)
    by_text = {x[1]: c for x, c in zip(rows, label, strict=True)}
    alone = [by_text[x.text] for x in kept if shingle_set(x.text)]
    assert len(alone) == len(set(alone))


def test_decontaminate_takes_rows_with_items_only(spark, folder):
    at, rows, items = folder
    kept = pipeline.decontaminate(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()
    dirty = [x for x in rows if any(" ".join(i) in (x[1] or "") for i in items)]
    assert len(dirty) == 4 and Counter(map(tuple, kept)) == Counter(rows) - Counter(dirty)


def test_mixing_emits_a_row_for_each_pass(spark, folder):
    at, rows, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = Counter(map(tuple, pipeline.mixing(spark, docs, at).collect()))
    size = Counter()
    for x in rows:
        size[x[3]] += len(words_of(x[1]))
    names = [*sorted(x for x in size if x is not None), None]
    goal = dict(zip(names, targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    words = Counter()
    for x, n in out.items():
        words[x[3]] += n * len(words_of(x[1]))
    longest = max(len(words_of(x[1])) for x in rows)
    # whole documents: no target is missed by more than its last one
    assert all(goal[s] - 1 <= words[s] <= goal[s] + longest for s in names)
    assert all(n <= 3 * rows.count(x) for x, n in out.items())


def test_many_rows_of_one_id_or_text_don_t_multiply(spark):
    rows = [(None, "one text of six words here", "en", "s", 1)] * 40 + [(1, f"text {i} of id one here", "en", "s", 1) for i in range(30)] + [(2, "another text of its own here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert Counter(map(tuple, pipeline.mixing(spark, docs, "").collect())) == Counter(rows)


def test_run_applies_all_stages(spark, folder):
    at, rows, _ = folder
    last = pipeline.run(spark, at).collect()
    assert last and {x.shard for x in last} <= set(range(8)) and not {zlib.crc32((x[1] or "").encode()) for x in rows if "q0x0" in (x[1] or "")} & {x.text_crc32 for x in last}
    slots = defaultdict(list)
    for x in last:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_benchmark_parts_meet_by_row(spark, folder):
    from quillspark.llm.decontaminate import contamination

    at, rows, _ = folder
    docs, benchmark = (spark.read.parquet(f"{at}/{x}.parquet") for x in ("documents", "benchmark"))
    whole, parts = (Counter(map(tuple, contamination(docs, benchmark, part_bytes=n).collect())) for n in (1 << 20, 60))
    assert whole == parts and sum(whole.values()) == len(rows)
