import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import kernel as K
from quillspark.llm.crossparse import LANE, Automaton, Parser, languages
from quillspark.llm.curriculum import invert, mix, ordered, ramps, targets
from quillspark.llm.decontaminate import contamination, search
from quillspark.llm.packing import shard
from quillspark.llm.piecebpe import Merger, PieceModel, token_counts
from quillspark.llm.queries import held_out
from quillspark.llm.rules import Rule, quality_filter, quality_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edits(item, text):
    """Least edits of the item against any run of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_words_hash_like_python_splits_them():
    r = random.Random(1)
    texts = ["", None, " a  B\tb\n", "é É", "x" * 5000, *("".join(r.choice("aB é\n\t.") for _ in range(r.randrange(60))) for _ in range(300))]
    keys, offsets = K.words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
        got = keys[offsets[i] : offsets[i + 1]].tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_words_across_pieces(monkeypatch):
    texts = pa.array(["aa bb " * 50, "c" * 300, "", "dd ee"])
    want = K.words(texts)
    monkeypatch.setattr(K, "PIECE", 64)
    got = K.words(texts)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packing_of_arrays_round_trips(n):
    r = np.random.default_rng(n)
    x = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    data = K.pack_sorted(x) + K.pack(x)
    a, at = K.unpack_sorted(data)
    b, end = K.unpack(data, at)
    assert np.array_equal(a, x) and np.array_equal(b, x) and end == len(data)


def test_search_is_the_least_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        item = [r.randrange(4) for _ in range(r.randint(1, 9))]
        text = [r.randrange(4) for _ in range(r.randint(0, 20))]
        want = edits(item, text)
        got = search(np.array(item), np.array(text, int), len(item))[0]
        assert got == want or (want == len(item) and got >= want)


def contaminated_corpus():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(6, 50))] for _ in range(25)] + [["solo"], ["two", "words"]]
    docs = []
    for i in range(400):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if i % 3 == 0:
            item = list(r.choice(items))
            for _ in range(r.randint(0, max(0, int(0.25 * len(item))))):
                at = r.randrange(len(item))
                kind = r.randrange(3)
                item = item[:at] + ([] if kind == 0 else ["edit"] if kind == 1 else [item[at], "more"]) + item[at + 1 :]
            at = r.randint(0, len(words))
            words = words[:at] + item + words[at:]
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else "\n ".join(words)))
    return docs + [(400, None), (401, "")], [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, ""), (91, None)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 1500])
def test_contamination_matches_brute_force(spark, part_bytes):
    docs, items = contaminated_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in contamination(d, b, part_bytes=part_bytes).collect()}
    n = found = 0
    for i, t in docs:
        words = [w.lower() for w in WORD.findall(t or "")]
        want = set()
        for j, x in items:
            x = WORD.findall(x or "")
            if x and edits(x, words) <= int(0.2 * len(x) + 1e-9):
                want.add(j)
        n, found = n + len(want), found + got[i].n_items
        assert got[i].n_items <= len(want)
    assert len(got) == len(docs) and n > 80 and found >= 0.98 * n


def test_automaton_counts_phrases_like_a_greedy_parse():
    r = random.Random(3)
    reference = bytes(r.choice(b"abc ") for _ in range(300))
    parser = Parser({"x": reference})
    texts = ["".join(r.choice("abc d") for _ in range(r.randint(0, 5 * LANE))) for _ in range(100)]
    # phrases as long as lanes, which the parses of lanes cross
    texts += [reference.decode()[r.randint(0, 9) :] * r.randint(1, 12) for _ in range(40)] + ["", "d" * 3000, "a" * 2000]
    for text in texts:
        want, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1].encode() in reference:
                n += 1
            want, at = want + 1, at + n
        assert parser.phrases(pa.array([text]))[0, 0] == want
    long = bytes(r.choice(b"abc ") for _ in range(4000))
    parser, text = Parser({"x": long}), (long[7:] + b"d" + long[100:3000] + long).decode()
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1].encode() in long:
            n += 1
        want, at = want + 1, at + n
    assert parser.phrases(pa.array(["b", text, "a c"]))[1, 0] == want
    assert len(Automaton(b"").next) == 1


def test_languages(spark):
    r = random.Random(4)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 9))) for _ in range(300)] for k, a in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éèabmno"}.items()}
    docs = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(5, 200))), k) for i, k in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(300))]
    docs += [(300, None, "aa"), (301, "", "bb"), (302, "123 !?", "cc"), (303, docs[0][1], None), (304, docs[1][1] * 300, None)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, held string")
    got = {x.doc_id: x for x in languages(df, ~held_out(3, 1)).collect()}
    held = [d for d in docs[:300] if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.95 * len(held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i, *_ in docs)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    assert got[304].lang_pred == "bb"
    none = languages(df, F.lit(False)).collect()
    assert {x.lang_pred for x in none} == {"und"} and languages(df.limit(0), F.lit(True)).count() == 0


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(P.path("piece_bpe_32k.model"))
    model, library = PieceModel.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    odd = ["", None, " ", "  ", "\n", " \n ", "▁", "▁▁a", "<s> </s> <0x41>", "日本語テキスト", "🎉🎉 x", "\x00a", "the" * 1000, "ab" * 3000, "".join(r.choice("theandiwsom") for _ in range(5000)), "ананасы" * 700, "ha" * 50 + "=" * 2000 + "x" * 999, " " * 40 + "x", "x" + " " * 33, "a\r\nb", "ﬁ ①"]
    odd += ["".join(r.choice("ab eé▁ \n\t日x.,-_1🎉\r{}") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    want = [len(library.encode(x or "")) for x in odd]
    assert Merger(model).counts(pa.array(odd, pa.string())).tolist() == want
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(odd)], "doc_id long, text string, id int")
    got = {x.doc_id: x for x in token_counts(df, model, limit=50).collect()}
    assert [(got[i].n_tokens, got[i].n_bytes, got[i].over_limit) for i in range(len(odd))] == [(n, len((t or "").encode()), n > 50) for n, t in zip(want, odd, strict=True)]
    assert token_counts(df.limit(0), model).count() == 0


def test_quality_learns_and_keeps_edges(spark):
    r = random.Random(7)
    good = lambda: " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200))) + "."
    bad = lambda: r.choice([lambda: "BUY NOW!! " * r.randint(5, 60), lambda: "$$$ %%% " * r.randint(5, 60), lambda: "word " * r.randint(30, 300)])()
    docs = [(i, good() if i % 4 else bad()) for i in range(600)]
    extra = [(600, None), (601, ""), (602, "x " * 50000), (None, "a b")]
    df = spark.createDataFrame([(*d, 0.5, "q") for d in docs + extra], "doc_id long, text string, upper double, quality string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_scores(df, labels, ~held_out(4, 2)).collect()}
    assert len(got) == 604 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == (i % 4 > 0) for i in held) >= 0.97 * len(held)
    kept = quality_filter(df, labels, ~held_out(4, 2))
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}
    nothing = quality_scores(df, labels.limit(0), F.lit(True)).collect()
    assert all(x.predicted == 1 for x in nothing) and quality_scores(df.limit(0), labels, F.lit(True)).count() == 0
    assert Rule(((0, True, 2.0),)).holds(np.array([[1.0], [3.0]])).tolist() == [False, True]


def test_shards(spark):
    r = random.Random(8)
    docs = [(i, "w " * int(r.paretovariate(1) * 5)) for i in range(2000)] + [(3000 + i, "hot text") for i in range(900)] + [(5000, None), (5001, ""), (5001, ""), (None, "z")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, shard int")
    rows = shard(df, bundles=64).collect()
    assert len(rows) == len(docs)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for x in rows:
        by.setdefault(x.shard, []).append(x)
    assert sorted(by) == list(range(8)) and {x.law for x in rows} == {"bytes"} and {x.grown_shard for x in rows} == {None}
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    load = [sum(x.size for x in v) for v in by.values()]
    assert max(load) < 1.1 * min(load)
    whole = {}
    for x in rows:
        if x.size != len("hot text") + 1:  # that group is over a shard's share of rows
            assert whole.setdefault(x.text_crc32, x.shard) == x.shard or x.text_crc32 == 0
    assert shard(df.limit(0)).count() == 0


def test_targets_and_schedules():
    assert targets([100, 10, 100], [1, 2, 3]) == [45.0, 30.0, 135.0]
    assert targets([0, 0], [1, 2]) == [0.0, 0.0]
    y = np.linspace(0, 1, 101)
    for rank in range(3):
        t = invert(ramps(rank), y)
        (_, a), (_, b) = ramps(rank)
        assert np.allclose(a * t + (b - a) * t * t / 2, y) and np.all(np.diff(t) > 0)
    assert np.allclose(invert([(0, 0), (0.5, 2), (1, 0)], y), [0.5 * v**0.5 * 2**0.5 if v <= 0.5 else 1 - 0.5 * (2 * (1 - v)) ** 0.5 for v in y])


def test_mixing(spark):
    r = random.Random(9)
    docs = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "É", "hot", "hot", "hot", None])) for i in range(1500)] + [(2000, None, "a"), (2001, "x y", "tiny"), (None, "x", "b")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    mixed = mix(df, cell_rows=50)
    rows = mixed.collect()
    again = mix(df, cell_rows=50).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(docs)
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = [*sorted(x for x in size if x is not None), None]
    goal = dict(zip(names, targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for x in rows:
        assert x.source_size == size[source[x.doc_id]] and abs(x.target - goal[source[x.doc_id]]) < 1e-6 and x.taken <= 3 * x["size"]
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    path = ordered(mixed).collect()
    assert [x.position for x in path] == sorted(x.position for x in path) and len(path) == sum(len(x.positions) for x in rows)
    assert mix(df.limit(0)).count() == 0
