"""Alignment of two tokenizers against whole encodings by both libraries and byte offsets."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm.align import Aligner, Transducer, aligned, stretches

public_tokenizers = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A_JSON, B_MODEL = Path(A_PATH).read_text(encoding="utf-8"), Path(B_PATH).read_bytes()


def letters():
    """Byte-level characters, from the library's own decoder table: printable Latin-1 stands for itself."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def whole(texts):
    """Per text: groups and links of the libraries' whole encodings, by byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    to_byte = letters()
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs = [bytes(to_byte[c] for c in t) for t in x.tokens]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            out.append(([], []))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (xs, ys)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for end in common:
            i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((x.ids[i:i2], y[j:j2]))
            i, j = i2, j2
        links, starts = [], [[0, *e[:-1]] for e in ends]
        j = 0
        for i in range(len(xs)):
            while ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(ys) and starts[1][k] < ends[0][i]:
                links.append((x.ids[i], y[k]))
                k += 1
        out.append((groups, links))
    return out


def expected(texts):
    found = whole(texts)
    count = Counter(p for _, links in found for p in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), text))
    return rows


def texts(seed=3):
    r = random.Random(seed)
    words = ["hello", "world", "don't", "Überraschung", "été", "日本語", "naïve", "x86_64", "3.14159", "foo_bar", "https://a.b/c?d=e", "😀", "Ж", "the", "of"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\t ", " \n ", " ", "  ", "   ", "　 ", " \u0085"]
    out = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60))) for _ in range(150)]
    odd = [None, "", " ", "  ", " a", "a ", "▁", "a ▁b", "<s> </s> <|endoftext|> <unk>", "\x00 a \x7f b", "a" * 3000, "ab " * 3000, "日本" * 900, "é", "a\r\nb", "ｆｕｌｌ　ｗｉｄｔｈ x", "a  b ᠎ c"]
    return [*out, *odd, out[0], out[0]]


@pytest.mark.parametrize("held", [1 << 20, 20, 0])
def test_alignment_is_that_of_whole_encodings(spark, held):
    docs = texts()
    table = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(docs)], "doc_id long, text string, n_a string, row int").repartition(3)
    got = {r.doc_id: r for r in aligned(table, A_JSON, B_MODEL, held=held, hashed=False).collect()}
    assert len(got) == len(docs)
    for i, want in enumerate(expected(docs)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want, docs[i]


def test_null_and_repeated_ids_and_hashes(spark):
    table = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c"), (2, None), (3, "▁")], "doc_id long, text string")
    got = sorted((tuple(r) for r in aligned(table, A_JSON, B_MODEL).collect()), key=repr)
    want = [((i, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")) for i, w in zip([None, 1, 1, 2, 3], expected(["a b", "a b", "c", None, "▁"]), strict=True)]
    assert got == sorted(want, key=repr)
    assert aligned(table.limit(0), A_JSON, B_MODEL).collect() == []


def test_what_is_remembered_changes_nothing():
    docs = pa.array([t or "" for t in texts(5)], pa.large_string())
    small, large = Aligner(A_JSON, B_MODEL, 50), Aligner(A_JSON, B_MODEL, 1 << 20)
    for _ in range(2):
        x, y = ([t.to_pylist() if isinstance(t, pa.Array) else list(t) for t in w.rows(docs, True)] for w in (small, large))
        assert all(np.array_equal(p, q) for p, q in zip(x[0], y[0], strict=True)) and x[1:] == y[1:]


def test_transducer_in_rounds_is_that_of_single_runs():
    r = random.Random(1)
    a, b = ({i: t for i, t in enumerate(side)} for side in ([b"a", b"b", b"ab", b"ba", b"aab"], [b"a", b"b", b"bb", b"aba"]))
    pairs = [([r.randrange(5) for _ in range(r.randint(1, 6))], [r.randrange(4) for _ in range(r.randint(1, 6))]) for _ in range(3000)]
    pairs += [([2, 0], [0, 1, 0]), ([4], [0, 0, 1])]
    machine = Transducer(a, b)
    x, y = (np.array([t for p in pairs for t in p[k]], np.int64) for k in (0, 1))
    at = [np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]) for k in (0, 1)]
    valid, a_start, _, (who, p, q) = machine.run_many(x, at[0], y, at[1])
    assert valid.sum() > 1
    for k, (m, n) in enumerate(pairs):
        alone = Transducer(a, b).run(m, n)
        assert valid[k] == (alone is not None) == (b"".join(a[t] for t in m) == b"".join(b[t] for t in n))
        if alone:
            assert list(zip(p[who == k].tolist(), q[who == k].tolist(), strict=True)) == alone[1]
            assert a_start[at[0][k] : at[0][k + 1]].sum() == len(alone[0])


def test_stretches_end_at_blanks_between_solid_characters():
    docs = ["a b  c", "", "x  y z", "　 q", " lead trail ", "é ü 日 本"]
    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, at = stretches(data, offsets)
    found = [[data[s:e].tobytes().decode() for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], strict=True)] for k in range(len(docs))]
    assert found == [["a", "b  c"], [], ["x  y", "z"], ["　 q"], [" lead", "trail "], ["é", "ü", "日", "本"]]
