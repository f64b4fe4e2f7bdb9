"""Spelling variants, whitening and repeated passages against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.llm import repeats, spelling, whitening
from talkframe.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id bigint, text string"
FOLDER = "/root/testdata/sf0.001"
draw = random.Random(11)


def table(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- spelling ------------------------------------------------------------------

def variants(texts, noise=0, letters=6, least=5, ratio=5):
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for a, others in around.items():
        if others and words[best := min(others, key=lambda b: (-words[b], b))] >= ratio * words[a]:
            form[a] = best
    out = []
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, words[a], len(around[a]), words.get(form.get(a))))
    return sorted(out, key=str)


def misspelt():
    base = ["kanderol", "kanderel", "aabbaab", "mississippi", "ÉCOLEétat", "Straßen", "xx" * 40]
    texts = [None, "", "  12 3", "a" * 3000, " ".join(["B" * 2000] * 6)]
    for k in range(60):
        line = []
        for w in base:
            line += [w] * draw.choice([0, 1, 3])
            at = draw.randrange(len(w))
            line.append(draw.choice([w[:at] + w[at + 1:], w[:at] + "e" + w[at:], w[:at] + "o" + w[at + 1:]]))
        texts.append(" ".join(line))
    return texts


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_equal_brute_force(spark, parts):
    texts = [*enumerate(misspelt()), (None, "kanderol kanderil"), (7, "kanderol"), (7, "kanderol")]
    docs = spark.createDataFrame(texts, DOCS).repartition(parts).withColumns({"word": F.lit("x"), "n": F.lit(1), "path": F.lit(2)})
    for noise, ratio in ((0, 5), (7, 2)):
        got = spelling.spelling_variants(docs, noise, least=2, ratio=ratio)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = variants(texts, noise, least=2, ratio=ratio)
        assert rows(got) == want and any(w[1] for w in want) and any(w[2] != (w[1] or w[0]) for w in want) == (ratio == 2)


def test_ties_go_to_the_first_word(spark):
    words = spark.createDataFrame([("katten", 10), ("kattes", 10), ("kattem", 10), ("katte", 1), ("ß" * 6, 3)], "word string, n bigint")
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.spelling_forms(words).collect()}
    assert got == {"katten": (None, 3), "kattes": (None, 3), "kattem": (None, 3), "katte": ("kattem", 3), "ß" * 6: (None, 0)}


def test_trie_nodes_agree_across_ranges(spark):
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 12))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    nodes = {r["word"]: r["p"] for r in spelling.trie_nodes(df.repartition(5), F.col("word"), "p").collect()}
    named = {}
    for w, path in nodes.items():
        assert len(path) == len(w) + 1
        for i, node in enumerate(path):
            assert named.setdefault(node, w[:i]) == w[:i]
    assert len(named) == len({w[:i] for w in words for i in range(len(w) + 1)})
    assert sorted(words, key=lambda w: nodes[w][-1]) == words


def test_no_words_no_variants(spark):
    assert spelling.spelling_variants(table(spark, [None, "", "short"]).limit(3)).count() == 0
    assert spelling.spelling_variants(table(spark, ["a"]).limit(0)).count() == 0


# --- whitening -----------------------------------------------------------------

def whitened(vectors, count=4):
    x = np.array([[int(np.floor(256 * c)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_eigenvectors(spark):
    source = np.random.default_rng(3)
    vectors = (source.normal(size=(200, 9)) * np.arange(1, 10)).astype(np.float32).tolist()
    vectors += vectors[:20]
    odd = [(900, None), (901, [1.0] * 8 + [None]), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (904, []), (905, [1.0, 2.0]), (None, vectors[0])]
    df = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id bigint, embedding array<float>").withColumn("x", F.lit("y")).repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, want, explained = whitened([*vectors, vectors[0]])
    assert n == 200 and len(got) == 4 * 221 and {r["n"] for r in got} == {200}
    for k in range(4):
        own = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        values = np.array([own[i]["whitened"] for i in [*range(220), None]])
        sign = np.sign(values @ want[:, k])
        assert np.abs(values * sign - want[:, k]).max() < 1e-9
        assert [own[i]["deviation"] for i in [*range(220), None]] == deviation.tolist()
        assert abs(own[0]["explained"] - explained[k]) < 1e-12
    assert got[0]["identity_error"] < 1e-9


def test_whitening_of_few_and_large_values(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0, 5.0]), (2, [1.0, 1.0, 5.0]), (3, [3.0, 3.0, 5.0])], schema)).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-12
    # Two equal roots: any two orthogonal axes, found apart.
    square = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [-1.0, 1.0]), (4, [-1.0, -1.0])], schema)).collect()
    assert len(square) == 8 and {r["explained"] for r in square} == {0.5} and square[0]["identity_error"] < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**40, 7.0])], schema)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge} == {None} and huge[0]["identity_error"] < 1e-9


def test_polynomial_and_roots_are_exact(spark):
    source = random.Random(4)
    a = [[source.randint(-50, 50) for _ in range(6)] for _ in range(9)]
    gram = [[sum(r[i] * r[j] for r in a) for j in range(6)] for i in range(6)]
    # Trace and determinant, and every root of the polynomial by its sign on either side.
    got = whitening.characteristic_polynomial(spark, gram)
    assert got[6] == 1 and got[5] == -sum(gram[i][i] for i in range(6))
    assert abs(got[0] - np.linalg.det(np.array(gram, float))) < 1e-6 * abs(got[0])
    roots = whitening.largest_roots(got, 6)
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(np.array(gram, float))[::-1], rtol=1e-12)
    assert [whitening._above(got, int(r) - 1, 0) for r in roots] == [1, 2, 3, 4, 5, 6]
    assert whitening._limbs(-(5 << 100) - 3)[0] == -3 and sum(x << (32 * k) for k, x in enumerate(whitening._limbs(-(5 << 100) - 3))) == -(5 << 100) - 3


# --- repeated passages ---------------------------------------------------------

def without_repeats(texts, length):
    data = [(d, (t or "").encode()) for d, t in texts]
    counts = Counter(t[i:i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating(length):
    passages = [brute.sentence(draw, 3 * length) for _ in range(4)]
    texts = [None, "", "é", "a" * (length - 1), "a" * length, "ab" * (4 * length), "a" * (9 * length), passages[0], passages[0], passages[0]]
    for k in range(60):
        passage = draw.choice(passages)
        at = draw.randrange(len(passage))
        own = brute.sentence(draw, draw.randint(1, length))
        texts.append(own + passage[at:at + draw.randint(1, 3 * length)] + "日本語" * draw.randint(0, length // 2) + own[:length])
    return [*enumerate(texts), (None, passages[1]), (3, passages[2])]


@pytest.mark.parametrize("length,cell", [(200, 512), (24, 2), (7, 512), (1, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, cell):
    monkeypatch.setattr(repeats, "CELL_SITES", cell)
    texts = repeating(length) if length > 1 else [(0, "abcd"), (1, "efa"), (2, None), (3, "xyyz")]
    docs = spark.createDataFrame(texts, DOCS).repartition(4).withColumns({"digest": F.lit("x"), "data": F.lit(1), "r": F.lit(2), "repeated": F.lit(3)})
    got = repeats.remove_repeats(docs, length).drop("kept")
    assert rows(got) == without_repeats(texts, length)


def test_repeats_in_long_texts_and_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    monkeypatch.setattr(repeats, "BROADCAST_ITEMS", 0)
    passage = brute.sentence(draw, 900)
    texts = [*enumerate([brute.sentence(draw, 4000) + passage, passage + brute.sentence(draw, 4000), brute.sentence(draw, 9000)])]
    got = repeats.remove_repeats(table(spark, [t for _, t in texts]), 200)
    assert rows(got.drop("kept")) == without_repeats(texts, 200)
    # What is kept, with what its spans hold, is the text.
    spans = repeats.with_repeated_spans(table(spark, [t for _, t in texts]), 200).collect()
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    for r in spans:
        data, at, out = r["text"].encode(), 0, b""
        for s in r["repeated"]:
            out, at = out + data[at:s["begin"]], s["stop"]
        assert out + data[at:] == bytes(kept[r["doc_id"]])


def test_no_texts_no_repeats(spark):
    assert repeats.remove_repeats(table(spark, ["a"]).limit(0)).count() == 0
    assert rows(repeats.with_repeated_spans(table(spark, [None, "", "short"])).select(F.size("repeated"))) == [(0,)] * 3


def test_transforms_merge_to_the_order_of_all_suffixes():
    """The merged order equals that of sorting all places together."""
    strings = [bytes(draw.choice(b"ab") for _ in range(40)) for _ in range(6)]
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    lengths = np.full(240, 40)
    begins = np.repeat(np.arange(6) * 40, 40)
    halves = [repeats.shard_transform(data[a:b], begins[a:b] - a, lengths[a:b], 1, 16) for a, b in ((0, 120), (120, 240))]
    shard, classes = repeats.merge_transforms([t for _, t in halves], 16)
    at = [0, 0]
    merged = []
    for s in shard.tolist():
        merged.append(int(halves[s][0][at[s]]) + 120 * s)
        at[s] += 1
    read = [bytes(strings[p // 40][(p + k) % 40 if p < 40 else (p % 40 + k) % 40] for k in range(16)) for p in merged]
    assert read == sorted(read)
    assert [a == b for a, b in zip(read, read[1:])] == (np.diff(classes) == 0).tolist()


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_whitening", "op13_repeated_passages"])
def test_new_queries_run_over_whole_tables(spark, name):
    got = QUERIES[name](spark, FOLDER)
    if name == "op11_spelling_variants":
        texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
        assert rows(got) == variants(texts, 199)
    elif name == "op12_whitening":
        vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
        n, deviation, want, _ = whitened([r["embedding"] for r in vectors])
        first = sorted((r["vec_id"], r["whitened"], r["deviation"], r["n"]) for r in got.collect() if r["component"] == 1)
        assert [r[2] for r in first] == deviation.tolist() and {r[3] for r in first} == {n}
        assert np.allclose(np.abs([r[1] for r in first]), np.abs(want[:, 0]))
    else:
        texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
        assert rows(got) == without_repeats(texts, 200)
