"""Every stage of the pipeline against plain Python on what the stage before it kept."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from talkframe.llm import quality
from talkframe.llm.storage import settle
from tests.llm import brute
from tests.llm.test_operators import check_packing

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def without_lines(docs):
    first = {}
    for i in sorted(docs):
        for k, line in enumerate(docs[i].split("\n")):
            if line.lower().strip():
                first.setdefault(line.lower().strip(), (i, k))
    shingles = {p: frozenset(line[j:j + 8] for j in range(max(1, len(line) - 7))) for line, p in first.items()}
    # Lines without a common shingle are never similar.
    by_shingle, links = {}, set()
    for p, own in shingles.items():
        for s in own:
            by_shingle.setdefault(s, []).append(p)
    for near in by_shingle.values():
        links.update(brute.pairs(near))
    heads = brute.components(list(shingles), [(a, b) for a, b in links if brute.similar(shingles[a], shingles[b], 80)])
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        kept = [x for k, x in enumerate(lines) if not x.strip() or heads[first[x.lower().strip()]] == (i, k)]
        if any(x.strip() for x in kept) or not any(x.strip() for x in lines):
            out[i] = "\n".join(kept)
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER), "test-stage")
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    scores = quality.score_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    assert set(texts(kept[0])) == {r["doc_id"] for r in scores.collect() if r["predicted"]}
    assert texts(kept[1]) == without_lines(texts(kept[0]))
    sets = {i: brute.word_shingles(t, 5) for i, t in texts(kept[1]).items()}
    heads = brute.components(list(sets), [(a, b) for a, b in brute.pairs(list(sets)) if brute.similar(sets[a], sets[b], 80)])
    assert set(texts(kept[2])) == set(heads.values())
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    found = brute.overlaps(texts(kept[2]), items)
    assert set(texts(kept[3])) == {i for i, (n, h, _) in found.items() if not (h and 20 * h >= n)}
    rows = kept[4].collect()
    assert {r["doc_id"] for r in rows} == set(texts(kept[3]))
    check_packing(rows, 4096)
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].collect())


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
