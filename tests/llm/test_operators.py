"""Operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkframe.llm import decontaminate, embedding_dedup, language, line_dedup, linking, near_dedup, packing, pii, quality, token_counts, token_store
from talkframe.llm.components import connected
from talkframe.llm.storage import new_path, passing_tables, settle, shared_folder
from talkframe.llm.tokenizing import WordEncoder, tokenizer_path
from tests.llm import brute

DOCS = "doc_id bigint, text string"
CLASHING = "doc_id bigint, text string, id bigint, key string, row int, score string, n_words string, overlap int, part string, component string, a int, start int, digest string, c0 int"
draw = random.Random(5)
LONG = "\n".join(brute.sentence(draw, 40) for _ in range(700))
ODD = [None, "", " ", "\n\n", "a", "A  b\tc\n", "naïve café ﬁ ①", "日本語 テスト 🙂", "<|endoftext|> <s>", "x" * 5000, "1 " * 3000, "don't I'LL", "İΣ ς", "a▁b", "▁", "▁▁ ▁x\n▁y▁"]


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema).repartition(3)


def clashing(docs):
    return docs.select("doc_id", "text", *[F.lit(i).cast(t).alias(n) for i, (n, t) in enumerate(x.split() for x in CLASHING.split(", ")[2:])])


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- tokens --------------------------------------------------------------------

def test_words_are_encoded_as_by_the_library():
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + [LONG] + ["foo.$$$ BAR!! x|y", "a b c", "a\x1cb\x85c"]
    ids, ends = encoder.encode(texts)
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:40]
        begin = end


def test_forgotten_words_are_learnt_again(monkeypatch):
    from talkframe.llm import tokenizing

    monkeypatch.setattr(tokenizing, "KEEP_WORDS", 40)
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    for k in range(6):
        texts = [brute.sentence(random.Random(k), 60), "lora kand"]
        ids, ends = encoder.encode(texts)
        assert ids[:ends[0]].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_counts_at_every_prefix():
    counter = token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model"))
    texts = [t or "" for t in ODD if t is None or len(t) < 100] + [LONG[:600], "\nab c", "a\n\nb", "  x  y ", "don't (s) .com a.b.c"]
    for text in texts:
        want = [len(counter.model.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want
        for limit in (0, 2, 7, 100):
            totals, fitting = counter.measure([text], limit)
            assert (totals[0], fitting[0]) == (want[-1], max(i for i, n in enumerate(want) if n <= limit))


def test_counts_of_random_texts():
    counter = token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model"))
    source = random.Random(2)
    kinds = [lambda: source.choice("▁ \n\t.,'a") , lambda: chr(source.randrange(0x20, 0x250)), lambda: chr(source.choice([*range(1, 0xD800), *range(0xE000, 0x20000, 7)])), lambda: source.choice(brute.WORDS)]
    texts = ["".join(source.choice(kinds)() for _ in range(source.randrange(1, 14))) for _ in range(4000)]
    totals, _ = counter.measure(texts, 4096)
    wrong = [(t, int(n)) for t, n, ids in zip(texts, totals, counter.model.encode(texts)) if n != len(ids)]
    assert not wrong, (len(wrong), wrong[:5])


def test_token_counts_of_odd_rows(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    library = token_counts.prefix_counter(model).model
    docs = spark.createDataFrame([*enumerate(ODD), (None, "a b"), (0, "twice"), (1000, LONG)], DOCS)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in [*enumerate(ODD), (None, "a b"), (0, "twice"), (1000, LONG)]), key=str)
    assert got(token_counts.count_tokens(clashing(docs), model), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(docs.limit(0), model).count() == 0
    assert got(token_counts.prefix_counts(docs.filter("doc_id is null"), model), "prefix_tokens") == [([len(library.encode("a b"[:i])) for i in range(4)],)]


def test_wavelet_shard_answers():
    ids = np.random.default_rng(3).integers(0, 3000, 5000)
    shard = token_store.Shard(token_store.pack_shard(ids, np.arange(2), np.array([2000, 3000]), np.ones(2)))
    assert (shard.ids() == ids).all() and [shard.access(i) for i in range(0, 5000, 61)] == ids[::61].tolist()
    for token in (int(ids[7]), 0, 2999, 5000):
        places = np.flatnonzero(ids == token).tolist()
        assert shard.occurrences(token) == places and shard.count(token) == len(places)
        assert shard.rank(token, 2500) == sum(p < 2500 for p in places)
    empty = token_store.Shard(token_store.pack_shard(np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0)))
    assert empty.count(1) == 0 and len(empty.ids()) == 0


def test_token_store_round_trip(spark):
    path, tokenizer = new_path(spark, "test-shards"), tokenizer_path("word_bpe_49k.json")
    library = WordEncoder(tokenizer).tokenizer
    data = [*enumerate(ODD), (3, "second of an id"), (None, "no id"), (500, LONG)]
    token_store.write_shards(clashing(spark.createDataFrame(data, DOCS).repartition(4)), path, tokenizer, shard_tokens=3000)
    want, start = [], 0
    for i, text in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got(token_store.document_digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert token_store.count_token(spark, path, 2).agg(F.sum("n")).first()[0] >= len(data)
    nothing = new_path(spark, "test-shards")
    token_store.write_shards(spark.createDataFrame([], DOCS), nothing, tokenizer)
    assert token_store.document_digests(spark, nothing).count() == 0


# --- packing -------------------------------------------------------------------

def check_packing(rows, capacity):
    ends = {}
    for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
    assert all(n <= capacity for n in ends.values())
    return len(ends)


def test_packing_is_whole_and_tight(spark):
    tokenizer = tokenizer_path("word_bpe_49k.json")
    library = WordEncoder(tokenizer).tokenizer
    data = [*enumerate(ODD), (3, "second of an id"), (None, "no id"), (500, LONG)]
    rows = packing.pack_documents(clashing(spark.createDataFrame(data, DOCS).repartition(4)), tokenizer).collect()
    want = Counter()
    for i, text in data:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r[:5]) for r in rows) == want
    assert check_packing(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokenizer).count() == 0


def test_packing_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 50)
    draw = random.Random(2)
    lengths = [draw.choice([1, 5, 40, 60, 100, draw.randint(1, 100)]) for _ in range(2000)]
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item bigint, length bigint")
    rows = packing.pack_pieces(parts, 100).collect()
    assert sorted(r["item"] for r in rows) == list(range(2000))
    assert check_packing(rows, 100) <= 1.05 * len(packing.best_fit(np.array(lengths), 100)[2])


# --- components and links ------------------------------------------------------

@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)], [(5, 5)], [], [(9, 2), (2, 9), (3, 9), (7, 8), (8, 1)]])
def test_components(spark, links):
    ids = sorted({x for pair in links for x in pair if pair[0] != pair[1]})
    want = sorted(brute.components(ids, [p for p in links if p[0] != p[1]]).items())
    assert got(connected(spark.createDataFrame(links, "a bigint, b bigint")), "id", "component") == sorted(want, key=str)


def near_copies(draw, n, words, edits):
    base = brute.sentence(draw, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = "edit" + str(draw.randrange(10**6))
        out.append(" ".join(own))
    return out


def test_near_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "CELL", 5)  # groups of several cells
    draw = random.Random(11)
    texts = [*near_copies(draw, 60, 120, 12), *near_copies(draw, 25, 60, 4), *[brute.sentence(draw, 50) for _ in range(30)], *ODD, "One two THREE four", "one TWO\nthree\tfour", "one", "One", LONG, LONG]
    sets = {i: brute.word_shingles(t, 3) for i, t in enumerate(texts)}
    heads = brute.components(list(sets), [(a, b) for a, b in brute.pairs(list(sets)) if brute.similar(sets[a], sets[b], 85)])
    groups = near_dedup.near_groups(clashing(table(spark, texts)))
    assert got(groups, "doc_id", "n_shingles", "component_id") == sorted(((i, len(sets[i]), heads[i]) for i in sets), key=str)
    assert sorted(r["doc_id"] for r in groups.filter("first_row").collect()) == sorted(set(heads.values()))


def test_bands_find_pairs_at_every_threshold():
    """Sets of 80 % and 85 %: the share of samples that agree is the similarity, so a band of r agrees with similarity to the r."""
    assert near_dedup.band_rows(85) == 7
    for percent in (50, 80, 85, 95):
        rows = near_dedup.band_rows(percent)
        assert rows * near_dedup.BANDS <= near_dedup.SAMPLES
        assert percent < 80 or (1 - (percent / 100) ** rows) ** near_dedup.BANDS <= 1e-5


def test_near_copies_of_repeated_and_unnamed_rows(spark):
    text, other = "a b c d e f g", "h i j k l m n"
    docs = spark.createDataFrame([(4, text), (4, text), (4, other), (7, text), (None, text), (None, other), (None, ""), (None, ""), (9, None)], DOCS)
    kept = near_dedup.remove_near_copies(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert Counter(tuple(r) for r in kept.select("doc_id", "text").collect()) == Counter([(4, text), (4, other), (None, ""), (None, ""), (9, None)])
    alone = near_dedup.near_groups(docs.filter("doc_id is null"))
    assert alone.filter("component_id is not null").count() == 0 and alone.filter("first_row").count() == 4
    assert near_dedup.near_groups(docs.limit(0)).count() == 0 and near_dedup.remove_near_copies(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    draw = np.random.default_rng(1)
    for common in (500, 900, 980):
        a, b = draw.integers(0, 1 << 62, (2, 1000)).astype(np.uint64)
        b[:common] = a[:common]
        sketches = near_dedup.odd_sketches(near_dedup.minima(np.concatenate([a, b]), np.array([0, 1000]), near_dedup.SAMPLES))
        differing = int(np.unpackbits(sketches[0] ^ sketches[1]).sum())
        assert abs(float(near_dedup.estimate(np.array(differing))) - common / (2000 - common)) < 0.1


# --- lines ---------------------------------------------------------------------

def test_repeated_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "CELL", 5)
    draw = random.Random(21)
    shared = near_copies(draw, 40, 25, 3) + near_copies(draw, 10, 8, 1) + ["Short.", "short.", "é ü", "x"]
    texts = ["\n".join(draw.choice(shared) if draw.random() < 0.4 else brute.sentence(draw, 15) for _ in range(draw.randint(1, 8))) for _ in range(60)] + ODD + [LONG]
    first, folded = {}, {}
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            line = line.lower().strip()
            folded[i, k] = line
            if line:
                first.setdefault(line, (i, k))
    shingles = {p: frozenset(line[j:j + 8] for j in range(max(1, len(line) - 7))) for line, p in first.items()}
    heads = brute.components(list(shingles), [(a, b) for a, b in brute.pairs(list(shingles)) if brute.similar(shingles[a], shingles[b], 80)])
    keep = {p for p, line in folded.items() if not line or heads[first[line]] == p}
    want = [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in keep)) for i, t in enumerate(texts)]
    out = line_dedup.remove_repeated_lines(clashing(table(spark, texts)))
    assert out.columns == clashing(table(spark, texts)).columns
    assert got(out, "doc_id", "text") == sorted(want, key=str)


def test_lines_of_repeated_and_unnamed_rows(spark):
    docs = spark.createDataFrame([(1, "one line here\ntwo"), (1, "one line here\ntwo"), (2, "two\nthree"), (None, "two"), (3, "one line here"), (4, "\n"), (5, None)], DOCS)
    want = [(1, "one line here\ntwo"), (1, "one line here\ntwo"), (2, "three"), (None, "two"), (3, ""), (4, "\n"), (5, None)]
    assert got(line_dedup.remove_repeated_lines(docs), "doc_id", "text") == sorted(want, key=str)
    assert got(line_dedup.remove_copied_lines_and_documents(docs), "doc_id", "text") == sorted((x for x in want if x[0] != 3), key=str)
    assert line_dedup.remove_repeated_lines(docs.limit(0), counts=True).count() == 0


def test_lists_of_many_lines_are_not_broadcast(spark, monkeypatch):
    lists = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5])], "doc_id bigint, gone_ array<int>")
    for most, sent in ((5, True), (4, False)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        assert ("broadcast" in line_dedup.bounded_lists(lists, "gone_")._jdf.queryExecution().logical().toString()) == sent
    assert line_dedup.bounded_lists(lists.limit(0), "gone_").count() == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    docs = spark.createDataFrame([(1, "one line here\ntwo"), (2, "two\nthree"), (3, "one line, here\nfour")], DOCS)
    assert got(line_dedup.remove_repeated_lines(docs), "doc_id", "text") == [(1, "one line here\ntwo"), (2, "three"), (3, "one line, here\nfour")]


@pytest.mark.parametrize("width", [3, 5, 8])
def test_a_slice_of_few_characters_or_words(width):
    """The shingles of a text do not depend on what else is in its slice."""
    for n in range(1, 9):
        line, text = "short ab"[:n], " ".join("abcdefgh"[:n])
        (alone, counts), (both, more) = line_dedup.shingle_hashes([line], width), line_dedup.shingle_hashes([line, "x" * 40], width)
        assert counts[0] == more[0] == max(1, n - width + 1) and alone.tolist() == both[:more[0]].tolist()
        assert near_dedup.shingle_sets([text], width)[0].tolist() == near_dedup.shingle_sets([text, "x " * 40], width)[0].tolist()


def test_tables_of_one_short_text(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    assert got(line_dedup.remove_repeated_lines(docs, counts=True), "text", "n_lines", "n_removed") == [("a b", 1, 0)]
    assert got(near_dedup.remove_near_copies(docs, 80, 5), "doc_id", "text") == [(1, "a b")]


# --- benchmark -----------------------------------------------------------------

def test_overlaps_equal_brute_force(spark):
    draw = random.Random(31)
    items = {i: brute.sentence(draw, draw.choice([3, 12, 13, 14, 40])) for i in range(20)} | {20: "", 21: "Kara  kara", 22: "日本 x"}
    texts = {i: " ".join([brute.sentence(draw, draw.randint(0, 30)), draw.choice(list(items.values())).upper(), brute.sentence(draw, 9)]) for i in range(60)}
    texts |= {100: None, 101: "", 102: "日本 x", 103: f"{items[4]} " * 3, 104: LONG}
    docs = clashing(spark.createDataFrame(list(texts.items()), DOCS).repartition(3))
    benchmark = spark.createDataFrame([*items.items(), (0, items[0]), (None, "kara"), (50, None)], "item_id bigint, text string")
    want = sorted(((d, n, h, len(f)) for d, (n, h, f) in brute.overlaps(texts, items).items()), key=str)
    found = overlap = None
    for block in (4_000_000, 100):  # one block, and many
        found = decontaminate.find_overlaps(docs, benchmark, "found", block_chars=block, shard_chars=2000)
        overlap = decontaminate.overlap_columns("found")
        assert got(found, "doc_id", *[overlap[k] for k in ("n_words", "n_hit", "n_items")]) == want
    assert {"doc_id", "text", "overlap", "n_words"} <= set(found.columns)
    longest = {(r["doc_id"], m["item_id"]): m["n_words"] for r in found.filter("doc_id = 103").collect() for m in r["found"]["matches"]}
    assert longest[103, 4] == len(items[4].split())
    clean = {d for d, (n, h, _) in brute.overlaps(texts, items).items() if not (h and 20 * h >= n)}
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns


def test_overlaps_of_empty_tables(spark):
    docs, benchmark = table(spark, ["a b c", None]), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.remove_contaminated(docs, benchmark).count() == 2
    assert decontaminate.find_overlaps(docs.limit(0), benchmark).count() == 0


def test_suffixes_are_in_order():
    words = np.array([3, 1, 2, 1, 2, 0, 1, 2, 3, 0, 2, 2, 2, 2, 0])
    order = decontaminate.suffix_array(words, 4)

    def key(i):
        own = words[i:i + 4].tolist()
        return own[:own.index(0)] if 0 in own else own

    assert [key(i) for i in order] == sorted(key(i) for i in np.flatnonzero(words))


# --- language ------------------------------------------------------------------

def test_language_evidence(spark):
    draw = random.Random(4)
    tongues = {"aa": ["kala", "mora", "tiko"], "bb": ["strun", "weld", "grinf"]}
    docs = [(i, " ".join(draw.choice(tongues[k]) for _ in range(40)), k, "s") for i, k in enumerate(["aa", "bb"] * 20)] + [(90, None, "aa", None), (91, "zz", None, None)]
    model = language.TextModel(language.trigram_counts(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")))
    assert model.languages == ["aa", "bb"]
    page = "<html lang='{}'><script>strun weld</script><p>{}</p></html>"
    pages = [(i, f"http://www.{k}.example.org/{k}/x", page.format(k, " ".join(draw.choice(tongues[k]) for _ in range(30)))) for i, k in enumerate(["aa", "bb"] * 10)]
    pages += [(50, "http://www.bb.example.org/bb/y", ""), (51, "http://www.aa.example.org/", page.format("aa", "12 34")), (52, None, None), (53, "x", page.format("zz", "grinf strun weld"))]
    parts = language.page_parts(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    out = {r["page_id"]: r for r in language.identify(parts.withColumn("logs_", F.lit(1)), model).collect()}
    assert len(out) == len(pages) and [out[i]["lang"] for i in range(20)] == ["aa", "bb"] * 10
    assert out[50]["lang"] == "bb" and out[51]["lang"] == "aa" and out[53]["lang"] == "bb" and abs(out[52]["probability"] - 0.5) < 0.1
    nothing = language.TextModel(language.trigram_counts(spark.createDataFrame([], "doc_id bigint, text string, lang string")))
    assert {r["lang"] for r in language.identify(parts, nothing).collect()} == {None}
    assert language.identify(parts.limit(0), model).count() == 0


# --- quality -------------------------------------------------------------------

def test_quality_learns_and_leaves_held_out_labels_alone(spark):
    draw = random.Random(8)
    texts = [brute.sentence(draw, 60) if i % 3 else "BUY!!! " * draw.randint(20, 60) for i in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (5, "repeated"), (900, None), (901, ""), (902, LONG)], DOCS).repartition(4)
    marks = [(i, int(i % 3 > 0)) for i in range(600)]
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id bigint, quality int")
    scores = quality.score_quality(clashing(docs), labels).collect()
    assert len(scores) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scores)
    out = {r["doc_id"]: r for r in scores if r["doc_id"] is not None and r["doc_id"] != 5}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [i for i in range(600) if i in out and out[i]["held_out"]]
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.98
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in marks], "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - out[i]["score"]) < 1e-6 for i in out)
    kept = quality.remove_low_quality(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and {r["doc_id"] for r in kept.collect()} >= {i for i in held if i % 3 and out[i]["predicted"]}


def test_quality_without_both_labels(spark):
    docs, labels = table(spark, ["a b", None, ""]), "doc_id bigint, quality int"
    assert {r["score"] for r in quality.score_quality(docs, spark.createDataFrame([], labels)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(docs, spark.createDataFrame([(0, 1), (2, 1)], labels)).collect()} <= {1.0, 0.5}
    assert quality.score_quality(docs.limit(0), spark.createDataFrame([(1, 1), (3, 0)], labels)).count() == 0


def test_isotonic_rises_and_keeps_the_mean():
    values, weights = np.array([0.1, 0.5, 0.2, 0.9, 0.4]), np.array([1.0, 2, 2, 1, 3])
    out = quality.isotonic(values, weights)
    assert (np.diff(out) >= 0).all() and abs((out * weights).sum() - (values * weights).sum()) < 1e-9


# --- personal data -------------------------------------------------------------

PERSONAL = [
    "a@b.c", "a@b.c_x@d.e mail x..y@z-1.co.uk.", "@a.b c@d", "1.2.3.4 256.1.1.1 1.2.3.4.5 0000255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111" * 2,
    "12--34 5 6-7  8", "+1 (234) 555-0100, +12 +1234567 +1.2.3.4.5.6.7.8", "+(1 234", "é🙂 x@y.zz é 10.0.0.1 +49 30 1234567", "1 " * 4000, "9" * 6000, "a." * 3000 + "@b.c", "x@" + "b." * 3000 + "c",
]


def test_personal_data_equals_patterns(spark):
    texts = PERSONAL + ODD + [LONG + " me@here.org"]
    out = pii.find_personal_data(clashing(table(spark, texts))).collect()
    assert len(out) == len(texts)
    for row in out:
        want = brute.personal_data(texts[row["doc_id"]])
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in row["base"]] == want, texts[row["doc_id"]]
        assert {tuple(s) for s in row["base"]} <= {tuple(s) for s in row["spans"]}
    assert pii.find_personal_data(table(spark, []).limit(0)).count() == 0


def test_boosted_trees_add_what_looks_alike(spark):
    draw = random.Random(3)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(900):
        phone = f"({digits(3)}) {digits(3)}-{digits(4)}"
        texts.append(f"{brute.sentence(draw, 8)} call +1 {phone} {brute.sentence(draw, 5)} chapter {digits(2)}-{digits(2)} then {digits(3)}.{digits(2)} {brute.sentence(draw, 4)}")
    texts += [f"{brute.sentence(draw, 5)} call ({digits(3)}) {digits(3)}-{digits(4)} {brute.sentence(draw, 5)}" for _ in range(6)]
    out = pii.find_personal_data(table(spark, texts)).filter("doc_id >= 900").collect()
    found = [r for r in out if any(pii.KINDS[s["kind"]] == "phone" and texts[r["doc_id"]][s["start"]] == "(" for s in r["spans"])]
    assert len(found) >= 5 and all(not r["base"] for r in out)
    shown = pii.redact(table(spark, texts), pii.find_personal_data(table(spark, texts))).filter("doc_id = 0").first()["text"]
    assert "+1 (" not in shown and len(shown) == len(texts[0])


def test_boosted_trees_learn_from_every_candidate(spark, monkeypatch):
    written = {}
    kept = pii.settle
    monkeypatch.setattr(pii, "settle", lambda df, name: written.setdefault(name, kept(df, name)))
    draw = random.Random(4)
    numbers = [f"({draw.randrange(100, 1000)}) {draw.randrange(100, 1000)}-{draw.randrange(1000, 10000)}" for _ in range(300)]
    texts = ["; ".join(f"call {'+1 ' if (i + k) % 2 else ''}{x}" for k, x in enumerate(numbers)) for i in range(150)]
    pii.find_personal_data(table(spark, texts)).count()
    n = written["pii-candidates"].count()
    assert n > 40_000 and written["pii-taught"].agg({"weight": "sum"}).first()[0] == n


# --- vectors -------------------------------------------------------------------

def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    draw = np.random.default_rng(2)
    base = draw.normal(size=(120, 40)).astype(np.float32)
    close = (base[:60] + draw.normal(scale=0.3, size=(60, 40))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, close, base[:10], np.tile(base[3], (45, 1)) * 2]))]
    n = len(rows)
    odd = [None, [], [0.0] * 40, [1.0, None] * 20, [float("nan")] * 40, [float("inf")] + [1.0] * 39, [1.0] * 7, [1.0] * 7]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(0, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, row int, id string").repartition(4)
    usable = {k: np.array(v, np.float64) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in brute.pairs(sorted(usable)) if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= 0.9]
    heads, degree = brute.components(list(range(len(rows))), links), Counter(x for p in links for x in p)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[heads[k]] = min(i, names.get(heads[k], i))
    want = sorted(((i, degree[k], names.get(heads[k]), i is not None and i == names.get(heads[k])) for k, (i, _) in enumerate(rows)), key=str)
    assert got(embedding_dedup.near_vectors(frame), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_values_of_one_set_alone_do_not_widen_the_products():
    """Many pairs of few sets: the sets' own values are dropped before the membership tables are made."""
    rng, widths = np.random.default_rng(3), []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def zeros(self, shape, *args):
            widths.append(shape)
            return np.zeros(shape, *args)

    sets = [np.unique(np.concatenate([np.arange(i % 7, 30, dtype=np.uint64), rng.integers(1 << 20, 1 << 60, 2000).astype(np.uint64)])) for i in range(20)]
    of, to = map(np.ravel, np.indices((10, 10)))
    near_dedup.np = Counted()
    try:
        got = near_dedup.intersections(sets[:10], sets[10:], of, to)
        none = near_dedup.intersections([sets[0][:0]], [sets[0][:0]], np.zeros(9, int), np.zeros(9, int))
    finally:
        near_dedup.np = np
    assert got.tolist() == [len(np.intersect1d(sets[i], sets[10 + j])) for i, j in zip(of, to)] and none.tolist() == [0] * 9
    assert sum(len(w) == 2 and w[1] > 100 for w in widths if isinstance(w, tuple)) <= 2  # the total, and one table


def test_line_hashes_and_digests_are_those_of_each_line():
    lines = ["a", "é😀" * 9, "abcdefgh", "abcdefghi", "abc", "x" * 40]
    for width in (1, 2, 3, 7, 8, 11):
        hashes, counts = line_dedup.shingle_hashes(lines, width)
        alone = [line_dedup.shingle_hashes([x], width) for x in lines]
        assert counts.tolist() == [max(len(x) - width + 1, 1) for x in lines]
        assert hashes.tolist() == [h for own, _ in alone for h in own.tolist()]
    assert line_dedup._digests(lines).tolist() == [list(line_dedup._digest(x)) for x in lines]
    assert line_dedup._digests(lines).dtype == np.int64


def test_lines_of_many_pairs_are_hashed_once(monkeypatch):
    """Pairs of 80 lines and 80 others: right as by sets, and each line is hashed once."""
    draw, hashed, plain = random.Random(8), [], line_dedup.shingle_hashes
    near = [x.encode() for x in near_copies(draw, 150, 12, 2)] + ["é ü".encode(), b"x"]
    left, right = near[:80], near[72:152]
    pairs = draw.sample([(i, j) for i in range(80) for j in range(80)], 500)
    of, to = (np.array(x) for x in zip(*pairs))
    monkeypatch.setattr(line_dedup, "shingle_hashes", lambda lines, width: hashed.extend(lines) or plain(lines, width))
    shingles = {x: {x.decode()[k:k + 8] for k in range(max(1, len(x.decode()) - 7))} for x in near}
    want = [brute.similar(shingles[left[i]], shingles[right[j]], 80) for i, j in pairs]
    assert line_dedup.LineSimilarity().linked(left, right, of, to).tolist() == want and 0 < sum(want) < 500
    assert len(hashed) <= 160
    for name, value in (("_BITS", 64), ("_LIST", 7), ("_LIST_BYTES", 300)):
        monkeypatch.setattr(line_dedup, name, value)
        assert line_dedup.LineSimilarity().linked(left, right, of, to).tolist() == want


def test_two_minors_of_a_cell_are_compared_once():
    asked = []

    def compare(left, right, of, to):
        asked.extend((left[i], right[j]) for i, j in zip(of.tolist(), to.tolist()))
        return np.ones(len(of), bool)

    rows = [(False, i, i, i > 1, b"%d" % i) for i in (1, 2, 3)] + [(True, i, i, True, b"%d" % i) for i in (2, 3)]
    cell = pa.table({name: list(values) for name, values in zip(("asks", "id", "part", "minor", "content"), zip(*rows))})
    out = linking._ask(compare, "content")(cell)
    assert sorted(tuple(sorted(x)) for x in asked) == [(b"1", b"2"), (b"1", b"3"), (b"2", b"3")]
    assert len(out["a"]) == 2


def test_a_cluster_whose_pairs_were_stars_is_not_compared_again(spark, monkeypatch):
    """Items 1 and 2, and 3, 4 and 5, are alike by sketch alone; 3 is the leader of 4 and 5, which no star joins."""
    counts, plain = {}, linking.settle

    def counted(df, name, *args):
        out = plain(df, name, *args)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(linking, "settle", counted)
    texts = {1: b"one line of words", 2: b"nothing like the first", 3: b"a third line", 4: b"the fourth of the lines", 5: b"the fourth of the lines."}
    items = spark.createDataFrame([(i, 1, [100 if i < 3 else 200], bytearray(24)) for i in texts], "id bigint, size int, keys array<bigint>, sketch binary")
    content = spark.createDataFrame([(i, bytearray(t)) for i, t in texts.items()], "id bigint, content binary")
    assert got(linking.links(items, lambda ids: content.join(ids, "id"), line_dedup.LineSimilarity(), 0.0), "a", "b") in ([(4, 5)], [(5, 4)])
    assert counts["main-parts"] == 1 and counts["asked"] == 3


def test_line_dedup_leaves_no_passing_tables(spark):
    def tables():
        top = Path(urlsplit(shared_folder(spark)).path, "llm")
        return set(os.listdir(top)) if top.exists() else set()

    rows = [(i, f"line number {i % 7} of some length\nthe line {i} alone has these words {i * 7919}") for i in range(40)]
    before = tables()
    out = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True)
    assert [x.rsplit("-", 1)[0] for x in tables() - before] == ["gone-lines"]
    assert out.agg(F.sum("n_removed")).first()[0] == 33
    again = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert again.count() == 33


def test_settled_shuffles_go_at_once_and_kept_tables_stay(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.length()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    with passing_tables(spark) as keep:
        one = settle(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "one")
        two = keep(settle(one.filter("k < 5"), "two"))
        path = Path(urlsplit(one.inputFiles()[0]).path).parent
        assert path.exists()
    assert shuffles() <= before and not path.exists() and two.count() == 5
    try:
        with passing_tables(spark) as keep:
            path = Path(urlsplit(settle(spark.range(3), "three").inputFiles()[0]).path).parent
            raise KeyError("stop")
    except KeyError:
        assert not path.exists()
