"""Benchmark passages in training documents, found with suffix arrays.

Every task builds suffix arrays over the words of its documents, a shard of bounded size at a time, and binary-searches
all suffixes of the benchmark in them. The ranges found give the verbatim matches and their places; matches that go on are
reported at their full length. Documents never move: the benchmark does, in blocks of bounded size, and beyond
one block the documents are searched once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column

#: Words of a window; an item of fewer is one window.
WINDOW = 13
#: Characters of benchmark text that are sent to the executors at once.
BLOCK_CHARS = 4_000_000
#: Characters of the documents in one suffix array. A longer document has one of its own.
SHARD_CHARS = 6_000_000

#: Bytes of a word: digits, letters and all beyond ASCII; A-Z become a-z, the others spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_array(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and how many each text has."""
    folded = pa.array([(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts], pa.large_binary())
    parts = pc.split_pattern(folded, b" ")
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    word = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(word)])
    return flat.filter(pa.array(word)), np.diff(before[ends])


@dataclass
class Windows:
    """Distinct windows of a block of items, and the items and places that have each."""

    size: int
    vocabulary: pa.Array
    words: np.ndarray
    lengths: np.ndarray
    item_ends: np.ndarray
    item_ids: np.ndarray
    item_places: np.ndarray


def item_windows(items: list[tuple[int, str]], size: int) -> Windows | None:
    flat, counts = word_array([t for _, t in items])
    if not len(flat):
        return None
    vocabulary = pc.unique(flat)
    ids = pc.index_in(flat, vocabulary).to_numpy().astype(np.int64) + 1
    padded = np.concatenate([ids, np.zeros(size, np.int64)])
    rows, lengths, owners, places = [], [], [], []
    begin = 0
    for (item, _), count in zip(items, counts.tolist()):
        own = min(count, size)
        for at in range(count - own + 1 if count else 0):
            row = padded[begin + at:begin + at + size].copy()
            row[own:] = 0
            rows.append(row)
            lengths.append(own)
            owners.append(item)
            places.append(at)
        begin += count
    words, which = np.unique(np.array(rows), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    return Windows(
        size, vocabulary, words, (words > 0).sum(axis=1), np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(words)))]),
        np.array(owners, np.int64)[order], np.array(places, np.int64)[order],
    )


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the words above 0, ordered by the ``depth`` words from there on; a 0 ends a suffix."""
    places = np.flatnonzero(words)
    rank = np.concatenate([words.astype(np.int64), np.zeros(2 * depth + 1, np.int64)])
    width = 1
    while width < depth and len(places):
        key = rank[places] * (int(rank.max()) + 1) + rank[places + width]
        _, ranks = np.unique(key, return_inverse=True)
        rank[places] = ranks.ravel() + 1
        width *= 2
    return places[np.argsort(rank[places], kind="stable")]


def search(words: np.ndarray, suffixes: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query its range of ``suffixes``: those that begin with its words."""
    size = queries.shape[1]
    padded = np.concatenate([words, np.zeros(size, words.dtype)])
    steps = np.arange(size)
    beyond = steps[None, :] >= lengths[:, None]

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(suffixes), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            seen = padded[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + steps]
            differs = (seen != queries) & ~beyond
            first = differs.argmax(axis=1)
            at = np.arange(len(queries))
            some = differs[at, first]
            right = np.where(some, seen[at, first] < queries[at, first], after_equal) & open_
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    if not len(suffixes):
        return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    return bound(False), bound(True)


def _expand(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each begin to its end in a row, and whose each is."""
    counts = ends - begins
    total = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - counts, counts) + begins[owner], owner


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
_FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, after: bigint>>, matches: array<struct<item_id: bigint, item_word: bigint, doc_word: bigint, n_words: bigint>>>"


def _lists(owner: np.ndarray, count: int, fields: dict[str, np.ndarray], kind: pa.DataType) -> pa.Array:
    """Rows in order of ``owner`` as one list an owner."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)


def shard_matches(texts: list[str | None], windows: Windows | None) -> pa.StructArray:
    """For each text its number of words, the spans of words inside windows, and the matches at full length."""
    flat, counts = word_array(texts)
    if windows is None:
        none = np.zeros(0, np.int64)
        spans = _lists(none, len(texts), {"first": none, "after": none}, _SPANS)
        matches = _lists(none, len(texts), {"item_id": none, "item_word": none, "doc_word": none, "n_words": none}, _MATCH)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), spans, matches], ["n_words", "spans", "matches"])
    known = pc.fill_null(pc.add(pc.index_in(flat, windows.vocabulary), 1), 0).to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts + 1) - (counts + 1)  # a break stands behind each text
    words = np.zeros(len(known) + len(texts), np.int64)
    words[np.arange(len(known)) + docs] = known
    low, high = search(words, suffixes := suffix_array(words, windows.size), windows.words, windows.lengths)
    rank, window = _expand(low, high)
    place = suffixes[rank]
    # Covered words: one up at the begin of each occurrence, one down behind it.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + windows.lengths[window], -1)
    inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    first, after = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    doc = np.searchsorted(starts, first, side="right") - 1
    spans = _lists(doc, len(texts), {"first": first - starts[doc], "after": after - starts[doc]}, _SPANS)
    # Occurrences of following windows of an item on one diagonal are one match.
    entry, occurrence = _expand(windows.item_ends[window], windows.item_ends[window + 1])
    item, at, where, length = windows.item_ids[entry], windows.item_places[entry], place[occurrence], windows.lengths[window[occurrence]]
    order = np.lexsort((at, where - at, item))
    item, at, where, length = item[order], at[order], where[order], length[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | ((where - at)[1:] != (where - at)[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(item))[:len(begin)] - 1
    size = at[end] - at[begin] + length[end]
    item, at, where = item[begin], at[begin], where[begin]
    doc = np.searchsorted(starts, where, side="right") - 1
    order = np.lexsort((item, where))
    doc, item, at, where, size = doc[order], item[order], at[order], where[order], size[order]
    matches = _lists(doc, len(texts), {"item_id": item, "item_word": at, "doc_word": where - starts[doc], "n_words": size}, _MATCH)
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), spans, matches], ["n_words", "spans", "matches"])


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct().toLocalIterator():
        if block and held + len(row["text"]) > block_chars:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    yield block


def _search_block(documents: DataFrame, name: str, windows: Windows | None, shard_chars: int) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(windows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            found = shard_matches(table["text"].to_pylist(), sent.value)
            yield from table.append_column(name, found).to_batches(max_chunksize=2_000)

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                before = int(sizes[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(sizes, before + shard_chars - chars, side="right")))
                held.append(batch.slice(begin, stop - begin))
                chars += int(sizes[stop - 1]) - before
                begin = stop
                if chars >= shard_chars or begin < batch.num_rows:
                    yield from close()
                    held, chars = [], 0
        if held:
            yield from close()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema]
    return documents.mapInArrow(find, ", ".join([*fields, f"`{name}` {_FOUND}"]))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, name: str = "overlap", window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Adds ``name``: a document's number of words, hit spans of words and matches with items, all from word 0.

    Every row stays, with its columns, which must not include ``name``. A null or empty text has no words. Items without ``item_id`` or text are
    no items; repeated ones count once. An empty benchmark or table gives no matches. A match is as long as the item and the document
    agree on whole windows.
    """
    out, names = documents, []
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        names.append(f"{name}_{k}")
        out = _search_block(out, names[-1], item_windows(block, window), shard_chars)
    found = [F.col(n) for n in names]
    spans, matches = F.flatten(F.array(*[c["spans"] for c in found])), F.flatten(F.array(*[c["matches"] for c in found]))
    merged = F.struct(found[0]["n_words"].alias("n_words"), (_union(spans) if len(found) > 1 else spans).alias("spans"), matches.alias("matches"))
    return out.withColumn(name, merged).drop(*names)


def _union(spans):
    """Overlapping spans as one, in order."""
    def join(done, span):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (span["first"] > last["after"])
        longer = F.struct(last["first"].alias("first"), F.greatest(last["after"], span["after"]).alias("after"))
        return F.when(apart, F.concat(done, F.array(span))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    none = F.array().cast("array<struct<first: bigint, after: bigint>>")
    return F.aggregate(F.array_sort(spans), none, join)


def overlap_columns(name: str = "overlap") -> dict:
    """Counts and the verdict from ``name``: hits are at least one in twenty words."""
    found = F.col(name)
    hit = F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["after"] - s["first"])
    items = F.array_sort(F.transform(F.array_distinct(found["matches"]["item_id"]), lambda x: x.cast("string")))
    return {
        "n_words": found["n_words"], "n_hit": hit, "n_items": F.size(items).cast("bigint"), "items_sha256": F.sha2(F.concat_ws(",", items), 256),
        "contaminated": (hit > 0) & (F.lit(20) * hit >= found["n_words"]),
    }


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    name = "overlap"
    while name in documents.columns or f"{name}_0" in documents.columns:
        name += "_"
    return find_overlaps(documents, benchmark, name).filter(~overlap_columns(name)["contaminated"]).drop(name)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its hit words and items."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(documents, spark.read.parquet(f"{folder}/benchmark.parquet")).drop("text")
    return found.select("doc_id", *[c.alias(n) for n, c in overlap_columns().items()])

_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, {_WORD_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 13) AS size, array_to_string(w[k + 1:k + least(len(w), 13)], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, k, array_to_string(w[k + 1:k + size], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS k FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, k, p.size, item_id FROM places p JOIN windows USING (key) WHERE p.size = windows.size),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS word FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
