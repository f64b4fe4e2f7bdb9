"""Near copies of documents, by MinHash bands, odd sketches and exact comparison.

MinHash samples of a document's word shingles give its band keys. The same samples, folded into a bitmap by parity, are its odd
sketch: the bits in which two sketches differ tell how many samples differ, most precisely where few do. Pairs that share a
band and whose sketches allow it are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.llm.components import connected
from talkframe.llm.linking import bounded, links
from talkframe.llm.storage import column, parts_for, pieces, settle

#: Similarity of a link, in hundredths.
PERCENT = 85
SHINGLE = 3
BANDS = 32
SAMPLES = 256
#: How often the bands may miss a pair at the threshold.
MISSED = 1e-5
SKETCH_BITS = 1024
#: Standard deviations of the sketch's estimate that a likely pair may lie beyond the threshold.
SLACK = 5.0
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_DRAW = np.random.default_rng(85)
_FACTORS = _DRAW.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _DRAW.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; fewer words than ``width`` are one shingle, none give none."""
    folded = pa.array([t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts], pa.large_binary())
    parts = pc.split_pattern(folded, b" ")
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    word = pc.binary_length(flat).to_numpy() > 0
    counts = np.diff(np.concatenate([[0], np.cumsum(word)])[ends])
    coded = flat.filter(pa.array(word)).dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(min(width, len(hashes))):
        rolled[:len(hashes) - k] = mix(rolled[:len(hashes) - k] + hashes[k:])
    sets, begin = [], 0
    for count in counts.tolist():
        if count >= width:
            sets.append(np.unique(rolled[begin:begin + count - width + 1]))
        elif count:
            whole = np.zeros(1, np.uint64)
            for h in hashes[begin:begin + count]:
                whole = mix(whole + h)
            sets.append(mix(whole + np.uint64(count)))
        else:
            sets.append(np.zeros(0, np.uint64))
        begin += count
    return sets


def minima(values: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of consecutive sets: ``values`` from each of ``starts`` to the next. One row a sample."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out, work = np.empty((samples, len(starts)), np.uint32), np.empty_like(low)
    for k in range(samples):
        np.multiply(low, _FACTORS[k], out=work)
        np.add(work, _ADDENDS[k], out=work)
        np.minimum.reduceat(work, starts, out=out[k])
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band."""
    keys = np.empty((samples.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for row in samples[b * rows:(b + 1) * rows]:
            key = mix(key + row)
        keys[:, b] = key
    return keys.view(np.int64)


def band_rows(percent: int) -> int:
    """Samples of a band: the most with which the bands still find pairs at the threshold."""
    return max((r for r in range(1, SAMPLES // BANDS + 1) if (1 - (percent / 100) ** r) ** BANDS <= MISSED), default=1)


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bitmap for each set: the parity of how many samples fall on each bit."""
    count = samples.shape[1]
    numbered = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64)[:, None] << np.uint64(32)))
    at = (numbered % np.uint64(bits)).astype(np.int64) + np.arange(count) * bits
    return np.packbits((np.bincount(at.ravel(), minlength=count * bits) & 1).reshape(count, bits).astype(np.uint8), axis=1)


def estimate(differing: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """The similarity of two sets whose sketches differ in so many bits."""
    share = np.minimum(2 * differing / bits, 0.999)
    return 1 + np.log1p(-share) * bits / (4 * samples)


def farthest(percent: int = PERCENT, samples: int = SAMPLES, bits: int = SKETCH_BITS, slack: float = SLACK) -> int:
    """Differing bits up to which a pair of that similarity is likely."""
    similar = percent / 100
    least = similar - slack * np.sqrt(similar * (1 - similar) / samples)
    toggles = 2 * samples * (1 - least)
    mean = bits / 2 * -np.expm1(-2 * toggles / bits)
    return int(mean + slack * np.sqrt(bits / 4 * -np.expm1(-4 * toggles / bits)) / 2)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class SetSimilarity:
    """Odd sketches first, full sets of hashes for the decision."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.most = percent, farthest(percent)

    def likely(self, left, right, of, to):
        a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (left, right))
        yes = np.zeros(len(of), bool)
        for k in range(0, len(of), 20_000):
            yes[k:k + 20_000] = _ONES[a[of[k:k + 20_000]] ^ b[to[k:k + 20_000]]].sum(axis=1, dtype=np.int32) <= self.most
        return yes

    def linked(self, left, right, of, to):
        a, b = [np.frombuffer(x, np.uint64) for x in left], [np.frombuffer(x, np.uint64) for x in right]
        common = intersections(a, b, of, to)
        size_a, size_b = np.array([len(x) for x in a])[of], np.array([len(x) for x in b])[to]
        return (common > 0) & (100 * common >= self.percent * (size_a + size_b - common))


def intersections(a: list[np.ndarray], b: list[np.ndarray], of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    if len(of) < 4 * (len(a) + len(b)):
        out = np.zeros(len(of), np.int64)
        for k, (i, j) in enumerate(zip(of.tolist(), to.tolist())):
            both = np.concatenate([a[i], b[j]])
            both.sort()
            out[k] = (both[1:] == both[:-1]).sum()
        return out
    # Many pairs of few sets: products of their membership tables, some columns at a time.
    sets = a + b
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    if not len(values):
        return np.zeros(len(of), np.int64)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    shared = np.append(False, same) | np.append(same, False)  # values of one set alone add nothing
    values, owner = values[shared], owner[shared]
    code = np.cumsum(np.append(False, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    total, width = np.zeros((len(a), len(b)), np.int64), 8192
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [begin, begin + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[low:high], code[low:high] - begin] = 1
        total += (table[:len(a)] @ table[len(a):].T).astype(np.int64)
    return total[of, to]


_SKETCHED = "row bigint, doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch binary"


def sketch_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(row, doc_id, n_shingles, digest, keys, sketch)``: every row with a number of its own; equal sets have equal digests."""
    band = band_rows(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch, texts in pieces(batches, chars=1 << 18):
            sets = shingle_sets(texts, shingle)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys, sketches = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SKETCH_BITS // 8), np.uint8)
            if len(full):
                samples = minima(np.concatenate(sets), np.cumsum(sizes)[full] - sizes[full], SAMPLES)
                keys[full], sketches[full] = band_keys(samples, BANDS, band), odd_sketches(samples)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(sets))), column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())), pa.array([s.tobytes() for s in sketches]),
            ], ["row", "doc_id", "n_shingles", "digest", "keys", "sketch"])
            row += len(sets)

    return documents.select("doc_id", "text").mapInArrow(sketch, _SKETCHED)


def _sets_of(documents: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``(id, content)``: the sets of the documents in ``rows`` (``id``, ``doc_id``, ``digest``), computed again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            content = [s.tobytes() for s in shingle_sets(texts, shingle)]
            digests = [hashlib.blake2b(c, digest_size=16).digest() for c in content]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(digests), pa.array(content)], ["doc_id", "digest", "content"])

    wanted = bounded(settle(rows.select("doc_id").distinct(), "wanted"))
    some = documents.select("doc_id", "text").join(wanted, documents["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    found = some.mapInArrow(sets, "doc_id bigint, digest binary, content binary")
    known = rows.withColumnRenamed("digest", "digest_").withColumnRenamed("doc_id", "doc_id_")
    joined = found.join(known, (F.col("digest") == F.col("digest_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")))
    return joined.select("id", "content").dropDuplicates(["id"])


def near_groups(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, digest, component_id, first_row, row)`` of every row of ``documents`` (``doc_id``, ``text``).

    Documents whose sets have a similarity of ``percent`` hundredths or more are linked; a component is named by its smallest ``doc_id``.
    ``first_row`` is true for one row of each component: of its smallest id, the first. A null or empty text has no shingles and is alone. Rows without
    ``doc_id`` link like others but name nothing; a component of such rows alone has no id. An empty table gives no rows.
    """
    rows = settle(sketch_documents(documents, shingle, percent), "sketches")
    files = parts_for(rows.count())
    classes = settle(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("id")), "classes", files)
    items = settle(rows.join(classes.select("id"), rows["row"] == F.col("id"), "left_semi").select(F.col("row").alias("id"), F.col("n_shingles").alias("size"), "keys", "sketch"), "items", files)
    named = rows.select("row", "doc_id", "digest")

    def contents(ids: DataFrame) -> DataFrame:
        wanted = settle(named.join(ids, named["row"] == ids["id"]).select("id", "doc_id", "digest"), "wanted-rows", files)
        return _sets_of(documents, wanted, shingle)

    found = links(items, contents, SetSimilarity(percent), percent / 100)
    parts = settle(connected(found, files), "components", files)
    class_parts = settle(classes.join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("part")), "class-parts", files)
    narrow = rows.select("row", "doc_id", "n_shingles", "digest")
    placed = narrow.join(class_parts, "digest", "left").withColumn("part", F.coalesce("part", "row"))
    placed = settle(placed, "placed", files)
    first = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    first = settle(first.select("part", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first")), "firsts", files)
    return placed.join(first, "part").select("doc_id", "n_shingles", "digest", "component_id", (F.col("row") == F.col("first")).alias("first_row"), "row")


def remove_near_copies(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, with the columns of ``documents`` as they are."""
    groups = settle(near_groups(documents, percent, shingle), "near-groups")
    # An id that several rows carry, or none, says nothing of a row; such rows are told apart by their sets.
    ids = settle(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("first_row").alias("stays")), "ids")
    gone = bounded(settle(ids.filter("n = 1 and doc_id is not null and not stays").select("doc_id"), "gone"))
    doubtful = bounded(settle(ids.filter("n > 1 or doc_id is null").select("doc_id"), "doubtful"))
    once = documents.join(gone, "doc_id", "left_anti").join(doubtful, documents["doc_id"].eqNullSafe(doubtful["doc_id"]), "left_anti").select(documents.columns)
    several = documents.join(doubtful, documents["doc_id"].eqNullSafe(doubtful["doc_id"]), "left_semi")
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    several = several.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, names["text"]):
            yield batch.append_column("digest", pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in shingle_sets(texts, shingle)], pa.binary()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in several.schema)
    several = several.mapInArrow(digests, f"{fields}, digest binary")
    # Empty texts are never copies of each other: as many stay as there were.
    stay = groups.filter("first_row").groupBy("doc_id", "digest").agg(F.count("*").alias("stay_")).select(F.col("doc_id").alias("doc_id_"), F.col("digest").alias("digest_"), "stay_")
    several = several.join(stay, F.col(names["doc_id"]).eqNullSafe(F.col("doc_id_")) & (F.col("digest") == F.col("digest_")))
    order = Window.partitionBy(names["doc_id"], "digest").orderBy(*[n for c, n in names.items() if c != "doc_id"])
    several = several.withColumn("rank_", F.row_number().over(order)).filter("rank_ <= stay_")
    return once.unionByName(several.select([F.col(n).alias(c) for c, n in names.items()]))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every document under a similarity of 0.85 on shingles of three words."""
    groups = near_groups(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[k + 1:k + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS k FROM docs WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a)
SELECT a AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a
"""
