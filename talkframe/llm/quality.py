"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

A pass over the texts leaves a few numbers of each document. Cosines of random projections of them stand for a Gaussian
kernel; partitions sum the normal equations of a ridge fit over labelled documents, and scores are calibrated on labelled documents
that the fit has not seen. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, pieces, settle

#: Labelled documents that the fit and the calibration use at most (about); beyond, an even part of them by hash of the id.
FIT_ROWS = 200_000
#: Tasks that sum normal equations; each sends one matrix to the driver.
FIT_TASKS = 12
FOURIER = 256
BANDWIDTH = 8.0
RIDGE = 1.0
BINS = 500
SEED = 20240229

STATISTICS = [
    "log_chars", "lower", "upper", "digits", "spaces", "lines", "full_stops", "other_marks", "beyond_ascii", "word_chars", "word_spread",
    "log_words", "distinct_words", "distinct_pairs", "top_word", "capital_words", "marked_words", "short_words", "long_words", "distinct_lines",
    "line_chars", "byte_entropy", "pipes", "log_repeats",
]

_KINDS = np.full(256, 7, np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[32], _KINDS[10], _KINDS[128:], _KINDS[124] = 0, 1, 2, 3, 4, 8, 9
_KINDS[[46, 44]] = 5
_N_KINDS = 10


def _rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(owner: np.ndarray, code: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct codes and the count of its most frequent one."""
    if not len(code):
        return np.zeros(count), np.zeros(count)
    key = np.sort(owner * (int(code.max()) + 1) + code)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, times = key[first] // (int(code.max()) + 1), np.diff(np.append(first, len(key)))
    top = np.zeros(count, np.int64)
    np.maximum.at(top, own, times)
    return np.bincount(own, minlength=count).astype(float), top.astype(float)


def text_statistics(texts: list[str]) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros for all rates."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    byte_counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    kinds = np.zeros((n, _N_KINDS))
    for k in range(_N_KINDS):
        kinds[:, k] = byte_counts[:, _KINDS == k].sum(axis=1)
    share = byte_counts / np.maximum(sizes, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    values = pa.array(texts, pa.large_string())
    split = pc.split_pattern_regex(values, r"[ \n\t\r]+")
    flat, ends = split.flatten(), split.offsets.to_numpy()
    word_owner = np.repeat(np.arange(n), np.diff(ends))
    lengths = pc.utf8_length(flat).to_numpy().astype(float)
    codes = pc.dictionary_encode(pc.utf8_lower(flat)).indices.to_numpy().astype(np.int64)
    words = np.bincount(word_owner, minlength=n).astype(float)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner, weights=x.astype(float), minlength=n)

    def words_like(pattern: str) -> np.ndarray:
        return per_text(pc.match_substring_regex(flat, pattern).to_numpy(zero_copy_only=False))

    mean = _rate(per_text(lengths), words)
    spread = np.sqrt(np.maximum(_rate(per_text(lengths**2), words) - mean**2, 0))
    kinds_of_words, top = _distinct(word_owner, codes, n)
    follows = word_owner[1:] == word_owner[:-1]
    pair_codes = (codes[:-1] * 1_000_003 + codes[1:])[follows] % (1 << 40)
    pairs, top_pair = _distinct(word_owner[1:][follows], pair_codes, n) if follows.any() else (np.zeros(n), np.zeros(n))
    lines = pc.split_pattern(values, "\n")
    line_ends = lines.offsets.to_numpy()
    line_owner = np.repeat(np.arange(n), np.diff(line_ends))
    line_counts = np.diff(line_ends).astype(float)
    line_kinds, _ = _distinct(line_owner, pc.dictionary_encode(lines.flatten()).indices.to_numpy().astype(np.int64), n)
    chars = sizes.astype(float)
    return np.column_stack([
        np.log1p(chars), _rate(kinds[:, 0], chars), _rate(kinds[:, 1], chars), _rate(kinds[:, 2], chars), _rate(kinds[:, 3], chars), _rate(kinds[:, 4], chars),
        _rate(kinds[:, 5], words), _rate(kinds[:, 7], words), _rate(kinds[:, 8], chars), mean, spread,
        np.log1p(words), _rate(kinds_of_words, words), _rate(pairs, np.maximum(words - 1, 0)), _rate(top, words), _rate(words_like("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"), words),
        _rate(words_like("[^A-Za-z0-9.,\\x{80}-\\x{10FFFF}]"), words), _rate(per_text(lengths <= 2), words), _rate(per_text(lengths >= 15), words), _rate(line_kinds, line_counts),
        np.log1p(_rate(chars, line_counts)), entropy, _rate(kinds[:, 9], words), np.log1p(top_pair),
    ])


def document_statistics(documents: DataFrame) -> DataFrame:
    """``(doc_id, statistics)`` of every row; a null text is empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            rows = text_statistics(texts)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["doc_id", "statistics"])

    return documents.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, statistics array<double>")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels nothing learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


class QualityModel:
    """Standardisation, random features, weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.frequencies = draw.normal(0, 1 / BANDWIDTH, (len(mean), FOURIER))
        self.phases = draw.uniform(0, 2 * np.pi, FOURIER)
        self.weights: np.ndarray | None = None
        self.knots, self.levels = np.zeros(1), np.full(1, 0.5)

    def features(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FOURIER) * np.cos(x @ self.frequencies + self.phases)
        return np.column_stack([np.ones(len(x)), waves])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights if self.weights is not None else np.zeros(len(statistics))

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.knots, self.levels), 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "statistics") -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest rising values, by pooling neighbours that fall."""
    levels: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist()):
        levels.append([value, weight, 1])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            v, w, n = levels.pop()
            u = levels[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + n
    return np.concatenate([np.full(int(n), v) for v, _, n in levels]) if levels else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """A model from texts of ``documents`` and ``labels`` (``doc_id``, ``quality`` 0 or 1), of about ``fit_rows`` labelled ids at most.

    Held-out rows and rows without a label teach nothing; a document labelled more than once has the rounded mean. Without both
    labels every score is the share of label 1, or 0.5 without any.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    marked = settle(marked.filter(~held_out(F.col("doc_id"))), "quality-labels")
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 20))
    keep = min(1 << 20, (fit_rows << 20) // max(1, marked.count()))
    marked = marked.filter(spread < keep).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(4)) == 0)
    labelled = documents.select("doc_id", "text").join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    taught = settle(document_statistics(labelled).join(F.broadcast(marked), "doc_id"), "quality-labelled")
    width = len(STATISTICS)
    parts = [F.col("statistics")[i] for i in range(width)]
    sums = taught.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *[F.avg(p).alias(f"m{i}") for i, p in enumerate(parts)], *[F.stddev_pop(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
    if not sums["n"] or sums["ones"] in (0, sums["n"]):
        model = QualityModel(np.zeros(width), np.ones(width))
        model.levels = np.full(1, sums["ones"] / sums["n"] if sums["n"] else 0.5)
        return model
    model = QualityModel(np.array([sums[f"m{i}"] for i in range(width)]), np.maximum([sums[f"s{i}"] for i in range(width)], 1e-6))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1), 0
        for batch in batches:
            if batch.num_rows:
                x, y = model.features(_matrix(batch)), column(batch, "label").to_numpy()
                left, right, n = left + x.T @ x, right + x.T @ y, n + len(y)
        yield pa.RecordBatch.from_pydict({"left": [left.tobytes()], "right": [right.tobytes()], "n": [n]})

    rows = taught.filter(~F.col("calibrates")).select("statistics", "label").repartition(FIT_TASKS).mapInArrow(equations, "left binary, right binary, n bigint").collect()
    left = sum(np.frombuffer(r["left"]).reshape(FOURIER + 1, -1) for r in rows)
    right = sum(np.frombuffer(r["right"]) for r in rows)
    penalty = RIDGE * np.eye(FOURIER + 1)
    penalty[0, 0] = 0
    model.weights = np.linalg.lstsq(left + penalty, right, rcond=None)[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch))
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), column(batch, "label")], ["raw", "bin", "label"])

    binned = taught.filter("calibrates").select("statistics", "label").mapInArrow(place, "raw double, bin int, label double")
    curve = binned.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")).orderBy("bin").collect()
    if curve:
        levels = isotonic(np.array([r["label"] for r in curve]), np.array([float(r["n"]) for r in curve]))
        # A slight slope keeps the order inside a level.
        model.knots = np.array([r["raw"] for r in curve])
        model.levels = 0.001 + 0.998 * levels + 0.001 * np.clip(model.knots, -1, 1)
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``documents``.

    A null text is empty and is scored as such. Repeated rows and rows without an id are scored each. Columns other than ``doc_id`` and ``text`` are
    not read. An empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, fit_rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sent.value.score(text_statistics(texts)))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(apply, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_low_quality(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``least``, with their columns as they are."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield batch.filter(pa.array(sent.value.score(text_statistics(texts)) >= least))

    return documents.mapInArrow(keep, documents.schema)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fold."""
    return score_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
