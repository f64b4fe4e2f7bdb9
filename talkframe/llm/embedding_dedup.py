"""Near copies of vectors by exact cosine, in tiles ordered by principal components.

Vectors are turned onto their principal axes, which hold most of a product in few leading dimensions, and dealt into tiles by the first of
them. Tiles too far apart on it are never compared. Inside two tiles the leading dimensions are multiplied first; what the others
can add is bounded by the norms of the suffixes, and a pair stops once it cannot reach the threshold. What is left is decided on the
vectors as given, in double precision. A turn loses nothing, so the axes may come from a bounded sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.components import connected
from talkframe.llm.linking import in_cells
from talkframe.llm.storage import column, session_setting, settle

COSINE = 0.9
#: Vectors of a tile.
TILE = 4096
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: Dimensions after which a pair is looked at again.
STEPS = (16, 32)
#: Vectors that the axes are taken from, about.
AXES_ROWS = 100_000
AXES_TASKS = 8
#: Room for rounding in the bounds, never in the decision.
MARGIN = 1e-9


def _vectors(embeddings: DataFrame) -> DataFrame:
    """``(row, vec_id, width, digest, vector)``: usable vectors as double bytes, no digest for the others."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            digests, vectors, widths = [], [], []
            for values in column(batch, "embedding"):
                data = None
                if values.is_valid and len(values.values) and not values.values.null_count:
                    data = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if not np.isfinite(data).all() or not (0 < float(data @ data) < np.inf):
                        data = None
                vectors.append(None if data is None else data.tobytes())
                digests.append(None if data is None else hashlib.blake2b(vectors[-1], digest_size=16).digest())
                widths.append(0 if data is None else len(data))
            rows = np.arange(row, row + batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows), column(batch, "vec_id"), pa.array(widths, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["row", "vec_id", "width", "digest", "vector"])
            row += batch.num_rows

    return embeddings.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(pack, "row bigint, vec_id bigint, width int, digest binary, vector binary")


def principal_axes(vectors: DataFrame, width: int, count: int) -> np.ndarray:
    """Orthogonal axes of unit vectors, those of most spread first, from an even part of about ``AXES_ROWS`` of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(np.frombuffer(b"".join(column(batch, "vector").to_pylist())).reshape(-1, width))
                total += unit.T @ unit
        yield pa.RecordBatch.from_pydict({"moments": [total.tobytes()]})

    keep = min(1 << 20, (AXES_ROWS << 20) // max(1, count))
    part = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < keep).select("vector")
    sums = part.repartition(AXES_TASKS).mapInArrow(moments, "moments binary").collect()
    _, axes = np.linalg.eigh(sum(np.frombuffer(r["moments"]).reshape(width, width) for r in sums))
    return np.ascontiguousarray(axes[:, ::-1])


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def strip_links(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, least: float, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two sets of turned unit vectors; ``raw`` are the vectors as given. ``skip`` marks pairs to leave out."""
    width = a.shape[1]
    steps = [s for s in STEPS if s < width] + [width]
    product = a[:, :steps[0]] @ b[:, :steps[0]].T
    rest_a, rest_b = (np.sqrt(np.maximum((x[:, steps[0]:] ** 2).sum(axis=1), 0)) for x in (a, b))
    open_ = product + np.outer(rest_a, rest_b) >= least - MARGIN
    if skip is not None:
        open_ &= ~skip
    of, to = np.nonzero(open_)
    found = [], []
    for begin in range(0, len(of), 20_000):
        i, j = of[begin:begin + 20_000], to[begin:begin + 20_000]
        so_far = product[i, j]
        for low, high in zip(steps, steps[1:]):
            so_far = so_far + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
            rest = np.sqrt((a[i, high:] ** 2).sum(axis=1)) * np.sqrt((b[j, high:] ** 2).sum(axis=1))
            stay = so_far + rest >= least - MARGIN
            i, j, so_far = i[stay], j[stay], so_far[stay]
        x, y = raw_a[i], raw_b[j]
        dots, norms = np.einsum("ij,ij->i", x, y), np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        sure = dots / norms >= least
        found[0].append(i[sure])
        found[1].append(j[sure])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def _forest(of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect: each end with the smallest end it hangs together with."""
    nodes, ends = np.unique(np.concatenate([of, to]), return_inverse=True)
    x, y = ends[:len(of)], ends[len(of):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, new[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _tile_links(width: int, axes: np.ndarray, least: float):
    def work(cell: pa.Table) -> dict[str, np.ndarray]:
        sides = []
        for k in np.argsort(cell["side"].to_numpy()).tolist():
            raw = np.frombuffer(cell["vectors"][k].as_py()).reshape(-1, width)
            sides.append((np.frombuffer(cell["ids"][k].as_py(), np.int64), np.frombuffer(cell["copies"][k].as_py(), np.int64), raw, _unit(raw) @ axes))
        same = len(sides) == 1
        (ids_a, copies_a, raw_a, a), (ids_b, copies_b, raw_b, b) = sides[0], sides[-1]
        counts = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends = [], []
        for begin in range(0, len(a), STRIP):
            at = np.arange(begin, min(begin + STRIP, len(a)))
            skip = np.arange(len(b))[None, :] <= at[:, None] if same else None
            of, to = strip_links(a[at], b, raw_a[at], raw_b, least, skip)
            if len(of):
                of = of + begin
                np.add.at(counts[0], of, copies_b[to])
                np.add.at(counts[1], to, copies_a[of])
                low, high = _forest(ids_a[of], ids_b[to])
                ends[0].append(low)
                ends[1].append(high)
        if not ends[0]:
            none = np.zeros(0, np.int64)
            return {"a": none, "b": none, "n": none}
        a_ends, b_ends = np.concatenate(ends[0]), np.concatenate(ends[1])
        counted, n = np.concatenate([ids_a, ids_b]), np.concatenate(counts)
        counted, n = counted[n > 0], n[n > 0]
        return {"a": np.concatenate([a_ends, counted]), "b": np.concatenate([b_ends, counted]), "n": np.concatenate([np.zeros(len(a_ends), np.int64), n])}

    return work


def _linked_classes(items: DataFrame, width: int, least: float) -> DataFrame:
    """``(a, b, n)`` for distinct vectors of one width: links for ``n`` 0, else the number of vectors that ``a`` is linked with."""
    spark = items.sparkSession
    count = items.count()
    axes = principal_axes(items, width, count)
    sent = spark.sparkContext.broadcast(axes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = np.clip(_unit(np.frombuffer(b"".join(column(batch, "vector").to_pylist())).reshape(-1, width)) @ sent.value[:, 0], -1, 1)
                yield batch.append_column("angle", pa.array(np.arccos(lead)))

    turned = settle(items.select("id", "copies", "vector").mapInArrow(first, "id bigint, copies bigint, vector binary, angle double"), "turned")
    tiles = max(1, -(-count // TILE))
    cuts = turned.select(F.percentile_approx("angle", [k / tiles for k in range(1, tiles)], 100 * tiles)).first()[0] if tiles > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    # Equal angles could fill one tile; they are dealt on by id.
    tile = F.size(F.filter(bounds, lambda c: c <= F.col("angle"))).cast("bigint")
    counted = turned.withColumn("tile", tile)
    sizes = settle(counted.groupBy("tile").agg(F.count("*").alias("n")), "tile-sizes")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (2 * TILE)))
    placed = settle(counted.join(F.broadcast(sizes), "tile").select("id", "copies", "vector", "angle", "tile", part.alias("part")), "placed-vectors")

    def pack(cell: pa.Table) -> dict[str, np.ndarray]:
        angle = cell["angle"].to_numpy()
        return {
            "tile": cell["tile"].to_numpy()[:1], "part": cell["part"].to_numpy()[:1], "low": np.array([angle.min()]), "high": np.array([angle.max()]),
            "ids": np.array([cell["id"].to_numpy().tobytes()], object), "copies": np.array([cell["copies"].to_numpy().tobytes()], object),
            "vectors": np.array([b"".join(cell["vector"].to_pylist())], object),
        }

    packed = settle(in_cells(placed, ["tile", "part"], pack, "tile bigint, part bigint, low double, high double, ids binary, copies binary, vectors binary"), "tiles")
    order = packed.select("tile", "part", "low", "high").orderBy("low", "tile", "part").collect()  # a row a tile
    reach, near = [], float(np.arccos(least)) + 1e-6
    for i, row in enumerate(order):
        last = i
        while last + 1 < len(order) and order[last + 1]["low"] <= max(row["high"], order[i]["high"]) + near:
            last += 1
        reach.append((row["tile"], row["part"], i, last))
    numbered = packed.join(F.broadcast(spark.createDataFrame(reach, "tile bigint, part bigint, i bigint, last bigint")), ["tile", "part"])
    windows = spark.createDataFrame([(i, last) for _, _, i, last in reach], "i bigint, last bigint").select("i", F.explode(F.sequence("i", "last")).alias("j"))
    pairs = settle(windows, "tile-pairs")
    data = numbered.select(F.col("i").alias("k"), "ids", "copies", "vectors")
    left = pairs.join(data, F.col("i") == F.col("k")).select("i", "j", F.lit(0).alias("side"), "ids", "copies", "vectors")
    right = pairs.filter("i <> j").join(data, F.col("j") == F.col("k")).select("i", "j", F.lit(1).alias("side"), "ids", "copies", "vectors")
    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4"):
        return settle(in_cells(left.unionByName(right), ["i", "j"], _tile_links(width, axes, least), "a bigint, b bigint, n bigint"), "vector-links")


def near_vectors(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings`` (``vec_id``, ``embedding``).

    Two vectors are linked if their cosine is at least ``least``. Vectors that are null, empty, zero, or hold null or non-finite components, and
    vectors of different widths, are not linked. Equal vectors are one class and count each other. A component is named by its smallest ``vec_id``; rows
    without one link like others but name nothing. Rows with one id are rows of their own. Other columns are not read. An empty table gives no rows.
    """
    vectors = settle(_vectors(embeddings), "vectors")
    classes = settle(vectors.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("id"), F.count("*").alias("copies")), "vector-classes")
    items = settle(vectors.join(classes.select("id", "copies"), vectors["row"] == F.col("id")).select("id", "copies", "width", "vector"), "distinct-vectors")
    empty = embeddings.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    found = empty
    for row in items.select("width").distinct().orderBy("width").collect():
        found = found.unionByName(_linked_classes(items.filter(F.col("width") == row["width"]).select("id", "copies", "vector"), row["width"], least))
    parts = settle(connected(found.filter("n = 0").select("a", "b")), "vector-components")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    known = settle(classes.join(parts, "id", "left").join(counts, "id", "left").select("digest", F.coalesce("component", "id").alias("part"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-parts")
    rows = vectors.select("row", "vec_id", "digest")
    placed = settle(rows.join(known, "digest", "left").select("vec_id", F.coalesce("part", "row").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed-parts")
    named = settle(placed.groupBy("part").agg(F.min("vec_id").alias("component_id")), "vector-names")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return placed.join(named, "part").select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sized AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM vectors WHERE list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT reach.a AS vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(b) AS component_id, reach.a = min(b) AS kept
FROM reach LEFT JOIN degrees ON degrees.a = reach.a GROUP BY reach.a
"""
