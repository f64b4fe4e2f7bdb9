"""Links between similar items without pairs of all members of a group.

Items carry band keys: two similar items share a key with high probability. The smallest item of a key leads it. Round one
compares each item with the leaders of its keys. In a group of near copies that settles most members; what is left are the
members unlike their leader, the minors. Round two compares minors, and only them, with all members: first by
sketches, in the keys, which leaves clusters of likely links, then exactly, in the clusters. A pair of two members that
already hang together is never looked at. Rounds work in cells of a bounded number of rows, so a group of any size spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.components import connected
from talkframe.llm.storage import column, parts_for, settle

#: Minors and members that meet in one cell, each.
CELL = 96
#: Ids that are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Similarity(Protocol):
    """How two items are compared; ``sketch`` and ``content`` are binary columns."""

    def likely(self, left: list[bytes], right: list[bytes], of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """For pairs of places in the two lists: whether the sketches allow a link."""

    def linked(self, left: list[bytes], right: list[bytes], of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """For pairs of places in the two lists: whether the contents are linked."""


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast where it has at most ``rows`` of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_cells(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Calls ``work`` once for the rows of each value of ``keys``, which must be few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: dict[str, list[np.ndarray]] = {}

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if out and sum(len(x) for x in next(iter(out.values()))) >= least:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in out.items()})
                out.clear()

        def finish(table: pa.Table, ends: list[int]) -> None:
            for begin, end in zip([0, *ends[:-1]], ends):
                for k, v in work(table.slice(begin, end - begin)).items():
                    out.setdefault(k, []).append(v)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            changed = np.zeros(table.num_rows - 1, bool)
            for key in keys:
                values = table[key].to_numpy()
                changed |= values[1:] != values[:-1]
            ends = (np.flatnonzero(changed) + 1).tolist()
            finish(table, ends)
            held = table.slice(ends[-1] if ends else 0)
            yield from flush(1_000)
        if held is not None:
            finish(held, [held.num_rows])
        yield from flush(1)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _cells(rows: DataFrame, group: str, parts: int, cell: int) -> DataFrame:
    """Each minor of a group meets each member in one cell ``(group, g, h)``."""
    sizes = settle(rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("minor").cast("int")).alias("m")).filter("n > 1 and m > 0"), "cell-sizes", parts)
    across, down = F.ceil(F.col("n") / cell), F.ceil(F.col("m") / cell)
    placed = rows.join(sizes, group)
    g, h = F.pmod(F.xxhash64("id"), across), F.pmod(F.xxhash64("id", F.lit(7)), down)
    members = placed.select(*rows.columns, F.lit(False).alias("asks"), g.alias("g"), F.explode(F.sequence(F.lit(0).cast("bigint"), down - 1)).alias("h"))
    minors = placed.filter("minor").select(*rows.columns, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("g"), h.alias("h"))
    return members.unionByName(minors)


def _spanning(left: np.ndarray, right: np.ndarray, left_group: np.ndarray, right_group: np.ndarray) -> np.ndarray:
    """Places of links that join groups not joined by the links before them."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := head.get(x, x)) != x:
            head[x] = x = head.get(y, y)
        return x

    keep = []
    _, first = np.unique(np.column_stack([left_group, right_group]), axis=0, return_index=True)
    for i in np.sort(first).tolist():
        a, b = find(int(left_group[i])), find(int(right_group[i]))
        if a != b:
            head[a] = b
            keep.append(i)
    return np.array(keep, np.int64)


def _ask(compare: Callable, name: str, before: Callable | None = None) -> Callable[[pa.Table], dict[str, np.ndarray]]:
    """Compares the asking rows of a cell with its members, those of one ``part`` never and two minors in one cell alone."""

    def work(cell: pa.Table) -> dict[str, np.ndarray]:
        asks, minor = cell["asks"].to_numpy(), cell["minor"].to_numpy()
        ids, parts = cell["id"].to_numpy(), cell["part"].to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        none = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        if not len(left) or not len(right):
            return none
        twice = minor[right] & (ids[right] < ids[left][:, None])  # the other one asks
        of, to = np.nonzero((parts[left][:, None] != parts[right]) & ~twice)
        for step, data in ((before, "sketch"), (compare, name)):
            if step is not None and len(of):
                a, b = cell[data].take(pa.array(left)).to_pylist(), cell[data].take(pa.array(right)).to_pylist()
                yes = step(a, b, of, to)
                of, to = of[yes], to[yes]
                if len(of):  # only the rows that are still asked about
                    (rows, of), (others, to) = np.unique(of, return_inverse=True), np.unique(to, return_inverse=True)
                    left, right = left[rows], right[others]
        if not len(of):
            return none
        of, to = left[of], right[to]
        keep = _spanning(of, to, parts[of], parts[to])
        return {"a": ids[of[keep]], "b": ids[to[keep]]}

    return work


def _pairs_that(pairs: DataFrame, compare: Callable, left: str, right: str) -> DataFrame:
    """The rows of ``pairs`` whose two columns ``compare`` accepts, without them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                at = np.arange(part.num_rows)
                yes = compare(column(part, left).to_pylist(), column(part, right).to_pylist(), at, at)
                yield part.filter(pa.array(yes)).drop_columns([left, right])

    kept = [f for f in pairs.schema if f.name not in (left, right)]
    return pairs.mapInArrow(check, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))


def links(items: DataFrame, contents: Callable[[DataFrame], DataFrame], similarity: Similarity, ratio: float, cells: int = 1) -> DataFrame:
    """``(a, b)``: exact links that connect all similar items.

    ``items`` is a written table of ``id`` (long), ``size``, ``keys`` (array of long) and ``sketch``; ``contents`` gives ``(id, content)`` for a
    table of ids. Sizes of linked items have at least the ratio ``ratio``. The links connect the components that all pairs which
    share a key and are linked would; they are not all such pairs. ``cells`` times as many small items as ``CELL`` meet at once.
    """
    files, cell = parts_for(items.count()), cells * CELL
    places = items.select("id", F.explode("keys").alias("key"))
    leaders = settle(places.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1").select("key", "leader"), "leaders", files)
    shared = settle(places.join(bounded(leaders), "key").filter("id <> leader"), "shared-keys", files)
    known = items.select("id", "size", "sketch")
    leading = known.select(F.col("id").alias("leader"), F.col("size").alias("leader_size"), F.col("sketch").alias("leader_sketch"))
    sizes = F.least("size", "leader_size") >= ratio * F.greatest("size", "leader_size")
    sketched = shared.select("id", "leader").distinct().join(known, "id").join(leading, "leader").filter(sizes).drop("size", "leader_size")
    stars = settle(_pairs_that(sketched, similarity.likely, "sketch", "leader_sketch"), "likely-stars", files)

    # Minors of each key, asked by sketch.
    known = known.drop("size")
    like = stars.withColumn("like", F.lit(True))
    seen = shared.select("key", "id", "leader").join(like, ["id", "leader"], "left").select("key", "id", F.coalesce("like", F.lit(False)).alias("like"), "leader")
    seen = settle(seen, "seen", files)
    open_keys = seen.groupBy("key").agg(F.count("*").alias("n"), F.sum((~F.col("like")).cast("int")).alias("m")).filter("n > 1 and m > 0").select("key")
    waiting = seen.join(bounded(settle(open_keys, "open-keys", files)), "key")
    part = F.when(F.col("like"), F.col("leader")).otherwise(F.col("id"))
    waiting = settle(waiting.select("key", "id", (~F.col("like")).alias("minor"), part.alias("part")).join(known, "id"), "waiting", files)
    more = in_cells(_cells(waiting, "key", files, cell), ["key", "g", "h"], _ask(similarity.likely, "sketch"), "a bigint, b bigint")
    likely = stars.select(F.col("id").alias("a"), F.col("leader").alias("b")).unionByName(more)

    clusters = settle(connected(likely, files), "clusters", files)
    held = settle(contents(clusters.select("id")), "contents", files)

    # The same, exactly: stars first, then the minors of each cluster.
    full = stars.join(held, "id").join(held.select(F.col("id").alias("leader"), F.col("content").alias("leader_content")), "leader")
    sure = settle(_pairs_that(full, similarity.linked, "content", "leader_content").select(F.col("id").alias("a"), F.col("leader").alias("b")), "sure-stars", files)
    joined = connected(sure, files).withColumnRenamed("component", "part")
    members = clusters.join(joined, "id", "left").select("id", F.col("component").alias("cluster"), F.coalesce("part", "id").alias("part"))
    members = settle(members, "members", files)
    shares = members.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster")
    shares = shares.agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")).filter("parts > 1")
    # Where the stars were all pairs of a cluster, each has been compared.
    tried = stars.join(clusters, "id").groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("tried"))
    main = shares.join(tried, "cluster", "left").filter("2 * coalesce(tried, 0) < n * (n - 1)")
    main = settle(main.select("cluster", "main"), "main-parts", files)
    asked = members.join(bounded(main), "cluster").select("cluster", "id", "part", (F.col("part") != F.col("main")).alias("minor"))
    asked = settle(asked.join(known, "id").join(held, "id"), "asked", files)
    rest = in_cells(_cells(asked, "cluster", files, cell), ["cluster", "g", "h"], _ask(similarity.linked, "content", similarity.likely), "a bigint, b bigint")
    return sure.unionByName(rest)
