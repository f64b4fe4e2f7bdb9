"""Greedy packing of ordered rows into chunks, and prefix cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions.columns import format_clock
from talkframe.operators.ordered import block_of, first_by, first_n, running_before
from talkframe.operators.tables import settled

#: Rows of a key that are cut together.
FOLD_ROWS = 20_000


def token_estimate(text) -> Column:
    """About four characters a token, one at least."""
    t = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(t, F.lit(""))) / 4)).cast("long")


def greedy_chunks(
    df: DataFrame,
    index: str,
    size: str,
    budget: int,
    min_items: int = 1,
    keys: list[str] | None = None,
    block_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Add ``chunk``: rows in order, a new chunk when the next row would exceed ``budget``.

    A chunk takes at least ``min_items`` rows while rows remain. ``size`` is a whole
    number of 0 or more. Where chunk n+1 starts depends on where chunk n ended. Keys are cut into blocks of ``block_rows`` by
    ``index``, and each block is cut alone once it is known how full the chunk is that enters it. For that, every block
    states what it does to any chunk; statements of neighbours combine to one of the same kind, so that a block has the
    statement of all blocks before it after as many joins as their number has binary digits.
    """
    keys = keys or ["video_id"]
    names = df.columns
    order = F.col(index).cast("long")
    rows = df.withColumns({"_key": F.to_json(F.struct(*keys)), "_blk": block_of(index, block_rows), "_i": order, "_n": F.col(size).cast("long")})
    dealt = rows.repartition("_key", "_blk")

    # Blocks of keys that have several, numbered; both uses of the rows share one exchange.
    same = F.max(F.xxhash64(*rows.columns)).alias("_same")
    key = W.partitionBy("_key")
    blocks = dealt.groupBy("_key", "_blk").agg(same).filter("_same is not null").select(
        "_key", "_blk", (F.row_number().over(key.orderBy("_blk")) - 1).alias("_nth"), F.count("*").over(key).alias("_blocks")
    )
    several = blocks.filter("_blocks > 1").select("_key", "_blk", "_nth", "_blocks")
    alike = F.xxhash64(*rows.columns) >= F.lit(-(1 << 63))
    stated = dealt.filter(alike).join(several.select("_key", "_blk", "_nth"), ["_key", "_blk"]).select("_key", "_blk", "_nth", "_i", "_n")
    states = stated.sortWithinPartitions("_key", "_blk", "_i").mapInArrow(_summaries(budget, min_items), _STATE)
    longest = several.agg(F.coalesce(F.max("_blocks"), F.lit(1)).alias("n")).first()["n"]
    step = 1
    while step < longest:
        states = settled(states)
        before = states.select("_key", (F.col("_nth") + step).alias("_nth"), *[F.col(c).alias(f"b_{c}") for c in _PARTS])
        states = states.join(before, ["_key", "_nth"], "left").mapInArrow(_combined(budget, min_items), _STATE)
        step *= 2
    left = F.struct(*[F.col(c) for c in _PARTS])
    entered = states.select("_key", (F.col("_nth") + 1).alias("_nth"), left.alias("_state")).join(several, ["_key", "_nth"])
    # From an empty chunk the first row of all opens chunk 0.
    entry = entered.select(
        "_key", "_blk", F.get("_state.items", F.lit(0)).alias("_have"), F.get("_state.sums", F.lit(0)).alias("_held"), F.get("_state.cuts", F.lit(0)).alias("_chunk")
    )
    opened = dealt.join(entry, ["_key", "_blk"], "left").sortWithinPartitions("_key", "_blk", "_i")
    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])
    return opened.mapInArrow(_cut(budget, min_items, names), schema)


_PARTS = ["rows", "total", "prefix", "cuts", "items", "sums"]
_STATE = "_key string, _nth long, rows long, total long, prefix array<long>, cuts array<long>, items array<long>, sums array<long>"


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole blocks in sorted rows, and where each block ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        same = pc.and_(*[pc.equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)) for c in ("_key", "_blk")])
        ends = (np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist() if table.num_rows > 1 else []
        if ends:
            yield table.slice(0, ends[-1]), ends
        held = table.slice(ends[-1] if ends else 0)
    if held is not None:
        yield held, [held.num_rows]


def _next_starts(sizes: np.ndarray, budget: int, min_items: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row as a chunk start: the next start (or the row count), with prefix sums."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    # First row whose inclusion exceeds the budget, but no sooner than min_items.
    first_over = np.searchsorted(prefix, prefix[:-1] + budget, side="right") - 1
    return np.minimum(np.maximum(first_over, at + min_items), len(sizes)), prefix


def _first_cut(prefix: np.ndarray, rows: int, have: np.ndarray, held: np.ndarray, budget: int, min_items: int) -> np.ndarray:
    """Where a block with these inclusive sums first cuts a chunk that enters with ``have`` rows and a sum ``held``."""
    over = np.searchsorted(prefix, budget - held, side="right")
    return np.minimum(np.maximum(over, np.maximum(min_items - have, 0)), rows)


def _reach(prefix: np.ndarray, rows: int, budget: int, min_items: int) -> int:
    """Rows that can be a first cut: those within the budget from the start, and one more."""
    return min(rows, max(int(np.searchsorted(prefix, budget, side="right")) + 1, min_items + 1))


def _summaries(budget: int, min_items: int):
    """What a block does to a chunk that enters it: for every row that may cut it first, cuts after that and the chunk that leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _whole_groups(batches):
            out = []
            for begin, end in zip([0, *ends[:-1]], ends):
                sizes = table["_n"].slice(begin, end - begin).to_numpy()
                starts, prefix = _next_starts(sizes, budget, min_items)
                n = len(sizes)
                cuts, items, sums = [0] * n, [0] * n, [0] * n
                whole = prefix.tolist()
                for i, j in zip(range(n - 1, -1, -1), starts[::-1].tolist()):
                    if j < n:
                        cuts[i], items[i], sums[i] = cuts[j] + 1, items[j], sums[j]
                    else:
                        items[i], sums[i] = n - i, whole[n] - whole[i]
                reach = _reach(prefix[1:], n, budget, min_items)
                out.append((table["_key"][begin].as_py(), table["_nth"][begin].as_py(), n, whole[n], whole[1:reach + 1], cuts[:reach], items[:reach], sums[:reach]))
            yield _state_batch(out)

    return run


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["_key", "_nth", *_PARTS])


def _combined(budget: int, min_items: int):
    """The statement of some blocks (``b_…``) and the blocks after them, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows, total = row["rows"], row["total"]
                prefix, cuts, items, sums = (np.array(row[c], np.int64) for c in _PARTS[2:])
                if row["b_rows"] is not None:
                    before = row["b_rows"]
                    first, done, have, held = (np.array(row[f"b_{c}"], np.int64) for c in _PARTS[2:])
                    at = _first_cut(prefix, rows, have, held, budget, min_items)
                    cut = np.minimum(at, len(cuts) - 1)
                    passes = at >= rows
                    # Rows of the second part may be first cuts where the first may let a chunk through.
                    more = len(first) == before
                    cuts, items, sums = (
                        np.concatenate([np.where(passes, a, b), c]) if more else np.where(passes, a, b)
                        for a, b, c in ((done, done + 1 + cuts[cut], cuts), (have + rows, items[cut], items), (held + total, sums[cut], sums))
                    )
                    prefix = np.concatenate([first, row["b_total"] + prefix]) if more else first
                    rows, total = rows + before, total + row["b_total"]
                    reach = _reach(prefix, rows, budget, min_items)
                    prefix, cuts, items, sums = prefix[:reach], cuts[:reach], items[:reach], sums[:reach]
                out.append((row["_key"], row["_nth"], rows, total, prefix.tolist(), cuts.tolist(), items.tolist(), sums.tolist()))
            if out:
                yield _state_batch(out)

    return run


def _cut(budget: int, min_items: int, names: list[str]):
    """Numbers the chunks of whole blocks, given the chunk that enters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _whole_groups(batches):
            sizes = table["_n"].to_numpy()
            chunks = np.empty(len(sizes), np.int64)
            for begin, end in zip([0, *ends[:-1]], ends):
                starts, prefix = _next_starts(sizes[begin:end], budget, min_items)
                have, held, chunk = (table[c][begin].as_py() for c in ("_have", "_held", "_chunk"))
                n, at = end - begin, 0
                if have is not None:
                    at = int(_first_cut(prefix[1:], n, np.int64(have), np.int64(held), budget, min_items))
                    chunks[begin:begin + at] = chunk
                    chunk += 1
                else:
                    chunk = 0
                while at < n:
                    chunks[begin + at:begin + starts[at]] = chunk
                    at, chunk = int(starts[at]), chunk + 1
            yield from table.select(names).append_column("chunk", pa.array(chunks)).combine_chunks().to_batches()

    return run


def chunk_by_tokens(segments: DataFrame, target: int = 8000, block_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``chunk``: segments in order, about ``target`` tokens each."""
    sized = segments.withColumn("tokens", token_estimate("text"))
    return greedy_chunks(sized, "seg_idx", "tokens", target, 1, ["video_id"], block_rows)


def pack_summaries(items: DataFrame, budget: int, keys: list[str] | None = None, block_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``chunk``: ``items(keys, item_idx, header, summary)`` in groups of two or more that fit the budget."""
    sized = items.withColumn("_size", F.length("header") + F.length("summary"))
    return greedy_chunks(sized, "item_idx", "_size", budget, 2, keys or ["analysis_id"], block_rows).drop("_size")


def cap_transcript(segments: DataFrame, max_chars: int = 60_000) -> DataFrame:
    """``[HH:MM:SS] text`` lines until the next would exceed ``max_chars``, then a marker line.

    Returns ``(video_id, seg_idx, line)`` rows, the marker at the place of the first
    line left out. Running length and first overflow are both kept per block.
    """
    line = F.concat(F.lit("["), format_clock("start"), F.lit("] "), F.trim("text"))
    lines = segments.select("video_id", "seg_idx", line.alias("line"))
    running = running_before(
        lines, ["video_id"], ["seg_idx"], block_of("seg_idx"), {"_total": ("sum", F.length("line") + 1)}
    )
    over = F.col("_total") + F.length("line") > max_chars
    stop = running.filter(over).groupBy("video_id").agg(F.min("seg_idx").alias("_stop"))
    kept = running.join(stop, "video_id", "left").filter(
        F.col("_stop").isNull() | (F.col("seg_idx") <= F.col("_stop"))
    )
    marker = F.col("seg_idx") == F.col("_stop")
    return kept.select(
        "video_id", "seg_idx",
        F.when(F.coalesce(marker, F.lit(False)), F.lit("[...truncated...]")).otherwise(F.col("line")).alias("line"),
    )


def image_budget(section_images: DataFrame, max_images: int = 50) -> DataFrame:
    """The first ``max_images`` images a report can resolve, in section order.

    ``section_images(report_id, section_idx, image_idx, ref, resolvable)``.
    """
    order = ["section_idx", "image_idx"]
    return first_n(section_images.filter("resolvable"), ["report_id"], order, max_images)


# --- frames ------------------------------------------------------------------

def dedup_frames(frames: DataFrame, max_distance: int = 5) -> DataFrame:
    """Drop a frame within ``max_distance`` bits of a frame kept before it in its window.

    ``frames(video_id, win_idx, frame_idx, hash)``; frames without a hash stay. Copies
    of one hash are reduced to the first before anything is compared: a later copy is
    dropped with the first or because of it. The first frame of a window always stays, and takes those near it along. Of the
    others, near pairs share one of ``max_distance + 1`` bands of bits, so only frames with a band in common are compared; then
    rounds keep every frame that no earlier one still in question is near to, and drop those near a kept one. There are as many rounds
    as kept frames follow each other in a chain of near ones; windows are rows of a table throughout. The rounds run while the plan is built.
    """
    keys = ["video_id", "win_idx"]
    frame = F.col("frame_idx").cast("long").alias("frame_idx")
    hashed = frames.filter("hash is not null").select(*keys, frame, F.col("hash").cast("long").alias("hash"))
    firsts = settled(hashed.groupBy(*keys, "hash").agg(F.min("frame_idx").alias("frame_idx")))
    lead = firsts.groupBy(*keys).agg(F.min_by(F.struct("frame_idx", "hash"), "frame_idx").alias("_l"))
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("_l.hash"))) > max_distance
    rest = settled(firsts.join(lead, keys).filter(apart).select(*keys, "frame_idx", "hash"))
    kept = lead.select(*keys, F.col("_l.frame_idx").alias("frame_idx"))

    # Near pairs, the earlier frame first.
    bands, at = min(max_distance + 1, 64), 0
    values = []
    for i in range(bands):
        width = 64 // bands + (i < 64 % bands)
        part = F.shiftrightunsigned("hash", at)
        values.append(F.struct(F.lit(i).alias("band"), (part if width == 64 else part.bitwiseAND((1 << width) - 1)).alias("bits")))
        at += width
    banded = rest.select(*keys, "frame_idx", "hash", F.inline(F.array(*values)))
    later = banded.select(*keys, "band", "bits", F.col("frame_idx").alias("late"), F.col("hash").alias("late_hash"))
    near = F.bit_count(F.col("hash").bitwiseXOR(F.col("late_hash"))) <= max_distance
    met = banded.join(later, [*keys, "band", "bits"]).filter((F.col("frame_idx") < F.col("late")) & near)
    pairs = settled(met.select(*keys, F.col("frame_idx").alias("early"), "late").distinct())

    early, late = F.col("early").alias("frame_idx"), F.col("late").alias("frame_idx")
    dropped = rest.limit(0).select(*keys, "frame_idx")
    while not pairs.isEmpty():
        sure = pairs.select(*keys, early).join(pairs.select(*keys, late), [*keys, "frame_idx"], "left_anti").distinct()
        hit = settled(pairs.join(sure.withColumnRenamed("frame_idx", "early"), [*keys, "early"], "left_semi").select(*keys, late).distinct())
        dropped = dropped.unionByName(hit)
        gone = sure.unionByName(hit)
        pairs = pairs.join(gone.withColumnRenamed("frame_idx", "early"), [*keys, "early"], "left_anti")
        pairs = settled(pairs.join(hit.withColumnRenamed("frame_idx", "late"), [*keys, "late"], "left_anti"))
    kept = kept.unionByName(rest.select(*keys, "frame_idx").join(dropped, [*keys, "frame_idx"], "left_anti"))
    stays = frames.filter("hash is not null").join(kept, [*keys, "frame_idx"], "left_semi")
    return stays.unionByName(frames.filter("hash is null"))


def rank_candidate_frames(features: DataFrame) -> DataFrame:
    """Best frame of each moment by slide likeness, stillness, face and sharpness.

    ``features(video_id, moment, cand_idx, slide, face, sharpness, diff_next)``: ``slide``
    null for unreadable frames, ``face`` 0/1, ``diff_next`` the mean change to the next
    candidate in 0–1 (null where either is unreadable). The first wins ties.
    """
    keys = ["video_id", "moment"]
    sharpest = features.groupBy(*keys).agg(F.max("sharpness").alias("_top"))
    sharpest = sharpest.withColumn("_top", F.when(F.col("_top") == 0, F.lit(1.0)).otherwise(F.col("_top")))
    rows = running_before(
        features, keys, ["cand_idx"], block_of("cand_idx"), {"_before": ("last", F.struct("diff_next"))}
    ).withColumn("_before", F.col("_before.diff_next")).join(sharpest, keys)
    beside = F.array_compact(F.array("_before", "diff_next"))
    change = F.when(F.size(beside) > 0, F.aggregate(beside, F.lit(0.0), lambda a, x: a + x) / F.size(beside))
    stillness = 1 - F.coalesce(change, F.lit(0.0))
    score = F.when(F.col("slide").isNull(), F.lit(-1e9)).otherwise(
        F.col("slide") + 0.5 * stillness - F.col("face") + 0.15 * (F.col("sharpness") / F.col("_top"))
    )
    scored = rows.withColumn("rank_score", score).drop("_before", "_top")
    return first_by(scored, keys, [-F.col("rank_score"), F.col("cand_idx")])


def expand_frame_times(events: DataFrame, offsets: tuple[float, ...] = (-1.5, 0.3, 2.0)) -> DataFrame:
    """Frame times around each moment, not before 0, once per millisecond.

    ``events(video_id, event_ts)``.
    """
    at = F.explode(F.array(*[F.lit(float(o)) for o in offsets]))
    times = events.select("video_id", (F.rint(F.col("event_ts") * 1000) / 1000).alias("event_ts")).distinct()
    return (
        times.withColumn("_o", at)
        .select("video_id", (F.rint(F.greatest(F.col("event_ts") + F.col("_o"), F.lit(0.0)) * 1000) / 1000).alias("frame_ts"))
        .distinct()
    )
