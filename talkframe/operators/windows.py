"""Detection windows: build, merge and choose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.operators.ordered import block_of, first_by, running_before
from talkframe.operators.tables import settled

BEST = ["reason", "score", "weight", "phrase"]


def detection_windows(hits: DataFrame, scenes: DataFrame | None = None, method: str = "hybrid") -> DataFrame:
    """Windows around trigger hits (±1.5 s) and, for ``hybrid``, scene changes (−0.5/+1.5 s).

    ``hits(video_id, seg_idx, start, end, reason, score, weight, phrase)``,
    ``scenes(video_id, ts)``. ``win_idx`` keeps hits before scenes, each in order.
    """
    found = hits.select(
        "video_id",
        F.col("seg_idx").cast("long").alias("win_idx"),
        F.greatest(F.col("start") - 1.5, F.lit(0.0)).alias("start"),
        (F.col("end") + 1.5).alias("end"),
        *BEST,
    )
    if method != "hybrid" or scenes is None:
        return found
    cut = scenes.select(
        "video_id",
        # After every segment position; scenes sort by time in milliseconds.
        (F.lit(1 << 40) + F.rint(F.col("ts") * 1000).cast("long")).alias("win_idx"),
        F.greatest(F.col("ts") - 0.5, F.lit(0.0)).alias("start"),
        (F.col("ts") + 1.5).alias("end"),
        F.lit("scene_change").alias("reason"),
        F.lit(0.5).alias("score"),
        F.lit(1.0).alias("weight"),
        F.lit("").alias("phrase"),
    )
    return found.unionByName(cut)


def merge_windows(windows: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """Merge windows that overlap or lie at most ``max_gap`` apart.

    Each result keeps reason, score, weight and phrase of its window with the
    highest score × weight, the earliest on ties; ``win_idx`` is that of its first
    window.

    Windows that start within half a gap of each other always merge, so they are
    combined first, before the shuffle. What is left per video is bounded by its
    length in seconds, however many windows it has; the running end then goes
    over blocks of that, see :func:`talkframe.operators.ordered.running_before`.
    """
    priority = F.col("score") * F.col("weight")
    rank = F.struct(-priority, F.col("start"), F.col("win_idx"))
    cell = F.floor(F.col("start") / (max_gap / 2)) if max_gap > 0 else F.col("start")
    # A window that ends before it starts may not merge with its neighbours.
    alone = F.when(F.col("end") < F.col("start"), F.col("win_idx"))
    cells = settled(
        windows.withColumns({"_cell": cell, "_alone": alone, "_rank": rank})
        .groupBy("video_id", "_cell", "_alone")
        .agg(
            F.min(F.struct("start", "win_idx")).alias("_first"),
            F.max("end").alias("end"),
            F.min_by(F.struct(*BEST), "_rank").alias("_best"),
            F.min("_rank").alias("_rank"),
        )
    )
    order, block = ["_first"], block_of("_cell")
    reached = running_before(cells, ["video_id"], order, block, {"_reach": ("max", F.col("end"))}, keep_block=True)
    opens = F.col("_reach").isNull() | (F.col("_first.start") > F.col("_reach") + max_gap)
    marked = reached.withColumn("_open", F.when(opens, F.col("_first")))
    grouped = running_before(marked, ["video_id"], order, None, {"_prev": ("max", F.col("_open"))})
    island = F.coalesce("_open", "_prev")
    return (
        grouped.withColumn("_island", island)
        .groupBy("video_id", "_island")
        .agg(F.max("end").alias("end"), F.min_by("_best", "_rank").alias("_best"))
        .select("video_id", F.col("_island.win_idx").alias("win_idx"), F.col("_island.start").alias("start"), "end", "_best.*")
    )


def select_by_budget(windows: DataFrame, durations: DataFrame, max_windows: int) -> DataFrame:
    """At most ``max_windows`` windows a video: all if they fit, else the best of equal time buckets.

    ``durations(video_id, duration)``; videos of no known positive length give nothing.
    The best window of a bucket is combined before the shuffle, so a video of any
    size is cheap.
    """
    if max_windows <= 0:
        return windows.limit(0)
    counts = windows.groupBy("video_id").agg(F.count("*").alias("_n"))
    known = durations.filter("duration > 0").select("video_id", "duration")
    sized = windows.join(counts.join(known, "video_id"), "video_id")
    bucket = F.least(F.floor(F.col("start") / (F.col("duration") / max_windows)), F.lit(max_windows - 1))
    # Where all fit, every window is a bucket of its own.
    fits = F.col("_n") <= max_windows
    slots = sized.withColumns({
        "_bucket": F.when(~fits, bucket), "_own": F.when(fits, F.col("win_idx"))
    }).drop("_n", "duration")
    best = first_by(slots, ["video_id", "_bucket", "_own"], [-(F.col("score") * F.col("weight")), F.col("win_idx")])
    return best.select(*windows.columns)
