"""Joins of time intervals inside a video.

Both sides are cut into time cells, so the join has an equality key
``(video_id, cell)`` and never pairs all rows of a video. A pair that shares
several cells is kept in the first shared one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.operators.ordered import block_of, first_n, running_before

CELL_SECONDS = 60.0


def overlapping(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    key: str = "video_id",
    cell_seconds: float = CELL_SECONDS,
) -> DataFrame:
    """Pairs of rows of the same ``key`` whose closed spans touch.

    Columns of the two sides must differ except for ``key``. Both sides are sorted and merged: Spark takes a side for as small as it is
    before its spans are cut into cells, and would broadcast all of its cells.
    """
    def celled(df, span, prefix):
        lo, hi = f"_{prefix}lo", f"_{prefix}hi"
        df = df.withColumn(lo, span[0].cast("double")).withColumn(hi, span[1].cast("double"))
        first, last = F.floor(F.col(lo) / cell_seconds), F.floor(F.col(hi) / cell_seconds)
        return df.filter(F.col(lo) <= F.col(hi)).withColumn("_cell", F.explode(F.sequence(first, last)))

    pairs = celled(left, left_span, "l").join(celled(right, right_span, "r").hint("merge"), [key, "_cell"])
    touch = (F.col("_llo") <= F.col("_rhi")) & (F.col("_rlo") <= F.col("_lhi"))
    first_shared = F.floor(F.greatest("_llo", "_rlo") / cell_seconds) == F.col("_cell")
    return pairs.filter(touch & first_shared).drop("_cell", "_llo", "_lhi", "_rlo", "_rhi")


def attach_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Prefix each segment with the speaker of its longest positive overlap.

    ``turns(video_id, turn_idx, start, end, speaker)``; the first turn wins ties, and
    segments without an overlap stay as they are. Adds ``speaker``.
    """
    spans = segments.select("video_id", "seg_idx", "start", "end")
    said = turns.select(
        "video_id", "turn_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker"
    )
    pairs = overlapping(
        spans, said, (F.col("start"), F.col("end")), (F.col("t_start"), F.col("t_end"))
    ).withColumn("_shared", F.least("end", "t_end") - F.greatest("start", "t_start"))
    best = (
        pairs.filter("_shared > 0")
        .groupBy("video_id", "seg_idx")
        .agg(F.min_by("speaker", F.struct(-F.col("_shared"), F.col("turn_idx"))).alias("speaker"))
    )
    named = segments.join(best, ["video_id", "seg_idx"], "left")
    tagged = F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text"))
    return named.withColumn("text", F.coalesce(tagged, F.col("text")))


def window_context(
    windows: DataFrame, segments: DataFrame, pad: float = 6.0, max_chars: int = 700
) -> DataFrame:
    """Add ``transcript_context``: the texts around each window, in order, cut to ``max_chars``.

    ``windows`` needs ``(video_id, win_idx, start, end)``. Every kept text adds at
    least one character and a space, so a window never needs more than
    ``max_chars`` segments; the ranking is limited before the shuffle.
    """
    spans = windows.select("video_id", "win_idx", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    said = segments.select(
        "video_id", "seg_idx", "start", "end", F.trim("text").alias("text")
    ).filter("text != ''")
    pairs = overlapping(
        spans, said, (F.col("w_start") - pad, F.col("w_end") + pad), (F.col("start"), F.col("end"))
    ).select("video_id", "win_idx", "seg_idx", "text")
    context = (
        first_n(pairs, ["video_id", "win_idx"], ["seg_idx"], max_chars)
        .groupBy("video_id", "win_idx")
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("_t"))
        .select(
            "video_id",
            "win_idx",
            F.substring(F.array_join(F.col("_t.text"), " "), 1, max_chars).alias("transcript_context"),
        )
    )
    return windows.join(context, ["video_id", "win_idx"], "left").withColumn(
        "transcript_context", F.coalesce("transcript_context", F.lit(""))
    )


def visuals_in_chunk(visuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Visuals whose start lies in a chunk, both ends closed (so in two chunks where they meet).

    ``visuals(video_id, visual_idx, start, …)``, ``chunks(video_id, chunk, start, end)``.
    """
    at = visuals.withColumnRenamed("start", "v_start")
    if "end" in visuals.columns:
        at = at.withColumnRenamed("end", "v_end")
    spans = chunks.select("video_id", "chunk", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
    return overlapping(
        at, spans, (F.col("v_start"), F.col("v_start")), (F.col("chunk_start"), F.col("chunk_end"))
    )


def plan_cuts(media: DataFrame, silences: DataFrame) -> DataFrame:
    """Cut times that split each medium into ``n_chunks``, moved to the nearest silence.

    ``media(video_id, duration, n_chunks)``, ``silences(video_id, start, end)``. A cut
    moves at most half a chunk; without a silence there it stays and ``warning`` is
    true. A silence meets only the cuts it lies next to, so no silence is paired
    with all cuts.
    """
    sized = media.filter("n_chunks > 1").withColumn("_seg", F.col("duration") / F.col("n_chunks"))
    cuts = sized.withColumn("cut_idx", F.explode(F.sequence(F.lit(1), F.col("n_chunks") - 1))).select(
        "video_id", F.col("cut_idx").cast("long").alias("cut_idx"), (F.col("cut_idx") * F.col("_seg")).alias("ideal")
    )
    near = silences.select("video_id", F.col("start").alias("s"), F.col("end").alias("e")).join(sized, "video_id")
    first = F.greatest(F.floor(F.col("s") / F.col("_seg") - 0.5) - 1, F.lit(1))
    last = F.least(F.floor(F.col("e") / F.col("_seg") + 0.5) + 1, F.col("n_chunks") - 1)
    near = near.filter(first <= last).withColumn("cut_idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    ideal, reach = F.col("cut_idx") * F.col("_seg"), F.col("_seg") * 0.5
    near = near.filter((F.col("e") >= ideal - reach) & (F.col("s") <= ideal + reach))
    point = F.least(F.greatest(ideal, F.col("s")), F.col("e"))
    snapped = (
        near.select("video_id", "cut_idx", "s", "e", point.alias("_p"), F.abs(point - ideal).alias("_d"))
        .groupBy("video_id", "cut_idx")
        .agg(F.min_by("_p", F.struct("_d", "s", "e")).alias("snapped"))
    )
    return cuts.join(snapped, ["video_id", "cut_idx"], "left").select(
        "video_id",
        "cut_idx",
        "ideal",
        F.coalesce("snapped", "ideal").alias("cut"),
        F.col("snapped").isNull().alias("warning"),
    )


def frame_changes(frames: DataFrame, threshold: int = 20) -> DataFrame:
    """Frames that differ from the frame before by ``threshold`` bits or more.

    ``frames(video_id, frame_idx, ts, hash)``, hash as a 64-bit number.
    """
    ordered = running_before(
        frames, ["video_id"], ["frame_idx"], block_of("frame_idx"),
        {"_prev": ("last", F.struct("ts", "hash"))},
    )
    distance = F.bit_count(F.col("hash").bitwiseXOR(F.col("_prev.hash")))
    return (
        ordered.withColumn("distance", distance)
        .filter(F.col("distance") >= threshold)
        .select("video_id", "frame_idx", F.col("_prev.ts").alias("prev_ts"), "ts", "distance")
    )


def refine_by_frame_diff(
    windows: DataFrame,
    frames: DataFrame,
    change_threshold: int = 20,
    min_changes: int = 1,
    rich_changes: int = 5,
    rich_boost: float = 1.3,
) -> DataFrame:
    """Drop weak windows without a visual change and raise the score of busy ones.

    Windows found by exact phrases (reason ``raw`` or ``strict:…``) pass untouched.
    """
    strong = F.col("reason").rlike("^(raw|strict:)")
    changes = frame_changes(frames, change_threshold).select("video_id", "prev_ts", F.col("ts").alias("change_ts"))
    weak_spans = windows.filter(~strong).select(
        "video_id", "win_idx", F.col("start").alias("w_start"), F.col("end").alias("w_end")
    )
    inside = overlapping(
        weak_spans, changes, (F.col("w_start"), F.col("w_end")), (F.col("change_ts"), F.col("change_ts"))
    ).filter("prev_ts >= w_start")
    counts = inside.groupBy("video_id", "win_idx").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    boosted = F.least(F.col("score") * rich_boost, F.lit(1.0))
    return (
        windows.join(counts, ["video_id", "win_idx"], "left")
        .filter(strong | (n >= min_changes))
        .withColumn("score", F.when(~strong & (n >= rich_changes), boosted).otherwise(F.col("score")))
        .select(*windows.columns)
    )


def speech_bounds(media: DataFrame, silences: DataFrame) -> DataFrame:
    """Where speech starts and ends.

    The first silence counts if it starts within 0.5 s of the beginning and lasts
    1.5 s; the last likewise at the end.
    """
    edges = silences.groupBy("video_id").agg(
        F.min_by(F.struct("start", "end"), F.struct("start", "end")).alias("_first"),
        F.max_by(F.struct("start", "end"), F.struct("start", "end")).alias("_last"),
    )
    lead = (F.col("_first.start") <= 0.5) & (F.col("_first.end") - F.col("_first.start") >= 1.5)
    trail = (F.col("duration") - F.col("_last.end") <= 0.5) & (F.col("_last.end") - F.col("_last.start") >= 1.5)
    return media.join(edges, "video_id", "left").select(
        "video_id",
        F.when(lead, F.col("_first.end")).otherwise(F.lit(0.0)).alias("speech_start"),
        F.when(trail, F.col("_last.start")).otherwise(F.col("duration")).alias("speech_end"),
    )


def reassemble(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of audio pieces on the clock of the whole: plus piece offset plus trimmed lead.

    ``chunks(video_id, chunk, offset, leading_trim)``.
    """
    shift = F.col("offset") + F.coalesce(F.col("leading_trim"), F.lit(0.0))
    return (
        chunk_segments.join(chunks.select("video_id", "chunk", "offset", "leading_trim"), ["video_id", "chunk"])
        .withColumn("start", F.col("start") + shift)
        .withColumn("end", F.col("end") + shift)
        .withColumn("text", F.trim("text"))
        .drop("offset", "leading_trim")
    )
