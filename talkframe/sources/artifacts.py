"""Transcripts as text artifacts, and the writers that put them into files.

Documents of any size are rows of pieces with exact places, see :func:`talkframe.operators.ordered.placed_pieces`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions.columns import format_timestamp, strip
from talkframe.operators.ordered import block_of, enclosed_pieces, numbered, placed_pieces, running_before

PAUSE_SECONDS = 2.0
PARAGRAPH_SEGMENTS = 5


#: Bytes after which a written part ends, but for its last piece.
PART_BYTES = 64 << 20


def to_srt(segments: DataFrame) -> DataFrame:
    """``(video_id, position, offset, piece)``: blocks numbered from 1 over the whole video, a piece each."""
    placed = numbered(segments.select("video_id", "seg_idx", "start", "end", "text"), ["video_id"], "seg_idx", "_pos")
    block = F.concat(
        (F.col("_pos") + 1).cast("string"), F.lit("\n"), format_timestamp("start", ","), F.lit(" --> "),
        format_timestamp("end", ","), F.lit("\n"), strip("text"), F.lit("\n"),
    )
    return placed_pieces(placed, ["video_id"], ["_pos"], block_of("_pos"), block, "\n")


def to_timestamped_txt(segments: DataFrame) -> DataFrame:
    """``(video_id, position, offset, piece)``: one ``[start --> end] text`` line per segment."""
    line = F.concat(F.lit("["), format_timestamp("start"), F.lit(" --> "), format_timestamp("end"), F.lit("] "), strip("text"))
    return placed_pieces(segments, ["video_id"], ["seg_idx"], block_of("seg_idx"), line, "\n")


def paragraph_rows(segments: DataFrame) -> DataFrame:
    """Add ``para``, the position of a segment's paragraph's first segment.

    A paragraph ends at a pause of 2 s and after five segments.
    """
    order, block = ["seg_idx"], block_of("seg_idx")
    first = running_before(
        segments, ["video_id"], order, block,
        {"_end": ("last", F.col("end")), "_pos": ("sum", F.lit(1))}, keep_block=True,
    )
    pause = F.col("_end").isNull() | (F.col("start") - F.col("_end") >= PAUSE_SECONDS)
    marked = first.withColumn("_open", F.when(pause, F.col("_pos").cast("long")))
    runs = running_before(marked, ["video_id"], order, None, {"_prev": ("max", F.col("_open"))})
    run = F.coalesce("_open", "_prev")
    para = run + F.floor((F.col("_pos") - run) / PARAGRAPH_SEGMENTS) * PARAGRAPH_SEGMENTS
    return runs.withColumn("para", para).drop("_end", "_pos", "_open", "_prev")


def to_paragraphs(segments: DataFrame) -> DataFrame:
    """``(video_id, position, offset, piece)``: texts joined to paragraphs, a piece each, blank lines between."""
    rows = paragraph_rows(segments.select("video_id", "seg_idx", "start", "end", "text"))
    paragraphs = (
        rows.groupBy("video_id", "para")
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", strip("text").alias("t")))).alias("_t"))
        .select("video_id", "para", F.array_join(F.col("_t.t"), " ").alias("_text"))
    )
    return placed_pieces(paragraphs, ["video_id"], ["para"], block_of("para"), F.col("_text"), "\n\n")


def to_transcript_json(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """``(video_id, position, offset, piece)``: the video's facts and its segments as one JSON document a video.

    ``videos(video_id, language, backend, duration_sec)`` and, optionally, ``quality``
    and ``visual_segments``. The first piece holds the facts, the last closes the document, and each segment between
    is a piece. Segments of unknown videos are left out; a video without segments has an empty list.
    """
    keep = {"ignoreNullFields": "false"}
    facts = F.to_json(F.struct("language", "backend", "duration_sec"), keep)
    extra = [c for c in ("quality", "visual_segments") if c in videos.columns]
    closing = F.concat(F.lit("\n]"), *([F.lit(","), F.substring(F.to_json(F.struct(*extra), keep), 2, 1 << 30)] if extra else [F.lit("}")]))
    ends = videos.select("video_id", F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"segments":[')).alias("_head"), closing.alias("_end"))
    item = F.to_json(F.struct("start", "end", "text"), keep)
    known = segments.join(videos.select("video_id"), "video_id", "left_semi")
    return enclosed_pieces(ends, known.select("video_id", F.col("seg_idx").alias("_i"), item.alias("_piece")), "video_id", "\n,")


def video_totals(segments: DataFrame) -> DataFrame:
    """``(video_id, position, offset, piece, duration)``: the texts joined by spaces; duration is the end of the last segment by position."""
    pieces = placed_pieces(segments, ["video_id"], ["seg_idx"], block_of("seg_idx"), F.col("text"), " ")
    last = segments.groupBy("video_id").agg(F.max_by("end", "seg_idx").alias("duration"))
    return pieces.join(last, "video_id")


def write_documents(pieces: DataFrame, path: str, key: str = "video_id", part_bytes: int = PART_BYTES, newline: str = "before") -> None:
    """Writes documents, given as pieces, as text: a folder a key, and in it parts in order.

    A part ends before the first piece at or beyond ``part_bytes`` after its beginning, so many tasks write a giant document and no file is longer
    than that and one piece. The parts of a key, one after another, are its document. Every piece but the first begins with a line feed
    (``newline="before"``; the document then ends with one more), or every piece ends with one (``"after"``).
    """
    if newline not in ("before", "after"):
        raise ValueError(f"unknown place of line feeds: {newline}")
    part = F.floor(F.col("offset") / part_bytes).cast("long")
    held = (
        pieces.select(F.col(key), part.alias("part"), F.struct("position", "piece").alias("_p"))
        .groupBy(key, "part").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        .select(key, "part", F.array_join(F.col("_p.piece"), "").alias("value"))
    )
    # The sink ends each part with a line feed.
    trimmed = F.when((F.col("part") > 0) & F.col("value").startswith("\n"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    if newline == "after":
        trimmed = F.regexp_replace("value", r"\n\z", "")
    held.withColumn("value", trimmed).repartitionByRange(key, "part").withColumn("part", F.format_string("%08d", "part")).write.mode("overwrite").partitionBy(key, "part").text(path)


def write_log(entries: DataFrame, path: str) -> bool:
    """Write log entries in order; nothing is written, and False returned, without entries."""
    if entries.select(F.lit(1)).limit(1).count() == 0:
        return False
    entries.repartitionByRange("batch", "index").sortWithinPartitions("batch", "index").select("entry").write.mode(
        "overwrite"
    ).text(path)
    return True
