"""Transcript, caption, feed and list files as tables.

Readers take a path or glob of any number of files and give one row set for all.
``file`` names the source file; segments come with their position ``seg_idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions.columns import none_if_empty, strip
from talkframe.operators.ordered import block_of, running_before

SRT_TIME = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*$"
SRT_TIME_LENIENT = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
TXT_LINE = r"^\[(\d{2}):(\d{2}):(\d{2})\.(\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})\.(\d{3})\]\s*(.+)$"
SEGMENT = ["file", "seg_idx", "start", "end", "text"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(file, content)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")
    )


def _clock_parts(line, pattern: str) -> Column:
    """The eight numbers of a time range as an array."""
    span = F.regexp_replace(F.regexp_extract(line, pattern, 0), r"^\[|\].*$", "")
    return F.split(F.trim(span), r"\s*-->\s*|[:,.]")


def _seconds(parts: str, first: int) -> Column:
    """Seconds of the four numbers from ``first``. The last one counts thousandths, as written."""
    h, m, s, ms = (F.get(F.col(parts), F.lit(first + i)).cast("double") for i in range(4))
    return h * 3600 + m * 60 + s + ms / 1000.0


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def _numbered(rows: DataFrame, key: str = "file") -> DataFrame:
    """Close the gaps that dropped entries leave in ``_pos``."""
    ranked = running_before(rows, [key], ["_pos"], block_of("_pos"), {"seg_idx": ("sum", F.lit(1))})
    return ranked.withColumn("seg_idx", F.col("seg_idx").cast("int"))


def srt_segments(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Segments of SRT texts ``(file, content)``.

    Blocks are split at blank lines; the index line is optional. ``lenient`` takes
    one-digit hours and drops blocks without text.
    """
    blocks = files.select("file", F.posexplode(F.split(strip("content"), r"\r?\n(?:\r?\n)+")).alias("_pos", "_block"))
    lines = blocks.withColumn("_lines", _lines(strip("_block")))
    pattern = SRT_TIME_LENIENT if lenient else SRT_TIME
    if lenient:
        lines = lines.withColumn("_lines", F.filter("_lines", lambda x: F.trim(x) != ""))
    is_time = lambda x: x.rlike(pattern)
    time_lines = F.filter("_lines", is_time)
    if lenient:
        # The last time line counts; index lines before the first one are skipped.
        time_line = F.element_at(time_lines, -1)
        first_at = F.array_position(F.transform("_lines", is_time), True).cast("int")
        kept = F.filter(
            "_lines", lambda x, i: ~is_time(x) & ~((i < first_at - 1) & F.trim(x).rlike(r"(?U)^\d+$"))
        )
    else:
        time_line = F.get(time_lines, F.lit(0))
        first_at = F.array_position(F.transform("_lines", is_time), True).cast("int")
        kept = F.slice("_lines", first_at + 1, F.size("_lines"))
    timed = lines.filter(F.exists("_lines", is_time)).withColumns({"_time": _clock_parts(time_line, pattern), "_kept": kept})
    if lenient:
        timed = timed.filter(F.size("_kept") > 0)
    rows = timed.select(
        "file", "_pos",
        _seconds("_time", 0).alias("start"),
        _seconds("_time", 4).alias("end"),
        strip(F.array_join("_kept", " ")).alias("text"),
    )
    return _numbered(rows).select(*SEGMENT)


def read_srt(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    return srt_segments(read_files(spark, path), lenient)


def txt_segments(files: DataFrame) -> DataFrame:
    """Segments of ``[start --> end] text`` lines; a text without any is one segment at 0."""
    lined = files.withColumn("_timed", F.filter(_lines(F.col("content")), lambda x: x.rlike(TXT_LINE)))
    plain = F.size("_timed") == 0
    timed = lined.filter(~plain).select("file", F.posexplode("_timed").alias("seg_idx", "_l"))
    timed = timed.withColumn("_time", _clock_parts("_l", TXT_LINE)).select(
        "file", "seg_idx", _seconds("_time", 0).alias("start"), _seconds("_time", 4).alias("end"),
        strip(F.regexp_extract("_l", TXT_LINE, 9)).alias("text"),
    )
    whole = lined.filter(plain & (strip("content") != "")).select(
        "file", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), strip("content").alias("text")
    )
    return timed.unionByName(whole)


def read_timestamped_txt(spark: SparkSession, path: str) -> DataFrame:
    return txt_segments(read_files(spark, path))


TRANSCRIPT_JSON = (
    "language string, backend string, duration_sec double, "
    "segments array<struct<start: double, end: double, text: string>>"
)


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    return json_segments(read_files(spark, path))


def json_segments(files: DataFrame) -> DataFrame:
    """Segments (with ``language``) of JSON transcripts; items without text are left out, missing times are 0."""
    doc = F.from_json("content", TRANSCRIPT_JSON)
    items = F.filter(doc["segments"], lambda s: s["text"].isNotNull())
    return (
        files
        .select("file", doc["language"].alias("language"), F.posexplode(items).alias("seg_idx", "_s"))
        .select(
            "file", "language", "seg_idx",
            F.coalesce("_s.start", F.lit(0.0)).alias("start"), F.coalesce("_s.end", F.lit(0.0)).alias("end"), "_s.text",
        )
    )


CAPTION_JSON = "events array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string>>>>"


def caption_json_segments(files: DataFrame) -> DataFrame:
    """Segments of json3 captions: pieces of an event joined, blank events left out."""
    events = F.from_json("content", CAPTION_JSON)["events"]
    text = strip(F.array_join(F.transform(F.col("_e.segs"), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce(F.col("_e.tStartMs"), F.lit(0))
    rows = (
        files.select("file", F.posexplode(events).alias("_pos", "_e"))
        .select(
            "file", "_pos", (start / 1000.0).alias("start"),
            ((start + F.coalesce(F.col("_e.dDurationMs"), F.lit(0))) / 1000.0).alias("end"), text.alias("text"),
        )
        .filter("text != ''")
    )
    return _numbered(rows).select(*SEGMENT)


def read_caption_json3(spark: SparkSession, path: str) -> DataFrame:
    return caption_json_segments(read_files(spark, path))


SRV_LINE = r'(?s)<p\s+t="(\d+)"\s+d="(\d+)"[^>]*>(.*?)</p>'


def caption_srv_segments(files: DataFrame) -> DataFrame:
    """Segments of ``<p t= d=>`` captions: inner tags cut, blank lines left out."""
    def group(n):
        return F.regexp_extract_all("content", F.lit(SRV_LINE), F.lit(n))

    found = F.arrays_zip(group(1).alias("t"), group(2).alias("d"), group(3).alias("b"))
    start = F.col("_p.t").cast("bigint")
    rows = (
        files.select("file", F.posexplode(found).alias("_pos", "_p"))
        .select(
            "file", "_pos", (start / 1000.0).alias("start"), ((start + F.col("_p.d").cast("bigint")) / 1000.0).alias("end"),
            strip(F.regexp_replace("_p.b", "<[^>]+>", "")).alias("text"),
        )
        .filter("text != ''")
    )
    return _numbered(rows).select(*SEGMENT)


def read_caption_srv(spark: SparkSession, path: str) -> DataFrame:
    return caption_srv_segments(read_files(spark, path))


FEED_XML = (
    "entry array<struct<`yt:videoId`: string, `yt:channelId`: string, title: string, published: string>>"
)


def read_channel_feed(spark: SparkSession, path: str) -> DataFrame:
    return feed_entries(read_files(spark, path))


def feed_entries(files: DataFrame) -> DataFrame:
    """Entries of channel feeds: ``(video_id, url, title, channel_id, published)``.

    Entries without an id are left out; an unreadable date is the epoch. A malformed
    feed gives no rows.
    """
    feed = F.from_xml("content", FEED_XML)
    rows = files.select("file", F.posexplode(feed["entry"]).alias("pos", "_e"))
    video = none_if_empty(F.col("_e")["yt:videoId"])
    return rows.filter(video.isNotNull()).select(
        "file", "pos", video.alias("video_id"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("url"),
        F.coalesce(F.col("_e")["title"], F.lit("")).alias("title"),
        F.coalesce(F.col("_e")["yt:channelId"], F.lit("")).alias("channel_id"),
        F.coalesce(F.try_to_timestamp(F.col("_e")["published"]), F.timestamp_seconds(F.lit(0))).alias("published"),
    )


MANIFEST = (
    "batch_name string, videos array<struct<index: bigint, url: string, video_id: string, title: string, "
    "upload_date: string, duration_sec: bigint, channel: string, language_detected: string, status: string, "
    "files: struct<txt: string, json: string, srt: string>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_videos(read_files(spark, path))


def manifest_videos(files: DataFrame) -> DataFrame:
    """Transcribed videos of batch manifests and the transcript file of each.

    Prefers txt, then json, then srt. Rows whose path leaves the batch folder are left
    out.
    """
    videos = F.from_json("content", MANIFEST)["videos"]
    rows = files.select("file", F.posexplode(videos).alias("pos", "_v")).select("file", "pos", "_v.*")
    rel = F.coalesce(none_if_empty("files.txt"), none_if_empty("files.json"), none_if_empty("files.srt"))
    return (
        rows.filter("status = 'ok'")
        .withColumn("rel_path", rel)
        .filter(F.col("rel_path").isNotNull() & ~escapes_folder("rel_path"))
        .withColumn("transcript_path", F.concat(F.regexp_replace("file", "[^/]+$", ""), F.col("rel_path")))
        .drop("files")
    )


def escapes_folder(path: str) -> Column:
    """Does a relative path lead out of its folder at any point?"""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: ~p.isin("", "."))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(acc, p):
        depth = acc["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    return F.startswith(F.col(path), F.lit("/")) | (F.aggregate(parts, state, step, lambda a: a["low"]) < 0)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(read_files(spark, path))


def url_lines(files: DataFrame) -> DataFrame:
    """Urls of list files in order; blank lines, ``#`` lines and tails after `` #`` are cut."""
    rows = files.select("file", F.posexplode(_lines(F.col("content"))).alias("pos", "_l"))
    line = strip("_l")
    url = strip(F.substring_index(line, " #", 1))
    return rows.filter((line != "") & ~F.startswith(line, F.lit("#")) & (url != "")).select("file", "pos", url.alias("url"))


def segments_from_paragraphs(texts: DataFrame) -> DataFrame:
    """Paragraphs as segments with the time spread evenly; 60 s each where the length is unknown.

    ``texts(video_id, text, duration)``.
    """
    paragraphs = F.filter(F.transform(F.split(strip("text"), r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")
    rows = texts.select("video_id", "duration", paragraphs.alias("_ps"))
    known = F.coalesce(F.col("duration").cast("double"), F.lit(0.0))
    total = F.when(known == 0, F.size("_ps") * 60.0).otherwise(known)
    return (
        rows.withColumn("_step", total / F.size("_ps"))
        .select("video_id", "_step", F.posexplode("_ps").alias("seg_idx", "text"))
        .select(
            "video_id", "seg_idx", (F.col("seg_idx") * F.col("_step")).alias("start"),
            ((F.col("seg_idx") + 1) * F.col("_step")).alias("end"), "text",
        )
    )


def words_to_segments(word_rows: DataFrame, max_gap: float = 1.0, max_words: int = 15) -> DataFrame:
    """Segments of timed words: a new one after a pause, a sentence end, or ``max_words`` words.

    ``word_rows(video_id, word_idx, word, punctuated_word, start, end)``, ``word_idx``
    dense from 0.
    """
    begin = F.coalesce(F.col("start"), F.lit(0.0))
    shown = strip(F.coalesce(none_if_empty("punctuated_word"), "word", F.lit("")))
    timed = word_rows.select(
        "video_id", F.col("word_idx").cast("long").alias("word_idx"), shown.alias("_w"), begin.alias("_s"),
        F.coalesce(F.nullif("end", F.lit(0.0)), begin).alias("_e"),
    )
    ends = F.col("_w").rlike("[.!?…]$")
    order, block = ["word_idx"], block_of("word_idx")
    seen = running_before(timed, ["video_id"], order, block, {"_last": ("last", F.struct(F.col("_e").alias("e"), ends.alias("stop")))}, keep_block=True)
    opens = F.col("_last").isNull() | F.col("_last.stop") | (F.col("_s") - F.col("_last.e") > max_gap)
    marked = seen.withColumn("_open", F.when(opens, F.col("word_idx")))
    runs = running_before(marked, ["video_id"], order, None, {"_prev": ("max", F.col("_open"))})
    run = F.coalesce("_open", "_prev")
    # A segment that follows a full one starts where its word starts, or where the last ended.
    starts = F.when(F.col("_last").isNull() | (F.col("_s") != 0), F.col("_s")).otherwise(F.col("_last.e"))
    grouped = (
        runs.withColumns({"_run": run, "_start": starts})
        .withColumn("_nth", F.floor((F.col("word_idx") - F.col("_run")) / max_words))
        .groupBy("video_id", "_run", "_nth")
        .agg(
            F.min_by("_start", "word_idx").alias("start"), F.max_by("_e", "word_idx").alias("end"),
            F.array_sort(F.collect_list(F.struct("word_idx", "_w"))).alias("_ws"), F.min("word_idx").alias("_first"),
        )
    )
    return grouped.select(
        "video_id", F.col("_first").alias("seg_idx"), "start", "end", strip(F.array_join(F.col("_ws._w"), " ")).alias("text")
    )
