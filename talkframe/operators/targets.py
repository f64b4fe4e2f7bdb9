"""Target lists: filters, unions that keep the first, selections."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions.columns import is_video_id
from talkframe.operators.ordered import first_by, first_n, numbered
from talkframe.operators.phrases import phrase_hits

SHORT_SECONDS = 60


@dataclass(frozen=True)
class DateWindow:
    """Inclusive days [start, end]."""

    start: date
    end: date

    def holds(self, column: str | Column) -> Column:
        day = F.to_date(F.col(column) if isinstance(column, str) else column)
        return day.between(F.lit(self.start), F.lit(self.end))


def date_window(
    days: int | None = None, since: date | None = None, until: date | None = None, today: date | None = None
) -> DateWindow | None:
    """Window of the last ``days``, or from ``since`` to ``until`` (today if left out); None without either."""
    today = today or date.today()
    if days is not None:
        if since is not None or until is not None:
            raise ValueError("days and since/until exclude each other")
        if days <= 0:
            raise ValueError("days must be positive")
        return DateWindow(today - timedelta(days=days), today)
    if since is None:
        if until is not None:
            raise ValueError("until needs since")
        return None
    end = until or today
    if since > end:
        raise ValueError("since must not be after until")
    return DateWindow(since, end)


def filter_targets(
    targets: DataFrame,
    since: date | None = None,
    until: date | None = None,
    min_duration: int | None = None,
    max_duration: int | None = None,
    include_shorts: bool = True,
) -> DataFrame:
    """Filter by ``upload_date`` and ``duration_sec``. Unknown values pass every test."""
    tests = []
    if since is not None:
        tests.append(("upload_date", F.col("upload_date") >= F.lit(since)))
    if until is not None:
        tests.append(("upload_date", F.col("upload_date") <= F.lit(until)))
    if min_duration is not None:
        tests.append(("duration_sec", F.col("duration_sec") >= min_duration))
    if max_duration is not None:
        tests.append(("duration_sec", F.col("duration_sec") <= max_duration))
    if not include_shorts:
        tests.append(("duration_sec", F.col("duration_sec") > SHORT_SECONDS))
    return reduce(lambda df, t: df.filter(F.col(t[0]).isNull() | t[1]), tests, targets)


def candidates_in_window(candidates: DataFrame, window: DateWindow | None) -> DataFrame:
    """Candidates of the window; those without a date are kept."""
    if window is None:
        return candidates
    return candidates.filter(F.col("upload_date").isNull() | window.holds("upload_date"))


def match_titles(candidates: DataFrame, pattern: str | None) -> DataFrame:
    """Titles that hold the pattern as written, case ignored; all for an empty pattern."""
    if not pattern:
        return candidates
    return candidates.filter(F.lower(F.coalesce("title", F.lit(""))).contains(pattern.lower()))


def valid_video_ids(listing: DataFrame) -> DataFrame:
    return listing.filter(is_video_id("video_id"))


def parse_selection(spec: str) -> list[tuple[int, int]]:
    """1-based inclusive ranges of ``"1,3,5-7"``; errors on 0, reverse ranges and anything else."""
    ranges = []
    for token in (t.strip() for t in spec.split(",")):
        if not token:
            continue
        first, dash, last = token.partition("-")
        if not first.strip().isdigit() or (dash and not last.strip().isdigit()):
            raise ValueError(f"bad selection: {token!r}")
        lo, hi = int(first), int(last) if dash else int(first)
        if lo < 1:
            raise ValueError(f"selections count from 1: {token!r}")
        if lo > hi:
            raise ValueError(f"reverse range: {token!r}")
        ranges.append((lo, hi))
    if not ranges:
        raise ValueError("empty selection")
    return ranges


def select_rows(df: DataFrame, spec: str, index: str, keys: list[str], check: bool = True) -> DataFrame:
    """Rows of each key at the selected 1-based positions by ``index``.

    With ``check``, a key with fewer rows than the selection asks for is an error.
    """
    ranges = parse_selection(spec)
    highest = max(hi for _, hi in ranges)
    # Rows beyond the last position asked for go before the shuffle.
    placed = numbered(first_n(df, keys, [index], highest), keys, index, "_pos")
    if check:
        short = df.groupBy(*keys).count().filter(F.col("count") < highest).select(*keys).first()
        if short is not None:
            raise ValueError(f"selection {spec!r} is out of range for {short.asDict()}")
    wanted = reduce(lambda a, b: a | b, [(F.col("_pos") + 1).between(lo, hi) for lo, hi in ranges])
    return placed.filter(wanted).drop("_pos")


def limit_per_source(entries: DataFrame, n: int, source: str = "source_key", position: str = "pos") -> DataFrame:
    """The first ``n`` entries of each source."""
    return first_n(entries, [source], [position], n)


def keep_first(entries: DataFrame, order: list[str], key: str = "video_id") -> DataFrame:
    """The first entry of each ``key``; entries without a key are all kept."""
    named = first_by(entries.filter(F.col(key).isNotNull()), [key], [F.col(c) for c in order])
    return named.unionByName(entries.filter(F.col(key).isNull()))


def resolve_targets(*sources: DataFrame) -> DataFrame:
    """Ordered union of target lists, the first entry of each video kept.

    Each list has ``pos`` and the target columns; ``source_rank`` records its place.
    """
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_first(union, ["source_rank", "pos"])


def merge_language_searches(results: DataFrame, languages: list[str], limit: int) -> DataFrame:
    """First hit of each video over the languages in query order, ``limit`` entries a language.

    ``results(lang, pos, video_id, …)``; entries without an id and other languages drop out.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    asked = results.filter(F.col("lang").isin(languages)).withColumn("_rank", place)
    limited = limit_per_source(asked, limit, "lang", "pos").filter("video_id is not null")
    return first_by(limited, ["video_id"], [F.col("_rank"), F.col("pos")]).drop("_rank")


def skip_existing(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets not transcribed yet; targets without an id are kept."""
    # Rows without an id match nothing and would all meet in one task of the join.
    named = targets.filter("video_id is not null").join(done.select("video_id").distinct(), "video_id", "left_anti")
    return named.select(*targets.columns).unionByName(targets.filter("video_id is null"))


def order_caption_tracks(tracks: DataFrame) -> DataFrame:
    """Caption language of each video: generated tracks first, then manual, in listing order.

    ``tracks(video_id, track_idx, lang, is_generated)``.
    """
    real = tracks.filter(F.coalesce("lang", F.lit("")) != "")
    order = [F.when(F.col("is_generated"), 0).otherwise(1), F.col("track_idx")]
    return first_by(real, ["video_id"], order)


def source_for_transcript(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Video of each transcript file of a batch, by its name.

    ``files(batch, stem)``, ``videos(batch, index, video_id, title, url)``. The first
    video whose id occurs in the name; else the first whose title does (spaces as
    ``_``). Files without a match keep a null url. A substring search by gram, so
    files and videos of a batch are never paired.
    """
    names = videos.select("batch", "index", "url", F.lit(0).alias("rule"), F.col("video_id").alias("needle")).unionByName(
        videos.select("batch", "index", "url", F.lit(1).alias("rule"), F.replace("title", F.lit(" "), F.lit("_")).alias("needle"))
    ).filter(F.coalesce("needle", F.lit("")) != "")
    # Videos of one title are one needle with the first of them, before anything is searched.
    names = first_by(names, ["batch", "rule", "needle"], [F.col("index")])
    hits = phrase_hits(
        files.select("batch", "stem").distinct(), names, ["stem"], ["rule", "index", "url"],
        text="stem", phrase="needle", scope=["batch"],
    )
    best = hits.groupBy("batch", "stem").agg(F.min_by("url", F.struct("rule", "index")).alias("url"))
    return files.join(best, ["batch", "stem"], "left")


def source_type(targets: DataFrame) -> DataFrame:
    """Kind of each batch by the sources of its targets: ``targets(batch, source, from_file)``."""
    kinds = F.sort_array(F.collect_set("source"))
    totals = targets.groupBy("batch").agg(kinds.alias("_k"), F.bool_or("from_file").alias("_file"))
    only = F.when(F.size("_k") == 1, F.get(F.col("_k"), F.lit(0)))
    return totals.select(
        "batch",
        F.when(F.col("_file") & (only == "file"), "file")
        .when(only.isin("channel", "playlist", "inline"), only)
        .otherwise("mixed")
        .alias("source_type"),
    )
