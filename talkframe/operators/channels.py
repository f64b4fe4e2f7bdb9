"""Followed channels: listings, windows, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.operators.ordered import first_by, first_n
from talkframe.operators.targets import DateWindow


class MissingCursorError(ValueError):
    """A first run without a date window would fetch everything."""


def filter_group(channels: DataFrame, group: str | None) -> DataFrame:
    """Channels of a group; None for all, ``ungrouped`` for those without one."""
    if group is None:
        return channels
    if group == "ungrouped":
        return channels.filter(F.col("group").isNull())
    return channels.filter(F.col("group") == group)


def list_groups(channels: DataFrame) -> DataFrame:
    return channels.select("group").filter("group is not null").distinct().orderBy("group")


def upsert_channels(channels: DataFrame, changes: DataFrame) -> DataFrame:
    """Add or update channels by id (else url); null fields of a change leave the old value.

    ``changes`` has one row a channel.
    """
    key = F.coalesce("channel_id", "url")
    fields = [c for c in channels.columns]
    old = channels.select(key.alias("_key"), F.struct(*fields).alias("_old"))
    new = changes.select(key.alias("_key"), F.struct(*[F.col(c) for c in fields]).alias("_new"))
    return old.join(new, "_key", "full_outer").select(
        *[F.coalesce(f"_new.{c}", f"_old.{c}").alias(c) for c in fields]
    )


def _addressed(identifiers: list[str]) -> Column:
    tests = [F.coalesce(F.col(c).cast("string").isin(identifiers), F.lit(False)) for c in ("handle", "url", "channel_id")]
    return tests[0] | tests[1] | tests[2]


def remove_channels(channels: DataFrame, identifiers: list[str]) -> DataFrame:
    """Channels without those named by handle, url or id."""
    return channels.filter(~_addressed(identifiers))


def set_mode(channels: DataFrame, identifiers: list[str], mode: str) -> DataFrame:
    """Set the content mode of channels named by handle, url or id."""
    if mode not in ("auto", "videos-only", "shorts-only", "shorts-and-videos"):
        raise ValueError(f"unknown mode: {mode}")
    return channels.withColumn("mode", F.when(_addressed(identifiers), F.lit(mode)).otherwise(F.col("mode")))


# --- listings ----------------------------------------------------------------

def _prefix(listing: DataFrame, stop: Column, keys: list[str]) -> DataFrame:
    """Rows of each key before its first row where ``stop`` holds, by ``pos``.

    The first such position is a small aggregate, so no window over a channel is needed.
    """
    ends = listing.filter(stop).groupBy(*keys).agg(F.min("pos").alias("_stop"))
    return (
        listing.join(ends, keys, "left")
        .filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
        .drop("_stop")
    )


def take_while_in_window(
    listing: DataFrame, in_window: Column, cap: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """Newest-first rows up to the first outside the window, at most ``cap`` (0 for no cap).

    ``listing(channel_id, pos, published, …)``; rows without a date are skipped and do
    not end the walk.
    """
    keys = keys or ["channel_id"]
    dated = listing.filter("published is not null").withColumn("_in", F.coalesce(in_window, F.lit(False)))
    walked = _prefix(dated, ~F.col("_in"), keys).drop("_in")
    if cap <= 0:
        return walked
    return first_n(walked, keys, ["pos"], cap)


def take_until_seen(listing: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows listed before the last seen video; all rows where it is no longer listed."""
    seen = channels.filter("last_seen_video_id is not null").select("channel_id", "last_seen_video_id")
    ends = (
        listing.join(seen, "channel_id")
        .filter("video_id = last_seen_video_id")
        .groupBy("channel_id")
        .agg(F.min("pos").alias("_stop"))
    )
    return (
        listing.join(ends, "channel_id", "left")
        .filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
        .drop("_stop")
    )


def synthetic_published(listing: DataFrame, now) -> DataFrame:
    """Give undated rows a falling time: ``now`` less one minute a position (from 0)."""
    stamp = F.date_trunc("second", F.lit(now).cast("timestamp")) - F.make_dt_interval(mins=F.col("pos").cast("int"))
    return listing.withColumn("published", F.coalesce("published", stamp))


def merge_shorts_and_videos(shorts: DataFrame, videos: DataFrame) -> DataFrame:
    """Both lists, each video once: the newest entry, the short on equal times."""
    both = shorts.withColumn("is_short", F.lit(True)).unionByName(videos.withColumn("is_short", F.lit(False)))
    newest = -F.unix_micros("published")
    return first_by(both, ["channel_id", "video_id"], [newest, F.when(F.col("is_short"), 0).otherwise(1), F.col("pos")])


def auto_fallback(videos: DataFrame, shorts: DataFrame, channels: DataFrame) -> DataFrame:
    """Entries of each channel by its mode: videos, shorts, both, or (``auto``) shorts only without videos."""
    mode = channels.select("channel_id", F.coalesce("mode", F.lit("auto")).alias("_mode"))
    v, s = videos.join(mode, "channel_id"), shorts.join(mode, "channel_id")
    with_videos = videos.select("channel_id").distinct()
    both = merge_shorts_and_videos(
        s.filter("_mode = 'shorts-and-videos'").drop("_mode"), v.filter("_mode = 'shorts-and-videos'").drop("_mode")
    )
    plain_videos = v.filter("_mode in ('auto', 'videos-only')").drop("_mode").withColumn("is_short", F.lit(False))
    only_shorts = s.filter("_mode = 'shorts-only'").drop("_mode")
    fallback = s.filter("_mode = 'auto'").drop("_mode").join(with_videos, "channel_id", "left_anti")
    return (
        plain_videos.unionByName(only_shorts.withColumn("is_short", F.lit(True)))
        .unionByName(fallback.withColumn("is_short", F.lit(True)))
        .unionByName(both)
    )


# --- cursors -----------------------------------------------------------------

def missing_cursor(channels: DataFrame) -> DataFrame:
    """Channels that were never processed."""
    return channels.filter("last_seen_video_id is null")


def require_cursor(channels: DataFrame, window: DateWindow | None) -> None:
    """Raise for channels never processed when no window says where to start."""
    if window is not None:
        return
    named = missing_cursor(channels).select(F.coalesce("handle", "channel_id").alias("n")).orderBy("n").limit(21)
    names = [r["n"] for r in named.collect()]
    if names:
        more = ", …" if len(names) > 20 else ""
        raise MissingCursorError("a first run needs a date window: " + ", ".join(names[:20]) + more)


def new_entries(listing: DataFrame, channels: DataFrame, window: DateWindow | None = None) -> DataFrame:
    """Entries to process: those in the window, else those after the channel's cursor, else all."""
    known = channels.select("channel_id", F.col("last_seen_published").alias("_cursor"))
    joined = listing.join(known, "channel_id")
    if window is not None:
        fresh = window.holds("published")
    else:
        fresh = F.col("_cursor").isNull() | (F.col("published") > F.col("_cursor"))
    return joined.filter(fresh).drop("_cursor")


def advance_cursor(
    channels: DataFrame, entries: DataFrame, is_override: bool = False, kept: DataFrame | None = None
) -> DataFrame:
    """Channels with their cursor at the newest entry.

    An explicit window moves the cursor of new channels only. With ``kept`` (the
    entries left after later filters), an empty ``kept`` leaves all cursors alone.
    """
    newest = entries.groupBy("channel_id").agg(
        F.max_by(F.struct("video_id", "published"), F.struct("published", -F.col("pos"))).alias("_new")
    )
    moved = channels.join(newest, "channel_id", "left")
    moves = F.col("_new").isNotNull()
    if is_override:
        moves = moves & F.col("last_seen_published").isNull()
    if kept is not None:
        any_left = kept.select(F.lit(1).alias("_any")).limit(1).agg((F.count("_any") > 0).alias("_go"))
        # One row of one flag: bounded by construction.
        moved = moved.join(F.broadcast(any_left), F.lit(True))
        moves = moves & F.col("_go")
    return moved.withColumns({
        "last_seen_video_id": F.when(moves, F.col("_new.video_id")).otherwise(F.col("last_seen_video_id")),
        "last_seen_published": F.when(moves, F.col("_new.published")).otherwise(F.col("last_seen_published")),
    }).select(*channels.columns)


# --- run log -----------------------------------------------------------------

def list_runs(history: DataFrame, run_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs, newest first."""
    if run_type:
        history = history.filter(F.col("type") == run_type)
    ordered = history.orderBy(F.col("timestamp").desc(), "id")
    return ordered if limit is None else ordered.limit(limit)


def get_run(history: DataFrame, run_id: str) -> DataFrame:
    """The newest run of that id."""
    return history.filter(F.col("id") == run_id).orderBy(F.col("timestamp").desc()).limit(1)


def latest_batch(batches: DataFrame) -> DataFrame:
    """The batch changed last: ``batches(batch, modified)``."""
    return batches.agg(F.max_by("batch", F.struct("modified", "batch")).alias("batch"), F.max("modified").alias("modified"))


def run_status(batch_written, analysis_asked, analysis_written) -> Column:
    """``failed`` without a batch, ``partial`` without an analysis asked for, else ``ok``."""
    return (
        F.when(~F.col(batch_written), "failed")
        .when(F.col(analysis_asked) & ~F.col(analysis_written), "partial")
        .otherwise("ok")
    )


def append_run(history_path: str, runs: DataFrame) -> None:
    """Append runs to the log at ``history_path``."""
    runs.write.mode("append").parquet(history_path)


def cap_reached(entries: DataFrame, channels: DataFrame, cap: int) -> DataFrame:
    """``(channel_id, label, found)``: channels with ``cap`` entries or more, of which there may be further ones; none for a cap of 0 or less.

    ``label`` is the handle, else the id, else the url.
    """
    counts = entries.groupBy("channel_id").agg(F.count("*").alias("found"))
    label = F.coalesce("handle", F.col("channel_id").cast("string"), "url")
    known = counts.filter(F.lit(cap > 0) & (F.col("found") >= cap))
    return known.join(channels.select("channel_id", label.alias("label")), "channel_id").select("channel_id", "label", "found")
