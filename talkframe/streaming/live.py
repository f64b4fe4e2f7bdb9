"""Streams of entries, windows and calls.

The same results as the batch operators, kept up to date by Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkframe.operators.channels import advance_cursor, new_entries
from talkframe.operators.cost import price_calls
from talkframe.operators.targets import DateWindow


def stream_new_entries(
    entries: DataFrame,
    channels: DataFrame,
    window: DateWindow | None = None,
    lateness: str = "7 days",
) -> DataFrame:
    """New entries of followed channels, each video once.

    ``entries`` streams ``(channel_id, video_id, pos, published, …)``. A video that is
    listed again within ``lateness`` of its arrival is dropped; state older than that goes.
    When a video was published plays no part: old and undated entries are as new as others.
    """
    return _once(new_entries(entries, channels, window), lateness)


def _once(entries: DataFrame, lateness: str) -> DataFrame:
    """Each video once, by the time at which it arrives."""
    arrived = entries.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lateness)
    return arrived.dropDuplicatesWithinWatermark(["channel_id", "video_id"]).drop("_arrived")


def follow_channels(
    entries: DataFrame,
    channels_path: str,
    out_path: str,
    checkpoint: str,
    window: DateWindow | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append new entries to ``out_path`` and keep the cursors of ``channels_path`` up to date.

    Cursors are versions under ``channels_path``: each micro-batch reads the latest one
    below its own number and writes ``version=<batch + 1>``; entries go to
    ``batch=<batch>``. Both overwrite their own folder only, so a batch that is run
    again after a failure gives the same files.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Versions are folders, so only the chosen one is read.
        channels = _latest_version(spark, channels_path, batch_id)
        fresh = new_entries(batch, channels, window).persist()
        try:
            fresh.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            moved = advance_cursor(channels, fresh, is_override=window is not None)
            moved.write.mode("overwrite").parquet(f"{channels_path}/version={batch_id + 1}")
        finally:
            fresh.unpersist()

    return (
        _once(entries, "7 days").writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _latest_version(spark: SparkSession, channels_path: str, batch_id: int) -> DataFrame:
    table = spark.read.parquet(channels_path)
    newest = table.filter(F.col("version") <= batch_id).agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == newest).drop("version")


def stream_merge_windows(windows: DataFrame, max_gap: float = 1.0, lateness: str = "10 minutes") -> DataFrame:
    """Merged detection windows of a live stream, each once it is final.

    ``windows`` streams ``(video_id, start_at, start, end, …)``, ``start_at`` the
    window's time as a timestamp. A session stays open for the window's length plus
    the gap, which is the merge rule of the batch operator; windows later than
    ``lateness`` are dropped. In append mode a window comes out once it is final, and its state goes: only open
    windows are held. A stream that ends is closed by a row of :func:`closing_row`, which lets all open windows out; the stream then equals the
    batch operator. Rows without ``video_id`` are in no window.
    """
    length = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast(end - start + {max_gap} as decimal(18, 6)))")
    session = F.session_window("start_at", length)
    rank = F.struct(-(F.col("score") * F.col("weight")), F.col("start"), F.col("win_idx"))
    return (
        windows.withWatermark("start_at", lateness)
        .groupBy("video_id", session)
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.min_by(F.struct("reason", "score", "weight", "phrase"), rank).alias("_b"),
            # A test of the key itself would be moved before the watermark, which needs the closing row.
            F.count("video_id").alias("_known"),
        )
        .filter("_known > 0")
        .select("video_id", "start", "end", "_b.*")
    )


def closing_row(windows: DataFrame, start_at: str) -> DataFrame:
    """One row with the columns of ``windows`` that ends a stream of them: all windows before ``start_at`` are final.

    ``start_at`` lies behind the last window's end by the lateness of the stream and more.
    """
    spark = windows.sparkSession
    given = {"start_at": F.lit(start_at).cast("timestamp"), "start": F.lit(0.0), "end": F.lit(0.0)}
    return spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in windows.schema.fields])


def stream_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Running calls, tokens and cost by stage of a stream of calls, for update mode."""
    return price_calls(calls, prices).groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
