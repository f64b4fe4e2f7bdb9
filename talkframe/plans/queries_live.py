"""Queries that run the streams over the tables as they are, until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.operators.channels import append_run
from talkframe.operators.tables import new_path
from talkframe.plans import corpus as C
from talkframe.plans.queries_catalogue import HISTORY, channels, history
from talkframe.plans.queries_windows import CALL_COST, MERGED
from talkframe.plans.registry import query, with_tables
from talkframe.streaming import live as L


def _stream(spark, folder, name):
    """A table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _new_folder(spark, name):
    return new_path(spark, name)


def _run(spark, stream, mode):
    """Run a stream until all input is read; the result table."""
    folder = _new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
        query.awaitTermination()
        return spark.read.parquet(f"{folder}/rows")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query("stream_new_entries", with_tables(C.LISTING, C.CHANNELS) + """
SELECT channel_id, video_id FROM listing JOIN channels USING (channel_id) WHERE last_seen_published IS NULL OR published > last_seen_published""")
def stream_new_entries(spark, folder):
    entries = C.listing(_stream(spark, folder, "events"))
    return _run(spark, L.stream_new_entries(entries, channels(spark, folder)), "append").select("channel_id", "video_id")


@query("stream_merge_windows", with_tables(C.WINDOWS, MERGED.format(source="windows", gap=1)) + """
SELECT video_id, start, "end", reason, score, weight, phrase FROM merged""")
def stream_merge_windows(spark, folder):
    """Windows arriving in slices of half an hour, several batches, and a row that closes the stream."""
    windows = C.event_windows(C.table(spark, folder, "events")).withColumn("start_at", F.timestamp_millis((F.col("start") * 1000).cast("long")))
    arriving = _new_folder(spark, "windows")
    for begin in range(0, 10_800, 1_800):
        windows.filter((F.col("start") >= begin) & (F.col("start") < begin + 1_800)).write.mode("append").parquet(arriving)
    L.closing_row(windows, "1970-01-03 00:00:00").write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 8).parquet(arriving)
    return _run(spark, L.stream_merge_windows(stream, lateness="40 minutes"), "append")


@query("stream_cost", with_tables(C.CALLS, C.PRICES) + f"""
SELECT stage, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, round(sum({CALL_COST}), 5) AS cost_usd
FROM calls LEFT JOIN prices USING (model) GROUP BY stage""")
def stream_cost(spark, folder):
    out = _run(spark, L.stream_cost(C.calls(_stream(spark, folder, "lineitem")), C.prices(spark)), "update")
    newest = out.groupBy("stage").agg(F.max_by(F.struct("calls", "prompt_tokens", "output_tokens", "cached_tokens", "cost_usd"), "batch").alias("r"))
    return newest.select("stage", "r.*").withColumn("cost_usd", F.round("cost_usd", 5))


@query("append_run", with_tables(HISTORY) + "SELECT type, count(*) AS runs, max(timestamp) AS newest FROM history GROUP BY type")
def append_runs(spark, folder):
    """Two appends to a run log, read back."""
    path = _new_folder(spark, "history")
    runs = history(spark, folder)
    append_run(path, runs.filter("type <= 'error'"))
    append_run(path, runs.filter("type > 'error'"))
    return spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("runs"), F.max("timestamp").alias("newest"))
