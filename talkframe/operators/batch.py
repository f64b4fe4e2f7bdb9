"""Batch results: outcome, manifest, combined document, error log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions.columns import format_duration, format_timestamp, strip
from talkframe.operators.ordered import block_of, enclosed_pieces, placed_pieces


def batch_outcome(statuses: DataFrame) -> DataFrame:
    """Counts per batch and whether to suggest the ``smart`` backend.

    ``statuses(batch, backend, status)``. Suggested for two or more items of which
    half or more failed under another backend.
    """
    failed, total = F.count_if(F.col("status") == "failed"), F.count("*")
    smart = F.lower(F.coalesce(F.col("backend"), F.lit(""))) == "smart"
    return (
        statuses.groupBy("batch", "backend")
        .agg((total - failed).alias("ok"), failed.alias("failed"))
        .withColumn("fail_share", F.col("failed") / (F.col("ok") + F.col("failed")))
        .withColumn("suggest_smart", ~smart & (F.col("ok") + F.col("failed") >= 2) & (F.col("fail_share") >= 0.5))
    )


def manifest_entries(statuses: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per manifest entry: processed videos and failures together.

    ``statuses(batch, index, url, status, …)``, ``failures(batch, index, url, stage,
    error, hint)``.
    """
    failed = failures.withColumn("status", F.lit("failed"))
    return statuses.unionByName(failed, allowMissingColumns=True)


def manifest_stats(statuses: DataFrame, failures: DataFrame) -> DataFrame:
    """``total``, ``ok`` and ``failed`` per batch; failed counts failures and failed videos."""
    return (
        manifest_entries(statuses, failures)
        .groupBy("batch")
        .agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
        .select("batch", (F.col("ok") + F.col("failed")).alias("total"), "ok", "failed")
    )


def build_manifest(statuses: DataFrame, failures: DataFrame, meta: DataFrame) -> DataFrame:
    """``(batch, position, offset, piece)``: the manifest of each batch as one JSON document of any size.

    ``meta(batch, created_at, source_type, source_url, backend, language)``. The first piece holds the facts and the
    stats of the batch, then each entry is a piece, in ``index`` order, and the last closes the document.
    """
    entries = manifest_entries(statuses, failures)
    fields = [c for c in entries.columns if c != "batch"]
    facts = F.to_json(F.struct(
        F.col("batch").alias("batch_name"),
        "created_at",
        F.struct(F.col("source_type").alias("type"), F.col("source_url").alias("url")).alias("source"),
        F.struct("backend", "language").alias("config"),
        F.struct("total", "ok", "failed").alias("stats"),
        F.lit("community_content_unverified").alias("epistemic_status"),
    ))
    heads = manifest_stats(statuses, failures).join(meta, "batch")
    ends = heads.select("batch", F.concat(F.regexp_replace(facts, r"\}$", ""), F.lit(',"videos":[')).alias("_head"), F.lit("\n]}").alias("_end"))
    known = entries.join(meta.select("batch"), "batch", "left_semi")
    items = known.select("batch", F.col("index").alias("_i"), F.to_json(F.struct(*fields)).alias("_piece"))
    return enclosed_pieces(ends, items, "batch", "\n,")


#: What stands at the head of a combined document: its texts are what speakers said, not facts.
BANNER = (
    "> **Before you read on:** these are transcripts of videos by third parties. Speakers may be wrong, out of date or paid.\n"
    "> Compare what they say, name who says it, keep their degree of certainty, and mark what only one of them says.\n\n"
)


def _contents_entry(videos: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))
    bits = F.array_join(
        F.array_compact(
            F.array(
                F.date_format("upload_date", "yyyy-MM-dd"),
                F.when(F.col("duration_sec").isNotNull(), format_duration("duration_sec")),
                F.nullif("channel", F.lit("")),
                F.when(F.col("status") == "failed", "❌ failed"),
            )
        ),
        " • ",
    )
    entry = F.concat(
        F.col("index").cast("string"), F.lit(". ["), title, F.lit("]("), F.col("url"), F.lit(")"),
        F.when(bits != "", F.concat(F.lit(" — "), bits)).otherwise(F.lit("")), F.lit("\n"),
    )
    return videos.select("batch", F.lit(1).alias("_side"), F.col("index").cast("long").alias("_i"), F.lit(-1).cast("long").alias("_m"), entry.alias("_piece"))


def _section(videos: DataFrame) -> DataFrame:
    dash = F.lit("—")
    flags = F.array_join(F.coalesce("flags", F.array().cast("array<string>")), ", ")
    warning = F.when(
        F.coalesce(F.col("recommendation") != "use_as_is", F.lit(False)),
        F.concat(
            F.lit("\n⚠ **Quality: "), F.col("recommendation"), F.lit("** (score="), F.format_string("%.2f", F.col("score")),
            F.lit(", flags=["), F.when(flags == "", dash).otherwise(flags), F.lit("])\n"),
        ),
    ).otherwise(F.lit(""))

    def row(name, value):
        return F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))

    section = F.concat(
        F.lit("\n---\n\n## "), F.col("index").cast("string"), F.lit(". "), F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")),
        F.lit("\n\n| Field | Value |\n|---|---|\n"),
        row("URL", F.col("url")),
        row("Video ID", F.coalesce(F.nullif("video_id", F.lit("")), dash)),
        row("Date", F.coalesce(F.date_format("upload_date", "yyyy-MM-dd"), dash)),
        row("Duration", format_duration("duration_sec")),
        row("Channel", F.coalesce(F.nullif("channel", F.lit("")), dash)),
        row("Language detected", F.coalesce(F.nullif("language", F.lit("")), dash)),
        F.lit("\n"), strip("text"), F.lit("\n"), warning,
    )
    done = videos.filter("status = 'ok'")
    return done.select("batch", F.lit(2).alias("_side"), F.col("index").cast("long").alias("_i"), F.lit(-1).cast("long").alias("_m"), section.alias("_piece"))


def moment_pieces(visuals: DataFrame, group: list[str]) -> DataFrame:
    """Add ``piece``: the Markdown of each visual moment; the first of a group has the heading before it.

    ``visuals(…, moment, start, description, importance, keyframes, detected_objects, trigger_reason)``; ``group`` are the
    columns that tell videos apart, ``moment`` is a moment's number.
    """
    first = visuals.groupBy(*group).agg(F.min("moment").alias("_first"))
    objects = F.coalesce("detected_objects", F.array().cast("array<string>"))
    text = F.concat(
        F.when(F.col("moment") == F.col("_first"), F.lit("\n### Visual moments\n\n")).otherwise(F.lit("")),
        F.lit("#### "), format_timestamp("start"), F.lit(" — "), F.substring_index("description", ".", 1),
        F.lit(" (importance: "), F.col("importance").cast("string"), F.lit(")\n\n"),
        F.array_join(F.transform(F.coalesce("keyframes", F.array().cast("array<string>")), lambda k: F.concat(F.lit("![]("), k, F.lit(")\n\n"))), ""),
        F.col("description"), F.lit("\n\n"),
        F.when(F.size(objects) > 0, F.concat(F.lit("Objects detected: "), F.array_join(objects, ", "), F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit("Trigger: `"), F.coalesce("trigger_reason", F.lit("")), F.lit("`\n\n"),
    )
    return visuals.join(first, group).withColumn("piece", text).drop("_first")


def combined_document(videos: DataFrame, meta: DataFrame, visuals: DataFrame | None = None, banner: str = BANNER) -> DataFrame:
    """``(batch, position, offset, piece)``: one Markdown document a batch, of any size.

    Front matter, ``banner``, heading with counts, contents, and a section per transcribed video with a warning where its
    recommendation is not ``use_as_is`` and its visual moments. ``videos(batch, index, url, video_id, title, upload_date, duration_sec, channel,
    language, text, status, score, flags, recommendation)``; the last three are null without a quality check.
    ``meta(batch, created_at, source_type, source_url, backend, language)``, and any map ``backend_options``;
    ``visuals(batch, index, …)`` as in :func:`moment_pieces`.
    """
    counts = videos.groupBy("batch").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
    number = lambda c: F.col(c).cast("string")
    options = F.lit("")
    if "backend_options" in meta.columns:
        pairs = F.array_sort(F.map_entries(F.coalesce("backend_options", F.create_map().cast("map<string,string>"))))
        options = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    total = (F.col("ok") + F.col("failed")).cast("string")
    head = F.concat(
        F.lit("---\nbatch_name: "), number("batch"), F.lit("\ncreated_at: "), number("created_at"), F.lit("\nsource: "), F.col("source_type"),
        F.lit("\nsource_url: "), F.coalesce(F.nullif("source_url", F.lit("")), F.lit("null")), F.lit("\ntotal: "), total, F.lit("\nok: "), number("ok"),
        F.lit("\nfailed: "), number("failed"), F.lit("\nbackend: "), F.col("backend"), F.lit("\n"), options, F.lit("language: "), F.col("language"),
        F.lit("\n---\n"), F.lit(banner), F.lit("# Batch transcript — "), number("batch"), F.lit(" — "), F.substring(number("created_at"), 1, 10),
        F.lit("\n\n"), total, F.lit(" videos, backend: "), F.col("backend"), F.lit(". "), number("ok"), F.lit(" succeeded, "), number("failed"),
        F.lit(" failed.\n\n## Inputs\n\n"),
    )
    zero = F.lit(0).cast("long")
    heads = counts.join(meta, "batch").select("batch", F.lit(0).alias("_side"), zero.alias("_i"), zero.alias("_m"), head.alias("_piece"))
    known = videos.join(meta.select("batch"), "batch", "left_semi")
    rows = heads.unionByName(_contents_entry(known)).unionByName(_section(known))
    if visuals is not None:
        shown = visuals.join(known.filter("status = 'ok'").select("batch", "index"), ["batch", "index"], "left_semi")
        moments = moment_pieces(shown, ["batch", "index"])
        rows = rows.unionByName(moments.select("batch", F.lit(2).alias("_side"), F.col("index").cast("long").alias("_i"), F.col("moment").cast("long").alias("_m"), F.col("piece").alias("_piece")))
    at = F.col("_side") * F.lit(1 << 40) + block_of("_i", 1_000)
    return placed_pieces(rows, ["batch"], ["_side", "_i", "_m"], at, F.col("_piece"))


def error_log(failures: DataFrame, logged_at: str) -> DataFrame:
    """Log lines of each failure: ``(batch, index, entry)``; nothing without failures."""
    entry = F.concat(
        F.lit(f"[{logged_at}] FAILED #"), F.col("index").cast("string"), F.lit(" "), F.col("url"),
        F.lit("\n  Stage: "), F.col("stage"), F.lit("\n  Reason: "), F.col("error"),
        F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("\n  Hint: "), F.col("hint"))).otherwise(F.lit("")),
        F.lit("\n"),
    )
    return failures.select("batch", "index", entry.alias("entry"))
