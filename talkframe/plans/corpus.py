"""Transcript tables derived from general tables, and the same as SQL.

Maps documents, conversations, events, orders, customers, line items, pages and
embeddings onto segments, listings, windows, frames, silences, calls and vectors,
so that operators can run on any such data set. Numbers are chosen to be exact in
binary, so that results do not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.operators.tables import small_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_segments(documents: DataFrame) -> DataFrame:
    """One segment a line, one every 5 s; very short lines stretch over 8 s."""
    rows = documents.select(
        F.col("doc_id").alias("video_id"), "lang", F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "text")
    )
    start = F.col("seg_idx") * 5.0
    length = F.when(F.length("text") < 12, F.lit(8.0)).otherwise(F.least(F.length("text"), F.lit(80)) / 16.0)
    return rows.select("video_id", "lang", "seg_idx", start.alias("start"), (start + length).alias("end"), "text")


SEGS = """segs AS (
  SELECT video_id, lang, seg_idx, seg_idx * 5::DOUBLE AS start,
         seg_idx * 5::DOUBLE + CASE WHEN length(text) < 12 THEN 8::DOUBLE ELSE least(length(text), 80) / 16::DOUBLE END AS "end",
         text
  FROM (SELECT doc_id AS video_id, lang, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_idx
        FROM documents))"""


def talk_segments(conversations: DataFrame) -> DataFrame:
    start = F.col("turn") * 5.0
    return conversations.select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), start.alias("start"),
        (start + F.least(F.length("text"), F.lit(80)) / 16.0).alias("end"), "text",
    )


TALK = """talk AS (
  SELECT conv_id AS video_id, turn AS seg_idx, turn * 5::DOUBLE AS start,
         turn * 5::DOUBLE + least(length(text), 80) / 16::DOUBLE AS "end", text FROM conversations)"""


def talk_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("turn_idx"), (F.col("turn") * 5.0 + 2).alias("start"),
        (F.col("turn") * 5.0 + 6).alias("end"), F.upper("role").alias("speaker"),
    )


TURNS = """turns AS (
  SELECT conv_id AS video_id, turn AS turn_idx, turn * 5::DOUBLE + 2 AS start, turn * 5::DOUBLE + 6 AS "end",
         upper(role) AS speaker FROM conversations)"""


def listing(events: DataFrame) -> DataFrame:
    """Channel listings: users as channels, events as videos, newest first by ``pos``."""
    return events.select(
        F.col("user_id").alias("channel_id"), F.concat(F.lit("vid"), F.col("event_id").cast("string")).alias("video_id"),
        (F.lit(10_000_000_000) - F.col("event_id")).alias("pos"),
        F.concat_ws(" ", "event_type", F.col("props")).alias("title"), F.floor("value").alias("duration_sec"),
        F.col("ts").cast("timestamp").alias("published"),
    )


LISTING = """listing AS (
  SELECT user_id AS channel_id, 'vid' || event_id AS video_id, 10000000000 - event_id AS pos,
         event_type || ' ' || props AS title, CAST(floor(value) AS BIGINT) AS duration_sec, ts AS published FROM events)"""

CURSOR_AT = "2024-01-15 00:00:00"


def channels(events: DataFrame) -> DataFrame:
    """One channel a user; most have a cursor at their last event before mid-January."""
    before = F.when(F.col("ts") < F.lit(CURSOR_AT).cast("timestamp_ntz"), F.col("event_id"))
    users = events.groupBy(F.col("user_id").alias("channel_id")).agg(
        F.max_by("event_id", F.when(before.isNotNull(), F.col("ts"))).alias("e"),
        F.max(F.when(before.isNotNull(), F.col("ts"))).alias("t"),
    )
    known = F.col("channel_id") % 5 != 0
    modes = F.array(F.lit("auto"), F.lit("videos-only"), F.lit("shorts-only"), F.lit("shorts-and-videos"))
    platforms = F.array(F.lit("youtube"), F.lit("instagram"), F.lit("tiktok"))
    name = F.col("channel_id").cast("string")
    return users.select(
        "channel_id", F.concat(F.lit("https://www.youtube.com/@u"), name).alias("url"), F.concat(F.lit("@u"), name).alias("handle"),
        F.when(F.col("channel_id") % 4 != 0, F.concat(F.lit("g"), (F.col("channel_id") % 3).cast("string"))).alias("group"),
        F.get(platforms, (F.col("channel_id") % 3).cast("int")).alias("platform"),
        F.get(modes, (F.col("channel_id") % 4).cast("int")).alias("mode"),
        F.when(known, F.concat(F.lit("vid"), F.col("e").cast("string"))).alias("last_seen_video_id"),
        F.when(known, F.col("t").cast("timestamp")).alias("last_seen_published"),
    )


CHANNELS = f"""channels AS (
  SELECT channel_id, 'https://www.youtube.com/@u' || channel_id AS url, '@u' || channel_id AS handle,
         CASE WHEN channel_id % 4 <> 0 THEN 'g' || (channel_id % 3) END AS "group",
         ['youtube', 'instagram', 'tiktok'][channel_id % 3 + 1] AS platform,
         ['auto', 'videos-only', 'shorts-only', 'shorts-and-videos'][channel_id % 4 + 1] AS mode,
         CASE WHEN channel_id % 5 <> 0 THEN 'vid' || e END AS last_seen_video_id,
         CASE WHEN channel_id % 5 <> 0 THEN t END AS last_seen_published
  FROM (SELECT user_id AS channel_id, max_by(event_id, ts) FILTER (ts < TIMESTAMP '{CURSOR_AT}') AS e,
               max(ts) FILTER (ts < TIMESTAMP '{CURSOR_AT}') AS t FROM events GROUP BY 1))"""


def event_windows(events: DataFrame) -> DataFrame:
    """Detection windows: three hours of each user, scored by the event's value."""
    second = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(86400))
    start = second / 8.0
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("win_idx"), start.alias("start"),
        (start + F.floor("value")).alias("end"), F.col("event_type").alias("reason"),
        (F.pmod(F.floor(F.col("value") * 100), F.lit(10)) / 4.0).alias("score"), (k % 3 + 1).cast("double").alias("weight"),
        F.concat(F.lit("p"), k.cast("string")).alias("phrase"),
    )


WINDOWS = """windows AS (
  SELECT user_id AS video_id, event_id AS win_idx, start, start + floor(value) AS "end", event_type AS reason,
         (CAST(floor(value * 100) AS BIGINT) % 10) / 4::DOUBLE AS score, CAST(k % 3 + 1 AS DOUBLE) AS weight, 'p' || k AS phrase
  FROM (SELECT *, (CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 8::DOUBLE AS start,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def order_frames(orders: DataFrame) -> DataFrame:
    """Frame hashes: customers as videos, orders as frames."""
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    return orders.select(
        F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("frame_idx"), (F.col("o_orderkey") / 8.0).alias("ts"),
        (cents * F.lit(2654435761)).alias("hash"),
    )


FRAMES = """frames AS (
  SELECT o_custkey AS video_id, o_orderkey AS frame_idx, o_orderkey / 8::DOUBLE AS ts,
         CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * 2654435761 AS hash FROM orders)"""


def customer_windows(customers: DataFrame) -> DataFrame:
    rows = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    start = F.col("i") * 300.0
    return rows.select(
        F.col("c_custkey").alias("video_id"), F.col("i").cast("long").alias("win_idx"), start.alias("start"),
        (start + (F.col("c_custkey") % 7) * 120).alias("end"),
        F.get(F.array(F.lit("raw"), F.lit("soft:en"), F.lit("scene_change")), F.col("i") % 3).alias("reason"),
        F.lit(0.75).alias("score"), F.lit(1.0).alias("weight"), F.lit("").alias("phrase"),
    )


CUSTOMER_WINDOWS = """cwindows AS (
  SELECT c_custkey AS video_id, CAST(i AS BIGINT) AS win_idx, i * 300::DOUBLE AS start,
         i * 300::DOUBLE + (c_custkey % 7) * 120 AS "end", ['raw', 'soft:en', 'scene_change'][i % 3 + 1] AS reason,
         0.75::DOUBLE AS score, 1::DOUBLE AS weight, '' AS phrase
  FROM customer, unnest(range(5)) AS u(i))"""


def media(customers: DataFrame) -> DataFrame:
    return customers.select(
        F.col("c_custkey").alias("video_id"), (F.abs(F.floor("c_acctbal")) / 4.0 + 600).alias("duration"),
        (F.col("c_custkey") % 6 + 1).alias("n_chunks"),
    )


MEDIA = """media AS (
  SELECT c_custkey AS video_id, abs(floor(c_acctbal)) / 4::DOUBLE + 600 AS duration, c_custkey % 6 + 1 AS n_chunks FROM customer)"""


def order_silences(orders: DataFrame) -> DataFrame:
    start = (F.col("o_orderkey") * 37 % 2400) / 4.0
    return orders.select(
        F.col("o_custkey").alias("video_id"), start.alias("start"), (start + F.col("o_orderkey") % 5 + 1).alias("end")
    )


SILENCES = """silences AS (
  SELECT o_custkey AS video_id, (o_orderkey * 37 % 2400) / 4::DOUBLE AS start,
         (o_orderkey * 37 % 2400) / 4::DOUBLE + o_orderkey % 5 + 1 AS "end" FROM orders)"""


def calls(lineitem: DataFrame) -> DataFrame:
    """Model calls: orders of a month as runs, line items as calls."""
    return lineitem.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("run_id"), F.col("l_returnflag").alias("stage"),
        F.concat(F.lit("model-"), F.col("l_linestatus"), (F.col("l_linenumber") % 3).cast("string")).alias("model"),
        F.floor("l_extendedprice").alias("prompt_tokens"), F.floor(F.col("l_quantity") * 10).alias("output_tokens"),
        F.floor(F.col("l_extendedprice") * F.col("l_linenumber") / 4).alias("cached_tokens"),
    )


CALLS = """calls AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS run_id, l_returnflag AS stage, 'model-' || l_linestatus || (l_linenumber % 3) AS model,
         CAST(floor(l_extendedprice) AS BIGINT) AS prompt_tokens, CAST(floor(l_quantity * 10) AS BIGINT) AS output_tokens,
         CAST(floor(l_extendedprice * l_linenumber / 4) AS BIGINT) AS cached_tokens FROM lineitem)"""

# Rates with four odd decimals, so that sums never fall on a rounding tie.
PRICE_ROWS = [("model-O0", 0.5003, 2.0007), ("model-O1", 1.2511, 9.9991), ("model-F0", 0.2503, 0.7507), ("model-F2", 2.4991, 8.0009)]


def prices(spark: SparkSession) -> DataFrame:
    return small_table(spark, PRICE_ROWS, "model string, input_rate double, output_rate double")


PRICES = "prices(model, input_rate, output_rate) AS (VALUES " + ", ".join(
    f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICE_ROWS
) + ")"

TRIGGER_ROWS = [
    ("raw", "", "the the", 1.0, 0), ("raw", "", "License", 2.0, 1), ("raw", "", "of the ", 1.5, 2), ("raw", "", "token", 0.5, 3),
    ("strict", "en", "and the", 1.25, 0), ("strict", "fr", "de la", 1.5, 1), ("strict", "de", "der die", 1.5, 2),
    ("strict", "es", "que la", 1.5, 3), ("soft", "en", "whinge thatres", 1.0, 0), ("soft", "en", "thouing", 1.25, 1),
    ("soft", "fr", "la tionmentre", 1.0, 2), ("soft", "de", "schenung", 1.0, 3), ("soft", "es", "ciónesos", 0.75, 4),
    ("soft", "en", "er is", 1.0, 5),
]


def triggers(spark: SparkSession) -> DataFrame:
    return small_table(spark, TRIGGER_ROWS, "kind string, lang string, phrase string, weight double, seq bigint")


TRIGGERS = "triggers(kind, lang, phrase, weight, seq) AS (VALUES " + ", ".join(
    f"('{k}', '{lang}', '{p}', {w}::DOUBLE, {s}::BIGINT)" for k, lang, p, w, s in TRIGGER_ROWS
) + ")"

PLAIN_WORD = "^[a-zа-яё]+$"


def vocabulary(documents: DataFrame) -> DataFrame:
    """``(language, word, n)``: words of each language and the documents that have them."""
    from talkframe.functions.fixed_values import WORD_PATTERN

    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(0)))
    return documents.select(F.col("lang").alias("language"), F.explode(found).alias("word")).groupBy("language", "word").agg(
        F.count("*").alias("n")
    )


TOKENS = """tokens AS (
  SELECT doc_id, lang, w AS word FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+')) AS w FROM documents)
  WHERE regexp_full_match(w, '[a-zа-яё]+'))"""
VOCABULARY = """vocabulary AS (
  SELECT lang AS language, word, count(DISTINCT doc_id) AS n FROM tokens GROUP BY 1, 2)"""


def lemma_table(documents: DataFrame) -> DataFrame:
    """A stand-in for a lemma list: words of five and more letters lose their last two."""
    return vocabulary(documents).filter("length(word) >= 5").select(
        F.col("language").alias("lang"), "word", F.expr("left(word, length(word) - 2)").alias("lemma")
    )


LEMMAS = "lemmas AS (SELECT language AS lang, word, left(word, length(word) - 2) AS lemma FROM vocabulary WHERE length(word) >= 5)"


def targets(documents: DataFrame) -> DataFrame:
    """Videos from document heads; some dates and lengths are unknown."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
    return documents.select(
        F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("doc_"), (F.col("doc_id") % 701).cast("string"))).alias("video_id"),
        F.concat(F.lit("https://youtu.be/doc_"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("title"), F.col("source").alias("channel"),
        F.when(F.col("doc_id") % 7 != 0, day).alias("upload_date"),
        F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("n_chars") / 15)).alias("duration_sec"),
        F.col("lang"), F.col("doc_id").alias("pos"),
    )


TARGETS = """targets AS (
  SELECT CASE WHEN doc_id % 11 <> 0 THEN 'doc_' || (doc_id % 701) END AS video_id, 'https://youtu.be/doc_' || doc_id AS url,
         lang || ' ' || source AS title, source AS channel,
         CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS DATE) END AS upload_date,
         CASE WHEN doc_id % 5 <> 0 THEN n_chars // 15 END AS duration_sec, lang, doc_id AS pos FROM documents)"""
