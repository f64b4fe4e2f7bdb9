"""Queries over targets, channels, batches and the run log."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from talkframe.operators import batch as B
from talkframe.operators import channels as H
from talkframe.operators import targets as T
from talkframe.plans import corpus as C
from talkframe.plans.queries_files import FAILURES, STATUSES, statuses
from talkframe.plans.registry import query, with_tables


def targets(spark, folder):
    return C.targets(C.table(spark, folder, "documents"))


def events(spark, folder):
    return C.table(spark, folder, "events")


def listing(spark, folder):
    return C.listing(events(spark, folder))


def channels(spark, folder):
    return C.channels(events(spark, folder))


def _days(df):
    return df.withColumn("upload_date", F.col("upload_date").cast("string"))


TARGET_COLUMNS = "video_id, url, title, channel, CAST(upload_date AS VARCHAR) AS upload_date, duration_sec, lang, pos"


@query("filter_targets", with_tables(C.TARGETS) + f"""SELECT {TARGET_COLUMNS} FROM targets
WHERE (upload_date IS NULL OR upload_date BETWEEN DATE '2024-03-01' AND DATE '2024-10-31') AND (duration_sec IS NULL OR (duration_sec BETWEEN 20 AND 900 AND duration_sec > 60))""")
def filter_targets(spark, folder):
    return _days(T.filter_targets(targets(spark, folder), date(2024, 3, 1), date(2024, 10, 31), 20, 900, include_shorts=False))


@query("candidates_in_window", with_tables(C.TARGETS) + f"""SELECT {TARGET_COLUMNS} FROM targets
WHERE upload_date IS NULL OR upload_date BETWEEN DATE '2024-05-02' AND DATE '2024-06-01'""")
def candidates_in_window(spark, folder):
    return _days(T.candidates_in_window(targets(spark, folder), T.date_window(days=30, today=date(2024, 6, 1))))


@query("match_titles", with_tables(C.TARGETS) + f"SELECT {TARGET_COLUMNS} FROM targets WHERE contains(lower(coalesce(title, '')), 'n src1')")
def match_titles(spark, folder):
    return _days(T.match_titles(targets(spark, folder), "N SRC1"))


@query("valid_video_ids", "SELECT 'vid' || event_id AS video_id FROM events WHERE regexp_full_match('vid' || event_id, '[\\w-]{6,20}')")
def valid_video_ids(spark, folder):
    return T.valid_video_ids(listing(spark, folder).select("video_id"))


@query("select_rows", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n IN (1, 3, 5, 6, 7)""")
def select_rows(spark, folder):
    docs = C.table(spark, folder, "documents").select("source", "doc_id")
    return T.select_rows(docs, "1,3,5-7", "doc_id", ["source"])


@query("skip_existing", with_tables(C.TARGETS) + """SELECT video_id, url FROM targets
WHERE video_id IS NULL OR video_id NOT IN (SELECT 'doc_' || (doc_id % 701) FROM labels)""")
def skip_existing(spark, folder):
    done = C.table(spark, folder, "labels").select(F.concat(F.lit("doc_"), (F.col("doc_id") % 701).cast("string")).alias("video_id"))
    return T.skip_existing(targets(spark, folder), done).select("video_id", "url")


@query("source_for_transcript", """
WITH f AS (SELECT source AS batch, '01_' || replace(title, ' ', '_') || CASE WHEN doc_id % 2 = 0 THEN '_id' || doc_id || 'x' ELSE '' END AS stem
           FROM (SELECT *, lang || ' clip ' || doc_id % 7 AS title FROM documents)),
v AS (SELECT source AS batch, doc_id AS index, 'id' || doc_id || 'x' AS video_id, lang || ' clip ' || doc_id % 7 AS title, 'u' || doc_id AS url FROM documents),
h AS (SELECT f.batch, stem, url, CASE WHEN contains(stem, video_id) THEN 0 ELSE 1 END AS rule, index FROM (SELECT DISTINCT batch, stem FROM f) f
      JOIN v ON v.batch = f.batch AND (contains(stem, video_id) OR contains(stem, replace(title, ' ', '_'))))
SELECT batch, stem, b.url FROM f LEFT JOIN (SELECT batch, stem, arg_min(url, rule * 1000000000 + index) AS url FROM h GROUP BY 1, 2) b USING (batch, stem)""")
def source_for_transcript(spark, folder):
    docs = C.table(spark, folder, "documents")
    title = F.concat(F.col("lang"), F.lit(" clip "), (F.col("doc_id") % 7).cast("string"))
    name = F.concat(F.lit("id"), F.col("doc_id").cast("string"), F.lit("x"))
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), name)).otherwise(F.lit(""))
    files = docs.select(F.col("source").alias("batch"), F.concat(F.lit("01_"), F.replace(title, F.lit(" "), F.lit("_")), tail).alias("stem"))
    videos = docs.select(
        F.col("source").alias("batch"), F.col("doc_id").alias("index"), name.alias("video_id"), title.alias("title"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"),
    )
    return T.source_for_transcript(files, videos)


@query("resolve_targets", with_tables(C.TARGETS) + """,
s AS (SELECT video_id, url, title, 0 AS source_rank, pos FROM targets WHERE lang = 'fr' UNION ALL SELECT video_id, url, title, 1, pos FROM targets WHERE lang IN ('en', 'fr')
      UNION ALL SELECT video_id, url || '#p', title, 2, pos FROM targets)
SELECT video_id, url, title, source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY source_rank, pos) AS nth FROM s) WHERE nth = 1 OR video_id IS NULL""")
def resolve_targets(spark, folder):
    t = targets(spark, folder).select("video_id", "url", "title", "pos", "lang")
    lists = [t.filter("lang = 'fr'"), t.filter("lang in ('en', 'fr')"), t.withColumn("url", F.concat("url", F.lit("#p")))]
    return T.resolve_targets(*[x.drop("lang") for x in lists])


@query("merge_language_searches", with_tables(C.TARGETS) + """,
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS n FROM targets WHERE lang IN ('fr', 'en', 'de')),
k AS (SELECT *, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS rank FROM l WHERE n <= 200 AND video_id IS NOT NULL)
SELECT video_id, url, lang, pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank, pos) AS nth FROM k) WHERE nth = 1""")
def merge_language_searches(spark, folder):
    found = targets(spark, folder).select("video_id", "url", "lang", "pos")
    return T.merge_language_searches(found, ["fr", "en", "de"], 200)


@query("limit_per_source", with_tables(C.TARGETS) + """
SELECT channel, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY pos) AS n FROM targets) WHERE n <= 10""")
def limit_per_source(spark, folder):
    return T.limit_per_source(targets(spark, folder).select("channel", "pos", "url"), 10, "channel", "pos")


@query("order_caption_tracks", """
SELECT user_id AS video_id, arg_min(event_type, CASE WHEN value > 100 THEN 0 ELSE 1 END * 1000000000 + event_id) AS lang FROM events GROUP BY 1""")
def order_caption_tracks(spark, folder):
    tracks = events(spark, folder).select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("track_idx"), F.col("event_type").alias("lang"), (F.col("value") > 100).alias("is_generated")
    )
    return T.order_caption_tracks(tracks).select("video_id", "lang")


@query("source_type", """
WITH t AS (SELECT doc_id % 200 AS batch, CASE WHEN doc_id % 200 < 50 THEN 'file' WHEN doc_id % 200 < 90 THEN 'channel' WHEN doc_id % 200 < 120 THEN 'inline' WHEN doc_id % 2 = 0 AND doc_id > 300 THEN 'playlist' ELSE 'search' END AS source FROM documents)
SELECT batch, CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' WHEN min(source) = 'file' AND batch % 3 = 0 THEN 'file' WHEN min(source) IN ('channel', 'playlist', 'inline') THEN min(source) ELSE 'mixed' END AS source_type
FROM t GROUP BY batch""")
def source_type(spark, folder):
    b = F.col("doc_id") % 200
    kind = F.when(b < 50, "file").when(b < 90, "channel").when(b < 120, "inline").when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") > 300), "playlist").otherwise("search")
    return T.source_type(C.table(spark, folder, "documents").select(b.alias("batch"), kind.alias("source"), (b % 3 == 0).alias("from_file")))


# --- channels ----------------------------------------------------------------

CH = "channel_id, url, handle, \"group\", platform, mode, last_seen_video_id, last_seen_published"


@query("filter_group", with_tables(C.CHANNELS) + "SELECT 'ungrouped' AS asked, channel_id FROM channels WHERE \"group\" IS NULL UNION ALL SELECT 'g1', channel_id FROM channels WHERE \"group\" = 'g1' UNION ALL SELECT 'all', channel_id FROM channels")
def filter_group(spark, folder):
    ch = channels(spark, folder)
    parts = [H.filter_group(ch, g).select(F.lit(g or "all").alias("asked"), "channel_id") for g in ("ungrouped", "g1", None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("list_groups", with_tables(C.CHANNELS) + "SELECT DISTINCT \"group\" FROM channels WHERE \"group\" IS NOT NULL")
def list_groups(spark, folder):
    return H.list_groups(channels(spark, folder))


@query("upsert_channels", with_tables(C.CHANNELS) + """,
n AS (SELECT c_custkey AS channel_id, 'https://new/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS handle, CAST(NULL AS VARCHAR) AS "group", c_mktsegment AS mode FROM customer)
SELECT coalesce(n.channel_id, c.channel_id) AS channel_id, coalesce(n.url, c.url) AS url, coalesce(n.handle, c.handle) AS handle, coalesce(n."group", c."group") AS "group", coalesce(n.mode, c.mode) AS mode
FROM channels c FULL JOIN n ON n.channel_id = c.channel_id""")
def upsert_channels(spark, folder):
    fields = ["channel_id", "url", "handle", "group", "mode"]
    new = C.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("channel_id"), F.concat(F.lit("https://new/"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("handle"), F.lit(None).cast("string").alias("group"), F.col("c_mktsegment").alias("mode"),
    )
    return H.upsert_channels(channels(spark, folder).select(*fields), new)


@query("remove_and_set_mode", with_tables(C.CHANNELS) + """SELECT channel_id, CASE WHEN handle IN ('@u3', '@u4') THEN 'shorts-only' ELSE mode END AS mode FROM channels
WHERE handle NOT IN ('@u1') AND url NOT IN ('https://www.youtube.com/@u2')""")
def remove_and_set_mode(spark, folder):
    left = H.remove_channels(channels(spark, folder), ["@u1", "https://www.youtube.com/@u2"])
    return H.set_mode(left, ["@u3", "@u4"], "shorts-only").select("channel_id", "mode")


WINDOW = T.DateWindow(date(2024, 1, 10), date(2024, 1, 20))


@query("take_while_in_window", with_tables(C.LISTING) + """,
d AS (SELECT *, NOT (CAST(published AS DATE) >= DATE '2024-01-10' AND duration_sec < 150) AS stop FROM listing WHERE duration_sec % 7 <> 0),
e AS (SELECT channel_id, min(pos) AS ends FROM d WHERE stop GROUP BY 1)
SELECT channel_id, video_id FROM (SELECT d.channel_id, video_id, row_number() OVER (PARTITION BY d.channel_id ORDER BY pos) AS n FROM d LEFT JOIN e USING (channel_id) WHERE ends IS NULL OR pos < ends) WHERE n <= 5""")
def take_while_in_window(spark, folder):
    rows = listing(spark, folder).withColumn("published", F.when(F.col("duration_sec") % 7 != 0, F.col("published")))
    inside = (F.to_date("published") >= F.lit(date(2024, 1, 10))) & (F.col("duration_sec") < 150)
    return H.take_while_in_window(rows, inside, cap=5).select("channel_id", "video_id")


@query("take_until_seen", with_tables(C.LISTING, C.CHANNELS) + """,
e AS (SELECT channel_id, min(pos) AS ends FROM listing JOIN channels USING (channel_id) WHERE video_id = last_seen_video_id GROUP BY 1)
SELECT channel_id, video_id FROM listing LEFT JOIN e USING (channel_id) WHERE ends IS NULL OR pos < ends""")
def take_until_seen(spark, folder):
    return H.take_until_seen(listing(spark, folder), channels(spark, folder)).select("channel_id", "video_id")


@query("synthetic_published", """
SELECT 'vid' || event_id AS video_id, CAST(epoch(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 12:00:00' - to_minutes(event_id % 1000) ELSE date_trunc('second', ts) END) AS BIGINT) AS published_s FROM events""")
def synthetic_published(spark, folder):
    rows = events(spark, folder).select(
        F.concat(F.lit("vid"), F.col("event_id").cast("string")).alias("video_id"), (F.col("event_id") % 1000).alias("pos"),
        F.when(F.col("event_id") % 3 != 0, F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("published"),
    )
    out = H.synthetic_published(rows, datetime(2024, 2, 1, 12, 0, 0))
    return out.select("video_id", F.unix_seconds("published").alias("published_s"))


SPLIT = """tagged AS (SELECT channel_id, 'v' || (CAST(substr(video_id, 4) AS BIGINT) // 3) AS video_id, pos, published, duration_sec <= 60 AS is_short FROM listing),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, video_id ORDER BY published DESC, is_short DESC, pos) AS nth FROM tagged) WHERE nth = 1)"""


def _split(spark, folder):
    rows = listing(spark, folder)
    video = F.concat(F.lit("v"), F.floor(F.substring("video_id", 4, 20).cast("long") / 3).cast("string"))
    both = rows.select("channel_id", video.alias("video_id"), "pos", "published", "duration_sec")
    return both.filter("duration_sec <= 60").drop("duration_sec"), both.filter("duration_sec > 60").drop("duration_sec")


@query("merge_shorts_and_videos", with_tables(C.LISTING, SPLIT) + "SELECT channel_id, video_id, pos, is_short FROM latest")
def merge_shorts_and_videos(spark, folder):
    return H.merge_shorts_and_videos(*_split(spark, folder)).drop("published")


@query("auto_fallback", with_tables(C.LISTING, C.CHANNELS, SPLIT) + """,
t AS (SELECT t.*, mode FROM tagged t JOIN channels USING (channel_id))
SELECT channel_id, video_id, pos, is_short FROM t WHERE (NOT is_short AND mode IN ('auto', 'videos-only')) OR (is_short AND mode = 'shorts-only')
  OR (is_short AND mode = 'auto' AND channel_id NOT IN (SELECT channel_id FROM t WHERE NOT is_short))
UNION ALL SELECT channel_id, video_id, pos, is_short FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, video_id ORDER BY published DESC, is_short DESC, pos) AS nth FROM t WHERE mode = 'shorts-and-videos') WHERE nth = 1""")
def auto_fallback(spark, folder):
    shorts, videos = _split(spark, folder)
    return H.auto_fallback(videos, shorts, channels(spark, folder)).drop("published")


@query("missing_cursor", with_tables(C.CHANNELS) + "SELECT channel_id, handle FROM channels WHERE last_seen_video_id IS NULL")
def missing_cursor(spark, folder):
    return H.missing_cursor(channels(spark, folder)).select("channel_id", "handle")


@query("new_entries", with_tables(C.LISTING, C.CHANNELS) + """
SELECT 'cursor' AS rule, channel_id, video_id FROM listing JOIN channels USING (channel_id) WHERE last_seen_published IS NULL OR published > last_seen_published
UNION ALL SELECT 'window', channel_id, video_id FROM listing WHERE CAST(published AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def new_entries(spark, folder):
    rows, ch = listing(spark, folder), channels(spark, folder)
    by_cursor = H.new_entries(rows, ch).select(F.lit("cursor").alias("rule"), "channel_id", "video_id")
    return by_cursor.unionByName(H.new_entries(rows, ch, WINDOW).select(F.lit("window").alias("rule"), "channel_id", "video_id"))


CURSORS = """moved AS (SELECT channel_id, arg_max(video_id, published) AS v, max(published) AS p FROM listing GROUP BY 1)"""


@query("advance_cursor", with_tables(C.LISTING, C.CHANNELS, CURSORS) + """
SELECT FALSE AS override, channel_id, coalesce(v, last_seen_video_id) AS last_seen_video_id, CAST(epoch_us(coalesce(p, last_seen_published)) AS BIGINT) AS at FROM channels LEFT JOIN moved USING (channel_id)
UNION ALL SELECT TRUE, channel_id, CASE WHEN last_seen_published IS NULL THEN v ELSE last_seen_video_id END, CAST(epoch_us(coalesce(last_seen_published, p)) AS BIGINT) FROM channels LEFT JOIN moved USING (channel_id)""")
def advance_cursor(spark, folder):
    ch = channels(spark, folder)
    fresh = listing(spark, folder)
    parts = [
        H.advance_cursor(ch, fresh, is_override=o, kept=fresh).select(
            F.lit(o).alias("override"), "channel_id", "last_seen_video_id", F.unix_micros("last_seen_published").alias("at")
        )
        for o in (False, True)
    ]
    return parts[0].unionByName(parts[1])


# --- runs and batches --------------------------------------------------------

def history(spark, folder):
    return events(spark, folder).select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("string")).alias("id"), F.col("event_type").alias("type"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.floor("value").alias("videos_found"),
    )


HISTORY = """history AS (SELECT 'r' || (event_id // 2) AS id, event_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, CAST(floor(value) AS BIGINT) AS videos_found FROM events)"""


@query("list_runs", with_tables(HISTORY) + "SELECT * FROM history WHERE type = 'purchase' ORDER BY timestamp DESC, id LIMIT 100")
def list_runs(spark, folder):
    return H.list_runs(history(spark, folder), "purchase", 100)


@query("get_run", with_tables(HISTORY) + "SELECT * FROM history WHERE id = 'r77' ORDER BY timestamp DESC LIMIT 1")
def get_run(spark, folder):
    return H.get_run(history(spark, folder), "r77")


@query("run_status", "SELECT CASE WHEN value < 20 THEN 'failed' WHEN event_type <> 'view' AND value < 40 THEN 'partial' ELSE 'ok' END AS status, count(*) AS runs FROM events GROUP BY 1")
def run_status(spark, folder):
    runs = events(spark, folder).select(
        (F.col("value") >= 20).alias("written"), (F.col("event_type") != "view").alias("asked"), (F.col("value") >= 40).alias("analysed")
    )
    return runs.groupBy(H.run_status("written", "asked", "analysed").alias("status")).agg(F.count("*").alias("runs"))


@query("latest_batch", "SELECT arg_max(event_type || event_id, ts) AS batch, CAST(epoch_us(max(ts)) AS BIGINT) AS modified FROM events")
def latest_batch(spark, folder):
    rows = events(spark, folder).select(F.concat("event_type", F.col("event_id").cast("string")).alias("batch"), F.col("ts").cast("timestamp").alias("modified"))
    return H.latest_batch(rows).select("batch", F.unix_micros("modified").alias("modified"))


@query("batch_outcome", with_tables(STATUSES, FAILURES) + """,
s AS (SELECT batch, CASE WHEN batch IN ('src1', 'src2') THEN 'Smart' ELSE 'groq' END AS backend, CASE WHEN index % 2 = 0 THEN 'failed' ELSE status END AS status FROM statuses)
SELECT batch, backend, count(*) FILTER (status <> 'failed') AS ok, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'failed') / count(*), 9) AS fail_share,
       backend <> 'Smart' AND count(*) >= 2 AND count(*) FILTER (status = 'failed') / count(*) >= 0.5 AS suggest_smart FROM s GROUP BY 1, 2""")
def batch_outcome(spark, folder):
    rows = statuses(C.table(spark, folder, "documents")).select(
        "batch", F.when(F.col("batch").isin("src1", "src2"), "Smart").otherwise("groq").alias("backend"),
        F.when(F.col("index") % 2 == 0, "failed").otherwise(F.col("status")).alias("status"),
    )
    return B.batch_outcome(rows).withColumn("fail_share", F.round("fail_share", 9))


@query("cap_reached", with_tables(C.LISTING, C.CHANNELS) + """
SELECT channel_id, handle AS label, found FROM (SELECT channel_id, count(*) AS found FROM listing GROUP BY 1) JOIN channels USING (channel_id) WHERE found >= 60""")
def cap_reached(spark, folder):
    return H.cap_reached(listing(spark, folder), channels(spark, folder), 60)


@query("date_window", with_tables(C.LISTING) + """
SELECT asked, video_id FROM listing JOIN (VALUES ('days', DATE '2024-01-15', DATE '2024-01-25'), ('between', DATE '2024-01-05', DATE '2024-01-09'), ('since', DATE '2024-01-20', DATE '2024-01-25')) AS w(asked, a, b)
ON CAST(published AS DATE) BETWEEN a AND b""")
def date_window(spark, folder):
    from datetime import date

    rows = listing(spark, folder).withColumn("upload_date", F.to_date("published"))
    today = date(2024, 1, 25)
    windows = {"days": T.date_window(days=10, today=today), "between": T.date_window(since=date(2024, 1, 5), until=date(2024, 1, 9)), "since": T.date_window(since=date(2024, 1, 20), today=today)}
    found = [T.candidates_in_window(rows, w).select(F.lit(name).alias("asked"), "video_id") for name, w in windows.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
