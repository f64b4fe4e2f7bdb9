"""Queries over text columns: urls, times, languages, claims, facts, responses, prompts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkframe.functions import columns as X
from talkframe.operators import claims as K
from talkframe.operators import responses as R
from talkframe.plans import corpus as C
from talkframe.plans.registry import query, sql_duration, sql_pieces, with_tables


def documents(spark, folder):
    return C.table(spark, folder, "documents")


URLS = """urls AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'https://www.youtube.com/watch?v=abc' || event_id || '&t=3' WHEN 1 THEN 'youtu.be/xy_' || event_id WHEN 2 THEN 'https://instagram.com/reel/Q-' || event_id || '/'
  WHEN 3 THEN 'https://www.tiktok.com/@user' || user_id || '/video/' || event_id WHEN 4 THEN 'https://www.youtube.com/@chan' || user_id WHEN 5 THEN 'HTTPS://WWW.INSTAGRAM.COM/some.user' || user_id || '/'
  WHEN 6 THEN 'https://www.tiktok.com/@user' || user_id WHEN 7 THEN 'https://example.org/' || event_type ELSE 'https://vm.tiktok.com/Z' || event_id END AS url FROM events)"""


def urls(spark, folder):
    e, u, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_id") % 9
    url = (
        F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v=abc"), e, F.lit("&t=3")))
        .when(kind == 1, F.concat(F.lit("youtu.be/xy_"), e))
        .when(kind == 2, F.concat(F.lit("https://instagram.com/reel/Q-"), e, F.lit("/")))
        .when(kind == 3, F.concat(F.lit("https://www.tiktok.com/@user"), u, F.lit("/video/"), e))
        .when(kind == 4, F.concat(F.lit("https://www.youtube.com/@chan"), u))
        .when(kind == 5, F.concat(F.lit("HTTPS://WWW.INSTAGRAM.COM/some.user"), u, F.lit("/")))
        .when(kind == 6, F.concat(F.lit("https://www.tiktok.com/@user"), u))
        .when(kind == 7, F.concat(F.lit("https://example.org/"), F.col("event_type")))
        .otherwise(F.concat(F.lit("https://vm.tiktok.com/Z"), e))
    )
    return C.table(spark, folder, "events").select("event_id", url.alias("url"))


@query("platform_of", with_tables(URLS) + """SELECT event_id, CASE WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN contains(lower(url), 'instagram.com') THEN 'instagram'
  WHEN contains(lower(url), 'tiktok.com') THEN 'tiktok' ELSE 'unknown' END AS platform FROM urls""")
def platform_of(spark, folder):
    return urls(spark, folder).select("event_id", X.platform_of("url").alias("platform"))


@query("video_codes", with_tables(URLS) + r"""SELECT event_id, nullif(regexp_extract(url, '(?i)^(?:https?://)?(?:www\.)?(?:youtube\.com/(?:watch\?v=|shorts/|embed/)|youtu\.be/)([\w\-]+)', 1), '') AS youtube,
  nullif(regexp_extract(url, '(?i)^(?:https?://)?(?:www\.)?instagram\.com/(?:p|reel|tv|reels)/([\w\-]+)', 1), '') AS instagram FROM urls""")
def video_codes(spark, folder):
    return urls(spark, folder).select("event_id", X.youtube_id("url").alias("youtube"), X.instagram_shortcode("url").alias("instagram"))


@query("channel_kind", with_tables(URLS) + """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'youtube:post' WHEN 1 THEN 'youtube:post' WHEN 2 THEN 'instagram:post' WHEN 3 THEN 'tiktok:post' WHEN 4 THEN 'youtube:profile'
  WHEN 5 THEN 'instagram:profile' WHEN 6 THEN 'tiktok:profile' WHEN 8 THEN 'tiktok:post' END AS kind FROM urls""")
def channel_kind(spark, folder):
    return urls(spark, folder).select("event_id", X.channel_kind("url").alias("kind"))


ERRORS = """errors AS (SELECT event_id, ['youtube', 'instagram', 'tiktok', 'unknown'][event_id % 4 + 1] AS platform,
  ['Sign in to confirm you''re not a bot', 'HTTP Error 403: Forbidden', 'HTTP error 429', 'Read timed out.', 'This account is private', 'IpBlocked by host', 'API_KEY missing', 'other ' || event_type, 'Video unavailable', 'RESOURCE_EXHAUSTED', 'subtitles unavailable'][user_id % 11 + 1] AS stderr,
  ['download', 'backend', 'write'][event_id % 3 + 1] AS stage FROM events)"""


def errors(spark, folder):
    messages = ["Sign in to confirm you're not a bot", "HTTP Error 403: Forbidden", "HTTP error 429", "Read timed out.", "This account is private", "IpBlocked by host",
                "API_KEY missing", None, "Video unavailable", "RESOURCE_EXHAUSTED", "subtitles unavailable"]
    texts = F.array(*[F.concat(F.lit("other "), F.col("event_type")) if m is None else F.lit(m) for m in messages])
    return C.table(spark, folder, "events").select(
        "event_id", F.get(F.array(*[F.lit(p) for p in ("youtube", "instagram", "tiktok", "unknown")]), (F.col("event_id") % 4).cast("int")).alias("platform"),
        F.get(texts, (F.col("user_id") % 11).cast("int")).alias("stderr"),
        F.get(F.array(F.lit("download"), F.lit("backend"), F.lit("write")), (F.col("event_id") % 3).cast("int")).alias("stage"),
    )


@query("classify_errors", with_tables(ERRORS) + """,
c AS (SELECT *, lower(stderr) AS s FROM errors)
SELECT event_id, CASE WHEN platform = 'youtube' AND contains(s, 'sign in to confirm') THEN 'anti_bot' WHEN platform = 'youtube' AND contains(s, 'video unavailable') THEN 'video_unavailable'
  WHEN platform = 'instagram' AND contains(s, 'this account is private') THEN 'login_required' WHEN platform <> 'unknown' AND contains(s, 'http error 403') THEN 'anti_bot'
  WHEN platform <> 'unknown' AND contains(s, 'http error 429') THEN 'rate_limit' WHEN contains(s, 'timed out') THEN 'network' ELSE 'unknown' END AS error_class,
  (platform = 'youtube' AND contains(s, 'sign in to confirm')) OR (platform = 'instagram' AND contains(s, 'this account is private')) OR (platform <> 'unknown' AND (contains(s, 'http error 403') OR contains(s, 'http error 429'))) AS retryable FROM c""")
def classify_errors(spark, folder):
    return R.classify_errors(errors(spark, folder)).select("event_id", "error_class", "retryable")


@query("failure_hint", with_tables(ERRORS) + """
SELECT event_id, CASE WHEN contains(lower(stderr), 'ipblocked') THEN 'add_cookies_or_use_smart_backend' WHEN contains(lower(stderr), 'subtitles unavailable') THEN 'use_smart_backend'
  WHEN stage = 'download' AND (contains(stderr, '403') OR contains(lower(stderr), 'bot') OR contains(lower(stderr), 'sign in')) THEN 'add_cookies'
  WHEN stage = 'backend' AND contains(lower(stderr), 'api_key') THEN 'set_api_key' WHEN contains(lower(stderr), 'resource_exhausted') OR contains(stderr, '429') THEN 'quota_wait_or_use_smart_backend' END AS hint FROM errors""")
def failure_hint(spark, folder):
    return errors(spark, folder).select("event_id", X.failure_hint("stage", "stderr").alias("hint"))


LATIN, CYRILLIC, KANA = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
HEBREW, DIGITS = "אבגדהוזחטיכלמנסעפצקרשתםןףץ", "12345678901234567890123456"
MIXED = f"""mixed AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN translate(text, '{LATIN}', '{CYRILLIC}') WHEN 1 THEN translate(text, '{LATIN}', '{KANA}')
  WHEN 2 THEN translate(lower(text), '{LATIN}', '{DIGITS}') WHEN 3 THEN translate(text, '{LATIN}', '{HEBREW}') ELSE text END AS t FROM documents)"""


def mixed(spark, folder):
    k = F.col("doc_id") % 5
    t = (
        F.when(k == 0, F.translate("text", LATIN, CYRILLIC)).when(k == 1, F.translate("text", LATIN, KANA))
        .when(k == 2, F.translate(F.lower("text"), LATIN, DIGITS)).when(k == 3, F.translate("text", LATIN, HEBREW)).otherwise(F.col("text"))
    )
    return documents(spark, folder).select("doc_id", "lang", t.alias("t"))


SCRIPTS = """counted AS (SELECT doc_id, lang, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS cyr, length(regexp_replace(t, '[^一-鿿぀-ゟ゠-ヿ가-힯]', '', 'g')) AS cjk,
  length(regexp_replace(t, '[^؀-ۿ֐-׿]', '', 'g')) AS ara, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS lat FROM mixed),
scripts AS (SELECT doc_id, lang, CASE greatest(cyr, cjk, ara, lat) WHEN 0 THEN NULL WHEN cyr THEN 'cyrillic' WHEN cjk THEN 'cjk' WHEN ara THEN 'arabic' ELSE 'latin' END AS script FROM counted)"""


@query("script_of", with_tables(MIXED, SCRIPTS) + "SELECT doc_id, script FROM scripts")
def script_of(spark, folder):
    return mixed(spark, folder).select("doc_id", X.script_of("t").alias("script"))


@query("anchor_language", with_tables(MIXED, SCRIPTS) + """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr' WHEN script = 'cyrillic' THEN 'ru' WHEN script = 'latin' THEN 'fr' WHEN script = 'arabic' THEN 'fa' ELSE 'ru' END AS anchor FROM scripts""")
def anchor_language(spark, folder):
    langs = F.array(F.lit("ru"), F.lit("fr"), F.lit("fa"), F.lit("en2"))
    return mixed(spark, folder).select("doc_id", X.anchor_language("lang", "t", langs).alias("anchor"))


@query("slug", r"""
SELECT doc_id, CASE WHEN s = '' THEN 'memory' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[_ ]', '-', 'g'), '[^a-z0-9\-]+', '', 'g'), '-{2,}', '-', 'g'), '-') AS s FROM documents)""")
def slug(spark, folder):
    return documents(spark, folder).select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("parse_timestamp", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90) * 60 + user_id % 60 WHEN 1 THEN (event_id % 5) * 3600 + (user_id % 60) * 60 + 7.5 WHEN 2 THEN floor(value) END::DOUBLE AS seconds FROM events""")
def parse_timestamp(spark, folder):
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat_ws(":", (e % 90).cast("string"), (u % 60).cast("string"))).when(k == 1, F.concat_ws(":", (e % 5).cast("string"), (u % 60).cast("string"), F.lit("7.5")))
        .when(k == 2, F.floor("value").cast("string")).when(k == 3, F.lit("1::3")).otherwise(F.lit("-4"))
    )
    return C.table(spark, folder, "events").select("event_id", X.parse_timestamp(text).alias("seconds"))


@query("report_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'tutorial' WHEN 'click' THEN 'vlog' ELSE 'generic' END AS report_type FROM events")
def report_type(spark, folder):
    kind = F.when(F.col("event_type") == "view", "code").when(F.col("event_type") == "click", "vlog").when(F.col("event_type") == "error", "lecture")
    return C.table(spark, folder, "events").select("event_id", X.report_type(kind).alias("report_type"))


@query("format_duration", f"SELECT doc_id, {sql_duration('d')} AS shown FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars // 3 END AS d FROM documents)")
def format_duration(spark, folder):
    seconds = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("n_chars") / 3))
    return documents(spark, folder).select("doc_id", X.format_duration(seconds).alias("shown"))


@query("chunk_count", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN floor(l_extendedprice) <= 20000 THEN 1 ELSE greatest(2, (CAST(floor(l_extendedprice) AS BIGINT) + 18999) // 19000) END::BIGINT AS pieces FROM lineitem")
def chunk_count(spark, folder):
    return C.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.chunk_count(F.floor("l_extendedprice"), F.lit(20000)).alias("pieces"))


@query("parse_yyyymmdd", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_yyyymmdd(spark, folder):
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    k = F.col("o_orderkey") % 8
    text = F.when(k == 0, F.concat(digits, F.lit("0"))).when(k == 4, F.lit("20241399")).otherwise(digits)
    return C.table(spark, folder, "orders").select("o_orderkey", X.parse_yyyymmdd(text).cast("string").alias("day"))


# --- claims and facts --------------------------------------------------------

CAPTIONS = """captions AS (SELECT doc_id, text || ' see https://ex.org/a' || doc_id % 7 || '). «' || lang || ' ' || source || '» “' || lang || ' ' || source || '” ' || doc_id AS caption FROM documents)"""
# Separators are doubled so that neighbouring numbers do not share one.
CLAIMS = r"""urls AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(caption, 'https?://\S+|(?:[\p{L}\p{N}_-]+\.)+[\p{L}\p{N}_-]{2,}/[^\s)\]»"''”’]*')), '[.,);\]]+$', '') AS v FROM captions),
blank AS (SELECT doc_id, regexp_replace(regexp_replace(caption, 'https?://\S+|(?:[\p{L}\p{N}_-]+\.)+[\p{L}\p{N}_-]{2,}/[^\s)\]»"''”’]*', '_', 'g'), '([^\p{L}\p{N}_.,\s])', '\1\1', 'g') AS t FROM captions),
numbers AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_.])([+\-]?\d+(?:[.,\s]\d+)*%?)(?:$|[^\p{L}\p{N}_])', 1)) AS v FROM blank),
terms AS (SELECT doc_id, unnest(regexp_extract_all(caption, '«([^»]{2,})»|“([^”]{2,})”|"([^"]{2,})"', 0)) AS v FROM captions),
found AS (SELECT doc_id, 'url' AS kind, lower(v) AS k FROM urls UNION SELECT doc_id, 'term', trim(lower(regexp_replace(substr(v, 2, length(v) - 2), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) FROM terms)"""


def captions(spark, folder):
    name = F.concat("lang", F.lit(" "), "source")
    return documents(spark, folder).select(
        "doc_id", F.concat(
            "text", F.lit(" see https://ex.org/a"), (F.col("doc_id") % 7).cast("string"), F.lit("). «"), name, F.lit("» “"), name, F.lit("” "), F.col("doc_id").cast("string")
        ).alias("caption"),
    )


@query("extract_claims", with_tables(CAPTIONS, CLAIMS) + "SELECT doc_id, kind, k AS key FROM found WHERE k <> ''")
def extract_claims(spark, folder):
    return K.extract_claims(captions(spark, folder), ["doc_id"]).filter("kind <> 'number'").select("doc_id", "kind", "key")


@query("extract_number_claims", with_tables(CAPTIONS, CLAIMS) + r"""
SELECT DISTINCT doc_id, trim(regexp_replace(v, '[^0-9.]', '', 'g'), '.') AS key FROM numbers n
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = n.doc_id AND f.kind = 'url' AND f.k = trim(regexp_replace(v, '[^0-9.]', '', 'g'), '.'))""")
def extract_number_claims(spark, folder):
    return K.extract_claims(captions(spark, folder), ["doc_id"]).filter("kind = 'number'").select("doc_id", "key")


@query("canon_number", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(regexp_replace('$' || printf('%.2f', l_extendedprice) || ' +' || l_linenumber || '%.', '[^0-9.]', '', 'g'), '.') AS canon FROM lineitem")
def canon_number(spark, folder):
    shown = F.concat(F.lit("$"), F.format_string("%.2f", F.col("l_extendedprice")), F.lit(" +"), F.col("l_linenumber").cast("string"), F.lit("%."))
    return C.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.canon_number(shown).alias("canon"))


@query("phrase_confirmed", r"""
WITH n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT doc_id, item_id, trim(lower(regexp_replace(b.text, '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS phrase, trim(lower(regexp_replace(coalesce(d.text, ''), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS blob FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n),
l AS (SELECT doc_id, phrase, list_distinct(string_split(blob, ' ')) AS listed FROM p),
w AS (SELECT doc_id, listed, unnest(string_split(phrase, ' ')) AS w FROM l),
h AS (SELECT doc_id, len([b FOR b IN listed IF b <> '' AND (contains(b, w) OR contains(w, b) OR (least(length(w), length(b)) >= 4 AND left(w, CAST(ceil(least(length(w), length(b)) * 0.75) AS INT)) = left(b, CAST(ceil(least(length(w), length(b)) * 0.75) AS INT))))]) > 0 AS hit FROM w WHERE length(w) >= 3),
e AS (SELECT doc_id, count(*) FILTER (hit) >= 0.7::DOUBLE * count(*) AS enough FROM h GROUP BY doc_id)
SELECT p.doc_id, item_id, phrase = '' OR contains(blob, phrase) OR coalesce(enough, FALSE) AS confirmed FROM p LEFT JOIN e USING (doc_id)""")
def phrase_confirmed(spark, folder):
    """One benchmark text looked for in the whole of each document."""
    items = C.table(spark, folder, "benchmark")
    count = items.agg(F.count("*").alias("n"))
    docs = documents(spark, folder).select("doc_id", X.compare_key(F.coalesce("text", F.lit(""))).alias("blob"))
    docs = docs.withColumn("listed", F.array_distinct(X.words(F.col("blob")))).join(count, F.lit(True)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    return docs.join(items, "item_id").select("doc_id", "item_id", K.phrase_confirmed(F.col("text"), F.col("blob"), F.col("listed")).alias("confirmed"))


@query("phrase_confirmed_whole", with_tables(C.TRIGGERS, r"""d AS (SELECT doc_id, lang, trim(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS blob FROM documents),
b AS (SELECT doc_id, lang, blob, list_distinct(string_split(blob, ' ')) AS listed FROM d),
p AS (SELECT doc_id, kind, seq, blob, listed, trim(lower(regexp_replace(phrase, '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS phrase FROM b JOIN triggers t ON t.lang IN ('', b.lang)),
w AS (SELECT doc_id, kind, seq, listed, unnest(string_split(phrase, ' ')) AS w FROM p),
h AS (SELECT doc_id, kind, seq, len([b FOR b IN listed IF b <> '' AND (contains(b, w) OR contains(w, b) OR (least(length(w), length(b)) >= 4 AND left(w, CAST(ceil(least(length(w), length(b)) * 0.75) AS INT)) = left(b, CAST(ceil(least(length(w), length(b)) * 0.75) AS INT))))]) > 0 AS hit FROM w WHERE length(w) >= 3),
n AS (SELECT doc_id, kind, seq, count(*) FILTER (hit) >= 0.7::DOUBLE * count(*) AS enough FROM h GROUP BY 1, 2, 3)""") + "SELECT doc_id, kind, seq, phrase = '' OR contains(blob, phrase) OR coalesce(enough, FALSE) AS confirmed FROM p LEFT JOIN n USING (doc_id, kind, seq)")
def phrase_confirmed_whole(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.col("lang").alias("own_lang"), X.compare_key(F.coalesce("text", F.lit(""))).alias("blob"))
    docs = docs.withColumn("listed", F.array_distinct(X.words(F.col("blob"))))
    found = docs.join(F.broadcast(C.triggers(spark)), (F.col("lang") == "") | (F.col("lang") == F.col("own_lang")))
    return found.select("doc_id", "kind", "seq", K.phrase_confirmed(F.col("phrase"), F.col("blob"), F.col("listed")).alias("confirmed"))


@query("caption_images", """
SELECT source AS report_id, doc_id, lang || ' ' || n_chars AS caption, CASE WHEN doc_id % 5 = 0 THEN '../' ELSE '' END || 'f/' || doc_id || '.jpg' AS image,
       CASE WHEN doc_id % 5 = 0 THEN 'path traversal rejected' WHEN doc_id % 3 = 0 THEN 'image file not found' END AS issue FROM documents WHERE doc_id % 7 <> 0""")
def caption_images(spark, folder):
    docs = documents(spark, folder)
    doc = F.col("doc_id").cast("string")
    image = F.concat(F.when(F.col("doc_id") % 5 == 0, "../").otherwise(""), F.lit("f/"), doc, F.lit(".jpg"))
    line = F.concat(F.lit("text ![ "), F.when(F.col("doc_id") % 7 != 0, F.concat("lang", F.lit(" "), F.col("n_chars").cast("string"))).otherwise(F.lit("")), F.lit("]("), image, F.lit(") ![x](data:abc)\n"))
    reports = docs.groupBy("source", F.floor(F.col("doc_id") / 50).alias("page")).agg(F.array_join(F.collect_list(line), "").alias("markdown"))
    images = docs.filter("doc_id % 3 <> 0").select(F.col("source").alias("report_id"), image.alias("image"))
    found = K.caption_images(reports.select(F.col("source").alias("report_id"), "markdown"), images)
    return found.select("report_id", F.regexp_extract("image", r"(\d+)\.jpg", 1).cast("long").alias("doc_id"), "caption", "image", "issue")


VERDICTS = """v AS (SELECT DISTINCT l_orderkey AS report_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS image, l_linenumber % 4 AS k, l_partkey FROM lineitem),
verdicts AS (SELECT report_id, image, kind, CASE kind WHEN 'number' THEN ['ok', 'transcript_grounded', 'hallucination', 'ok'][k + 1] WHEN 'url' THEN ['ok', 'transcript_grounded', 'hallucination', 'hallucination'][k + 1]
  ELSE ['ok', 'ok', 'unconfirmed', 'ok'][k + 1] END AS verdict FROM v, (VALUES ('number'), ('url'), ('term')) AS x(kind))"""


@query("ground_claims", with_tables(VERDICTS) + "SELECT report_id, image, kind, verdict FROM verdicts")
def ground_claims(spark, folder):
    k = F.col("l_linenumber") % 4
    keys, image = ["report_id", "image"], F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    lines = C.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey", image)
    items = lines.select(F.col("l_orderkey").alias("report_id"), image.alias("image"), k.alias("k"), (F.col("l_partkey") + 1000).cast("string").alias("n")).distinct()
    caption = F.concat(F.lit("shows "), F.col("n"), F.lit("% at «vector search» in arxiv.org/abs/"), F.col("n"))
    nothing = F.array().cast("array<string>")
    on_frame = F.col("k").isin(0, 3)
    atoms = items.select(
        *keys, F.when(F.col("k") == 0, F.array(F.col("n"))).otherwise(nothing).alias("numbers"),
        F.when(F.col("k") == 0, F.array(F.concat(F.lit("https://arxiv.org/abs/"), F.col("n")))).otherwise(nothing).alias("urls"),
        F.when(on_frame, F.array(F.concat(F.lit("router.py "), F.col("n"), F.lit(" vectors searching")))).otherwise(nothing).alias("terms"),
    )
    said = F.when(F.col("k") == 1, F.concat(F.lit("we did vector search with "), F.col("n"), F.lit(", see arxiv.org/abs/"), F.col("n"))).otherwise(F.lit("nothing"))
    found = K.ground_claims(items.select(*keys, caption.alias("caption")), atoms, items.select(*keys, said.alias("transcript")))
    return found.select(*keys, "kind", "verdict")


@query("grounding_issues", with_tables(VERDICTS) + """
SELECT report_id, image, count(*) FILTER (verdict = 'hallucination') AS hallucination, count(*) FILTER (verdict = 'transcript_grounded') AS transcript_grounded, count(*) FILTER (verdict = 'unconfirmed') AS unconfirmed,
  CASE WHEN bool_or(verdict = 'hallucination') THEN 'hallucination' WHEN bool_or(verdict = 'transcript_grounded') THEN 'transcript_grounded' ELSE 'unconfirmed' END AS severity, bool_or(verdict = 'hallucination') AS blocking
FROM verdicts WHERE verdict <> 'ok' GROUP BY 1, 2""")
def grounding_issues(spark, folder):
    return K.grounding_issues(ground_claims(spark, folder))


@query("novel_facts", r"""
WITH lines AS (SELECT lang AS memory, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS key FROM lines)
SELECT memory, doc_id, i, text FROM k a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id % 2 = 1 AND b.memory = a.memory AND b.key = a.key)""")
def novel_facts(spark, folder):
    lines = documents(spark, folder).select(F.col("lang").alias("memory"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("i", F.col("i") + 1)
    return K.novel_facts(lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1"))


FACTS = """facts AS (SELECT event_type AS memory, event_id AS fact_idx, CASE WHEN user_id % 3 = 0 THEN '  ' ELSE 'topic ' || user_id % 5 END AS topic, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE ' fact ' || event_id END AS text,
  CASE WHEN user_id % 4 <> 0 THEN 'https://s/' || user_id END AS source_url, CASE WHEN event_id % 2 = 0 THEN '00:' || event_id % 60 END AS source_timestamp FROM events)"""


def facts(spark, folder):
    u, e = F.col("user_id"), F.col("event_id")
    return C.table(spark, folder, "events").select(
        F.col("event_type").alias("memory"), e.alias("fact_idx"), F.when(u % 3 == 0, "  ").otherwise(F.concat(F.lit("topic "), (u % 5).cast("string"))).alias("topic"),
        F.when(e % 17 == 0, " ").otherwise(F.concat(F.lit(" fact "), e.cast("string"))).alias("text"), F.when(u % 4 != 0, F.concat(F.lit("https://s/"), u.cast("string"))).alias("source_url"),
        F.when(e % 2 == 0, F.concat(F.lit("00:"), (e % 60).cast("string"))).alias("source_timestamp"), (e % 10).alias("load_id"),
    )


@query("append_facts", with_tables(FACTS) + """,
clean AS (SELECT memory, coalesce(source_url, '(unknown source)') AS source_url, coalesce(nullif(trim(topic), ''), 'Notes') AS topic, trim(text) AS text, source_timestamp, fact_idx FROM facts WHERE trim(text) <> ''),
firsts AS (SELECT memory, source_url, topic, min(fact_idx) AS first, first(source_timestamp ORDER BY fact_idx) AS stamp FROM clean GROUP BY ALL),
p AS (
  SELECT memory, source_url, topic, first, 0 AS side, 0 AS i, '## 2026-01-01 — ' || topic AS piece FROM firsts
  UNION ALL SELECT memory, source_url, topic, first, 1, fact_idx, chr(10) || '- ' || text FROM clean JOIN firsts USING (memory, source_url, topic)
  UNION ALL SELECT memory, source_url, topic, first, 2, 0, chr(10) || chr(10) || 'Source: ' || source_url || coalesce(' | ' || stamp, '') || chr(10) || 'Approved: 2026-01-01' || chr(10) FROM firsts)
""" + sql_pieces("p", "memory", "first, side, i", ", source_url, topic"))
def append_facts(spark, folder):
    return K.append_facts(facts(spark, folder), "2026-01-01").drop("section_date")


@query("count_sources", with_tables(FACTS) + """
SELECT memory, CAST(length(memory) + count(DISTINCT coalesce(source_url, '-') || ' ' || fact_idx % 10) AS BIGINT) AS sources FROM facts WHERE trim(text) <> '' GROUP BY memory""")
def count_sources(spark, folder):
    loads = facts(spark, folder)
    memories = loads.select("memory").distinct().withColumn("sources", F.length("memory"))
    return K.count_sources(memories, loads)


# --- responses and prompts ---------------------------------------------------

@query("parse_candidates", """
SELECT event_id AS response_id, f AS fact_idx, CASE WHEN f = 0 THEN event_type END AS topic, 'fact ' || user_id || '/' || f AS text FROM events, (VALUES (0), (1)) AS x(f) WHERE event_id % 4 <> 3""")
def parse_candidates(spark, folder):
    k = F.col("event_id") % 4
    user = F.col("user_id").cast("string")
    body = F.concat(
        F.lit('{"candidates": [{"topic": "'), F.col("event_type"), F.lit('", "text": "fact '), user, F.lit('/0"}, {"text": "fact '), user, F.lit('/1"}, {"topic": "x"}]}')
    )
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("I found "), body, F.lit(" ok"))).otherwise(F.lit("none {"))
    return R.parse_candidates(C.table(spark, folder, "events").select(F.col("event_id").alias("response_id"), raw.alias("raw"))).drop("source_timestamp")


@query("screen_rows", """
SELECT o_orderkey AS response_id, l_linenumber AS pos, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND l_linenumber IN (1, 3, 5)) OR (o_orderkey % 3 = 2 AND l_linenumber = 2)""")
def screen_rows(spark, folder):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, "no idea").when(k == 1, "```[1, 3, 5]``` are right [2]").otherwise("Selected: [2, 99]")
    rows = C.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey")
    known = C.table(spark, folder, "orders").select(F.col("o_orderkey").alias("response_id"), raw.alias("raw"))
    return R.screen_rows(rows.join(known.select("response_id"), "response_id"), known)


@query("parse_outlines", """
SELECT event_id AS response_id, CASE WHEN event_id % 3 = 2 THEN 'Outline parse failed' ELSE 'T' || user_id END AS title, CASE WHEN event_id % 3 = 2 THEN 'Raw model output' ELSE 'S1,S2' END AS names,
  CASE WHEN event_id % 3 = 2 THEN '' ELSE event_type || ',a,b' END AS points, CASE WHEN event_id % 3 = 2 THEN '' ELSE '00:01' END AS stamps FROM events""")
def parse_outlines(spark, folder):
    k = F.col("event_id") % 3
    body = F.concat(
        F.lit('{"title": "T'), F.col("user_id").cast("string"), F.lit('", "summary": "s", "sections": [{"title": "S1", "key_points": "'), F.col("event_type"),
        F.lit('", "timestamps": ["[00:01]"]}, {"title": "S2", "key_points": ["a", null, "b"]}]}'),
    )
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("not json at all"))
    out = R.parse_outlines(C.table(spark, folder, "events").select(F.col("event_id").alias("response_id"), raw.alias("raw")))
    return out.select(
        "response_id", "title", F.array_join(F.col("sections.title"), ",").alias("names"), F.array_join(F.flatten(F.col("sections.key_points")), ",").alias("points"),
        F.array_join(F.flatten(F.col("sections.timestamps")), ",").alias("stamps"),
    )


@query("assemble_outline", """
WITH heads AS (SELECT conv_id, arg_min(role || ' ' || turn, turn) AS title, left(string_agg(text, ' ' ORDER BY turn), 500) AS summary, count(*) AS source_chunks FROM conversations GROUP BY conv_id)
SELECT conv_id AS video_id, title, summary, source_chunks, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) - 1 AS position, 's' || turn || x AS section
FROM conversations JOIN heads USING (conv_id), (VALUES ('a'), ('b')) AS s(x)""")
def assemble_outline(spark, folder):
    turn = F.col("turn").cast("string")
    outlines = C.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("chunk"), F.concat("role", F.lit(" "), turn).alias("title"), F.col("text").alias("summary"),
        F.array(F.concat(F.lit("s"), turn, F.lit("a")), F.concat(F.lit("s"), turn, F.lit("b"))).alias("sections"),
    )
    return R.assemble_outline(outlines)


@query("split_fixed", """
SELECT doc_id, CAST(i AS INTEGER) AS piece_idx, substr(text, i * 300 + 1, 300) AS piece FROM documents, unnest(range((length(text) + 299) // 300)) AS u(i)""")
def split_fixed(spark, folder):
    return R.split_texts(documents(spark, folder), 300, ["doc_id"])


@query("prompt_pack", """
WITH v AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, doc_id, lang, n_chars, text FROM documents),
b AS (SELECT source, doc_id, pos, '### [' || doc_id || '] doc ' || doc_id || ' (' || CASE WHEN doc_id % 3 <> 0 THEN '2024-01-02, ' ELSE '' END || CASE WHEN n_chars // 15 >= 3600 THEN 'long' ELSE printf('%d:%02d', n_chars // 15 // 60, n_chars // 15 % 60) END || ', ' || lang || ')'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Source: u' || doc_id ELSE '' END || chr(10) || chr(10) || CASE WHEN length(text) <= 400 THEN text ELSE rtrim(left(text, 400)) || chr(10) || '[...truncated...]' END || chr(10) || chr(10) || '---' || chr(10) AS block FROM v)
, p AS (SELECT source AS pack_id, pos, CASE WHEN pos > 1 THEN chr(10) ELSE '' END || block AS piece FROM b)
""" + sql_pieces("p", "pack_id", "pos"))
def prompt_pack(spark, folder):
    doc = F.col("doc_id").cast("string")
    videos = documents(spark, folder).select(
        F.col("source").alias("pack_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("doc "), doc).alias("title"), F.lit("stem").alias("stem"),
        F.when(F.col("doc_id") % 3 != 0, "2024-01-02").alias("upload_date"), F.floor(F.col("n_chars") / 15).alias("duration_sec"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), doc)).alias("url"), F.col("text").alias("body"),
    )
    return R.prompt_pack(videos, 400)


@query("apply_segment_replies", with_tables(C.TALK) + """
SELECT video_id, seg_idx, start, "end", CASE WHEN video_id % 4 IN (0, 1) THEN text || ' (sic)' ELSE text END AS text FROM talk""")
def apply_segment_replies(spark, folder):
    """Replies plain, in a fence, one item short, and no JSON at all."""
    talk = C.talk_segments(C.table(spark, folder, "conversations"))
    item = F.struct("seg_idx", F.struct("start", "end", F.concat("text", F.lit(" (sic)")).alias("text")).alias("s"))
    listed = talk.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("_i")).select("video_id", F.col("_i.s").alias("_i"))
    body = F.to_json("_i")
    k = F.col("video_id") % 4
    raw = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .when(k == 2, F.to_json(F.slice("_i", F.lit(2), F.size("_i")))).otherwise(F.concat(F.lit("Here it is: "), body))
    )
    return R.apply_segment_replies(talk, listed.select("video_id", raw.alias("raw")))


@query("screening_prompts", with_tables("""p AS (
  SELECT o_orderkey AS response_id, 0 AS side, 0 AS i, 'Choose the videos of the list that fit what the user asks for.' || chr(10) || chr(10) || 'User asks for: ' || o_orderstatus || chr(10) || chr(10) || 'Candidates, numbered from 1:' AS piece FROM orders
  UNION ALL SELECT l_orderkey, 1, pos, chr(10) || '[' || pos || '] part ' || l_partkey || ' — ' || CASE WHEN l_suppkey % 3 = 0 THEN '?' ELSE 'ch ' || l_suppkey END || ' — ' || l_shipdate || ' — ' || printf('%d:%02d', CAST(q AS BIGINT) // 60, CAST(q AS BIGINT) % 60)
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_quantity * 7 AS q FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(CAST(l_shipdate AS DATE)) AS l_shipdate, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3, 4)) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT o_orderkey, 2, 0, chr(10) || chr(10) || 'Answer with a JSON array of their numbers and nothing else, for example [1, 3, 5].' FROM orders)""") + sql_pieces("p", "response_id", "side, i"))
def screening_prompts(spark, folder):
    # Dealt by order once, for the groups and for the places.
    lines = C.table(spark, folder, "lineitem").repartition("l_orderkey")
    items = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("upload_date"), F.min("l_quantity").alias("q"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    candidates = items.select(
        F.col("l_orderkey").alias("response_id"), place.alias("pos"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("ch "), F.col("l_suppkey").cast("string"))).alias("channel"), "upload_date", (F.col("q") * 7).cast("long").alias("duration_sec"),
    )
    requests = C.table(spark, folder, "orders").select(F.col("o_orderkey").alias("response_id"), F.col("o_orderstatus").alias("wanted"))
    return R.screening_prompts(candidates, requests)
