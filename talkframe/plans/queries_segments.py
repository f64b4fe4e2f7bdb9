"""Queries over segments: filters, quality, classifiers, matching, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import fixed_values as fixed
from talkframe.functions.columns import moment_kind
from talkframe.operators import detect as D
from talkframe.operators import intervals as I
from talkframe.operators import matching as M
from talkframe.operators import packs as P
from talkframe.operators import quality as Q
from talkframe.operators import responses as R
from talkframe.operators.tables import settled, small_table
from talkframe.plans import corpus as C
from talkframe.plans.registry import query, sql_clock, with_tables


def segments(spark, folder):
    return C.doc_segments(C.table(spark, folder, "documents"))


FILLERS = "(" + ", ".join("'" + p.replace("'", "''") + "'" for p in fixed.FILLER_PHRASES) + ")"


@query("filter_hallucinations", "WITH " + C.SEGS + f""",
n AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS clean,
             trim(regexp_replace(regexp_replace(lower(text), '[.,!?:;\\-–—…"''()\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM segs),
f AS (SELECT *, clean = '' OR plain IN {FILLERS} OR ("end" - start >= 5 AND length(clean) / ("end" - start) < 2
             AND len(list_distinct([left(w, 4) FOR w IN string_split(plain, ' ') IF w <> ''])) <= 2) AS is_hallucination FROM n)
SELECT video_id, seg_idx, text, is_hallucination FROM f""")
def filter_hallucinations(spark, folder):
    return Q.flag_hallucinations(segments(spark, folder)).select("video_id", "seg_idx", "text", "is_hallucination")


REPETITION = """trigrams AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, string_split_regex(trim(lower(text)), '\\s+') AS w FROM documents), unnest(range(1, len(w) - 1)) AS u(i)),
counted AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t, count(*) AS n FROM trigrams GROUP BY 1, 2),
repetition AS (SELECT d.doc_id, CASE WHEN len(string_split_regex(trim(text), '\\s+')) < 6 THEN 0::DOUBLE ELSE max(n) / sum(n) END AS rep
               FROM documents d LEFT JOIN counted c USING (doc_id) GROUP BY d.doc_id, text)"""


@query("trigram_repetition", with_tables(REPETITION) + "SELECT doc_id, round(rep, 9) AS repetition FROM repetition")
def trigram_repetition(spark, folder):
    docs = C.table(spark, folder, "documents")
    return docs.select("doc_id", F.round(Q.trigram_repetition("text"), 9).alias("repetition"))


MARKED = """marked AS (SELECT video_id, start, "end", CASE WHEN length(text) < 12 THEN '[Music]' ELSE text END AS text FROM segs),
music AS (SELECT video_id, coalesce(sum("end" - start) FILTER (regexp_matches(text, '(?i)\\[music\\]|\\[applause\\]|\\[laughter\\]|[\\[(]unintelligible[\\])]|♪')), 0) / sum("end" - start) AS music
          FROM marked GROUP BY video_id)"""


def marked(df):
    return df.withColumn("text", F.when(F.length("text") < 12, "[Music]").otherwise(F.col("text")))


@query("non_speech_ratio", with_tables(C.SEGS, MARKED) + "SELECT video_id, round(music, 9) AS music FROM music")
def non_speech_ratio(spark, folder):
    return Q.non_speech_ratio(marked(segments(spark, folder))).withColumn("music", F.round("music", 9))


OOV = """oov AS (
  SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN -1::DOUBLE WHEN count(t.word) = 0 THEN 1::DOUBLE
                        ELSE count(DISTINCT t.word) FILTER (v.n < 5) / count(t.word) END AS oov
  FROM documents d LEFT JOIN tokens t USING (doc_id) LEFT JOIN vocabulary v ON v.language = t.lang AND v.word = t.word GROUP BY d.doc_id, d.lang)"""
SUPPORTED = ["en", "fr", "es"]


def dictionary(docs):
    return C.vocabulary(docs).filter("n >= 5").select("language", "word")


@query("oov_ratio", with_tables(C.TOKENS, C.VOCABULARY, OOV) + "SELECT doc_id AS video_id, round(oov, 9) AS oov FROM oov")
def oov_ratio(spark, folder):
    docs = C.table(spark, folder, "documents")
    texts = docs.select(F.col("doc_id").alias("video_id"), F.col("lang").alias("language"), "text")
    return Q.oov_ratio(texts, dictionary(docs), SUPPORTED).withColumn("oov", F.round("oov", 9))


COVERAGE = """phrases AS (SELECT DISTINCT lower(text) AS phrase FROM benchmark UNION SELECT 'license' UNION SELECT 'the the'),
hits AS (SELECT doc_id, lower(d.text) AS t, phrase FROM documents d JOIN phrases ON contains(lower(d.text), phrase)),
places AS (SELECT doc_id, i AS place, length(phrase) AS n FROM hits, unnest(range(1, length(t) + 1)) AS u(i) WHERE substr(t, i, length(phrase)) = phrase),
covered AS (SELECT doc_id, count(DISTINCT place + j) AS c FROM places, unnest(range(n)) AS u(j) GROUP BY doc_id),
coverage AS (SELECT d.doc_id, coalesce(c, 0) / length(text) AS boh FROM documents d LEFT JOIN covered USING (doc_id))"""


def phrases(spark, folder):
    more = small_table(spark, [("license",), ("the the",)], "phrase string")
    return C.table(spark, folder, "benchmark").select(F.col("text").alias("phrase")).unionByName(more)


@query("phrase_coverage", with_tables(COVERAGE) + "SELECT doc_id AS video_id, round(boh, 9) AS boh FROM coverage")
def phrase_coverage(spark, folder):
    docs = C.table(spark, folder, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return Q.phrase_coverage(docs, phrases(spark, folder)).withColumn("boh", F.round("boh", 9))


QUALITY = with_tables(C.SEGS, MARKED, C.TOKENS, C.VOCABULARY, OOV, REPETITION, COVERAGE) + """,
v AS (SELECT doc_id, doc_id % 10 = 0 AS manual, music, oov, rep, boh, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 101) / 101::DOUBLE END AS ppl
      FROM documents JOIN music ON music.video_id = doc_id JOIN oov USING (doc_id) JOIN repetition USING (doc_id) JOIN coverage USING (doc_id)),
r AS (SELECT *, 1 - least(rep / 0.3::DOUBLE, 1::DOUBLE) AS hr, 1 - least(boh / 0.1::DOUBLE, 1::DOUBLE) AS hb, 1 - least(oov / 0.15::DOUBLE, 1::DOUBLE) AS ho FROM v),
b AS (SELECT *, CASE WHEN oov < 0 THEN 0.4::DOUBLE * hr + 0.4::DOUBLE * hb + 0.2::DOUBLE * 0.5::DOUBLE
                     ELSE 0.4::DOUBLE * ho + 0.3::DOUBLE * hr + 0.3::DOUBLE * hb END AS base FROM r),
report AS (SELECT doc_id, CASE WHEN manual THEN 1::DOUBLE WHEN music > 0.25 THEN 0.3::DOUBLE
             WHEN ppl IS NOT NULL THEN greatest(base - 0.25::DOUBLE * ppl, 0) ELSE base END AS score,
           CASE WHEN manual THEN '' WHEN music > 0.25 THEN 'mostly_music' ELSE concat_ws(',', CASE WHEN oov > 0.15 THEN 'high_oov' END,
             CASE WHEN rep > 0.3 THEN 'looped' END, CASE WHEN boh > 0.1 THEN 'boilerplate_hallucinations' END, CASE WHEN ppl > 0.5 THEN 'high_perplexity' END) END AS flags FROM b),
final AS (SELECT doc_id, score, flags, CASE WHEN score >= 0.6 THEN 'use_as_is' WHEN score >= 0.3::DOUBLE THEN 'fallback_recommended' ELSE 'low_quality' END AS recommendation FROM report)
"""


def _report(spark, folder):
    docs = C.table(spark, folder, "documents")
    videos = docs.select(
        F.col("doc_id").alias("video_id"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 10 == 0, "youtube_manual").otherwise("youtube_auto").alias("source"), "text",
        F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 101) / 101).alias("perplexity"),
    )
    return Q.quality_report(videos, marked(C.doc_segments(docs)), dictionary(docs), phrases(spark, folder), SUPPORTED)


@query("quality_report", QUALITY + "SELECT doc_id AS video_id, round(score, 6) AS score, flags, recommendation FROM final")
def quality_report(spark, folder):
    return _report(spark, folder).select("video_id", F.round("score", 6).alias("score"), F.array_join("flags", ",").alias("flags"), "recommendation")


@query("label_agreement", QUALITY + """
SELECT recommendation, quality, count(*) AS videos, round(avg(score), 6) AS mean_score FROM final JOIN labels USING (doc_id) GROUP BY 1, 2""")
def label_agreement(spark, folder):
    labels = C.table(spark, folder, "labels").select(F.col("doc_id").alias("video_id"), "quality")
    return Q.label_agreement(_report(spark, folder), labels).withColumn("mean_score", F.round("mean_score", 6))


# --- classifiers -------------------------------------------------------------

def edges(sql):
    """Word edges ``<`` and ``>`` around a pattern, for engines whose edges are ASCII only."""
    import re

    return re.sub(r"<([^<>']+)>(?=[|'])", r"(?:^|[^\\p{L}\\p{M}\\p{N}_])\1(?:$|[^\\p{L}\\p{M}\\p{N}_])", sql)


ACTIONS = ["\\bthe in\\b", "\\bof the\\b", "\\bde la\\b", "\\bder die\\b", "\\bthat it\\b"]
TYPES = [
    fixed.TypeRule("tutorial", 9.0, ("\\bthe the\\b", "\\bis (a|in|on)\\b")),
    fixed.TypeRule("code", 4.0, ("\\btoken\\b", "\\bit (to|at)\\b")),
    fixed.TypeRule("lecture", 6.0, ("\\bde la\\b", "\\bla de\\b")),
    fixed.TypeRule("demo", 6.0, ("\\bder (der|die)\\b",)),
    fixed.TypeRule("vlog", 5.0, ("\\bwith (the|a)\\b", "\\bque la\\b", "\\bles de\\b")),
]


@query("detect_tutorial", edges("WITH " + C.SEGS + """,
h AS (SELECT *, regexp_matches(text, '(?i)<the in>|<of the>|<de la>|<der die>|<that it>') AS hit FROM segs),
s AS (SELECT video_id, seg_idx, coalesce(nullif(regexp_extract(text, '(?i)<(the in)>', 1), ''), nullif(regexp_extract(text, '(?i)<(of the)>', 1), ''),
        nullif(regexp_extract(text, '(?i)<(de la)>', 1), ''), nullif(regexp_extract(text, '(?i)<(der die)>', 1), ''), nullif(regexp_extract(text, '(?i)<(that it)>', 1), '')) AS m,
        row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS nth FROM h WHERE hit),
g AS (SELECT video_id, string_agg(m, '|' ORDER BY seg_idx) AS samples FROM s WHERE nth <= 5 GROUP BY 1),
t AS (SELECT video_id, count(*) FILTER (hit) AS n, greatest(arg_max("end", seg_idx) / 60::DOUBLE, 0.1::DOUBLE) AS m FROM h GROUP BY 1)
SELECT video_id, m >= 0.5 AND n / m >= 1.5 AS is_tutorial, n AS action_count, round_even(m * 100, 0) / 100 AS duration_min,
       round_even(n / m * 100, 0) / 100 AS density_per_min, coalesce(samples, '') AS samples FROM t LEFT JOIN g USING (video_id)"""))
def detect_tutorial(spark, folder):
    out = D.detect_tutorial(segments(spark, folder), ACTIONS)
    return out.withColumn("samples", F.array_join("sample_matches", "|")).drop("sample_matches")


@query("detect_video_type", edges("WITH " + C.SEGS + """,
t AS (SELECT video_id, greatest(arg_max("end", seg_idx) / 60::DOUBLE, 0.1::DOUBLE) AS m,
  count(*) FILTER (regexp_matches(text, '(?i)<the the>|<is (a|in|on)>')) AS n1, count(*) FILTER (regexp_matches(text, '(?i)<token>|<it (to|at)>')) AS n2,
  count(*) FILTER (regexp_matches(text, '(?i)<de la>|<la de>')) AS n3, count(*) FILTER (regexp_matches(text, '(?i)<der (der|die)>')) AS n4,
  count(*) FILTER (regexp_matches(text, '(?i)<with (the|a)>|<que la>|<les de>')) AS n5 FROM segs GROUP BY 1),
s AS (SELECT *, least(n1 / m / 9, 5::DOUBLE) AS s1, least(n2 / m / 4, 5::DOUBLE) AS s2, least(n3 / m / 6, 5::DOUBLE) AS s3, least(n4 / m / 6, 5::DOUBLE) AS s4, least(n5 / m / 5, 5::DOUBLE) AS s5 FROM t),
w AS (SELECT *, greatest(s1, s2, s3, s4, s5) AS top FROM s)
SELECT video_id, CASE WHEN top >= 1 THEN CASE top WHEN s1 THEN 'tutorial' WHEN s2 THEN 'code' WHEN s3 THEN 'lecture' WHEN s4 THEN 'demo' ELSE 'vlog' END
         WHEN m >= 1 AND (n1 + n2 + n3 + n4 + n5) / m < 0.3 THEN 'talking_head' ELSE 'generic' END AS video_type,
       CASE WHEN top >= 1 THEN round_even(least(1::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * top) * 100, 0) / 100
            WHEN m >= 1 AND (n1 + n2 + n3 + n4 + n5) / m < 0.3 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS confidence,
       round_even(m * 100, 0) / 100 AS duration_min, n1 AS n_tutorial, n5 AS n_vlog, round_even(n3 / m * 100, 0) / 100 AS d_lecture FROM w"""))
def detect_video_type(spark, folder):
    out = D.detect_video_type(segments(spark, folder), TYPES)
    return out.select(
        "video_id", "video_type", "confidence", "duration_min", F.col("counts_per_type")["tutorial"].alias("n_tutorial"),
        F.col("counts_per_type")["vlog"].alias("n_vlog"), F.col("densities_per_type")["lecture"].alias("d_lecture"),
    )


KIND_ACTIONS, KIND_STEPS = fixed.ACTION_PATTERNS[22:], fixed.CONNECTIVE_PATTERNS[:12]


#: What speakers add to a line, by its place.
SAID = ["", " then click", " first select it, then press enter", " next step: finally open", " once you tap"]
SPOKEN = "spoken AS (SELECT video_id, seg_idx, text || [" + ", ".join(f"'{x}'" for x in SAID) + "][seg_idx % 5 + 1] AS text FROM segs)"


@query("classify_moment", "WITH " + C.SEGS + ", " + SPOKEN + ", k AS (SELECT video_id, seg_idx, "
       + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in KIND_ACTIONS) + " AS a, "
       + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in KIND_STEPS) + " AS c FROM spoken) "
       "SELECT video_id, seg_idx, CASE WHEN c >= 3 OR (a >= 2 AND c >= 1) OR a >= 3 THEN 'procedure' ELSE 'showcase' END AS kind FROM k")
def classify_moment(spark, folder):
    said = F.get(F.array(*[F.lit(x) for x in SAID]), (F.col("seg_idx") % 5).cast("int"))
    return segments(spark, folder).select("video_id", "seg_idx", moment_kind(F.concat("text", said)).alias("kind"))


# --- matching ----------------------------------------------------------------

FIRST_HIT = """
  SELECT video_id, seg_idx, rule_lang, arg_min(weight, place * 100000 - n) AS weight, arg_min(phrase, place * 100000 - n) AS phrase FROM (
    SELECT s.video_id, s.seg_idx, t.lang AS rule_lang, lower(t.phrase) AS phrase, weight, length(t.phrase) AS n,
           instr(lower(s.text), lower(t.phrase)) + length(t.phrase) AS place
    FROM segs s JOIN triggers t ON contains(lower(s.text), lower(t.phrase)) AND {rule}) GROUP BY 1, 2, 3"""
RAW = "raw AS (" + FIRST_HIT.format(rule="t.kind = 'raw'") + ")"
STRICT = "strict AS (" + FIRST_HIT.format(rule="t.kind = 'strict' AND t.lang = s.lang") + ")"
SOFT = """seg_tokens AS (
    SELECT video_id, seg_idx, lang, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(lower(text)), '\\s+'), 1) AS i FROM segs),
lemma_segs AS (
  SELECT video_id, seg_idx, lang, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS t FROM seg_tokens LEFT JOIN lemmas USING (lang, word)
  WHERE lang <> 'en' OR word NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') GROUP BY 1, 2, 3),
rule_tokens AS (
  SELECT lang, phrase, weight, seq, unnest(string_split(lower(phrase), ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) AS i FROM triggers WHERE kind = 'soft'),
lemma_rules AS (SELECT lang, phrase, weight, seq, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS p FROM rule_tokens LEFT JOIN lemmas USING (lang, word) GROUP BY 1, 2, 3, 4),
soft AS (SELECT video_id, seg_idx, lang AS rule_lang, arg_min(weight, seq) AS weight, arg_min(phrase, seq) AS phrase
         FROM lemma_segs JOIN lemma_rules USING (lang) WHERE contains(t, p) GROUP BY 1, 2, 3)"""


@query("match_raw", with_tables(C.SEGS, C.TRIGGERS, RAW) + "SELECT video_id, seg_idx, 1::DOUBLE AS score, weight, 'raw' AS reason, phrase FROM raw")
def match_raw(spark, folder):
    return M.match_raw(segments(spark, folder), C.triggers(spark))


@query("match_strict", with_tables(C.SEGS, C.TRIGGERS, STRICT)
       + "SELECT video_id, seg_idx, 1::DOUBLE AS score, weight, 'strict:' || rule_lang AS reason, phrase FROM strict")
def match_strict(spark, folder):
    return M.match_strict(segments(spark, folder), C.triggers(spark))


@query("match_soft", with_tables(C.SEGS, C.TRIGGERS, C.TOKENS, C.VOCABULARY, C.LEMMAS, SOFT)
       + "SELECT video_id, seg_idx, 0.9::DOUBLE AS score, weight, 'soft:' || rule_lang AS reason, phrase FROM soft")
def match_soft(spark, folder):
    docs = C.table(spark, folder, "documents")
    return M.match_soft(C.doc_segments(docs), C.triggers(spark), settled(C.lemma_table(docs)))


COSINES = """exemplars AS (SELECT a.vec_id AS label, [x + b.embedding[i]::DOUBLE FOR x, i IN a.embedding::DOUBLE[]] AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
cosines AS (SELECT vec_id, e.label AS seq, list_dot_product(a.embedding::DOUBLE[], p::DOUBLE[])
              / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(p::DOUBLE[], p::DOUBLE[])) + 1e-9) AS cosine
            FROM embeddings a, exemplars e),
nearest AS (SELECT vec_id, max(cosine) AS score, arg_max(seq, round(cosine, 9) * 1000000000000 - seq) AS seq FROM cosines GROUP BY vec_id)"""


def _vectors(spark, folder):
    """Vectors as segments; as phrases, the sums of every twentieth vector and the next, to which both are near."""
    vectors = C.table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    second = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("second"))
    first = vectors.filter("vec_id % 20 = 0").join(second, "vec_id").select(
        F.col("vec_id").cast("long").alias("seq"), F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("phrase"),
        (F.col("vec_id") + 1).cast("double").alias("weight"), F.zip_with("embedding", "second", lambda a, b: a + b).alias("embedding"),
    )
    return vectors.select(F.col("vec_id").alias("video_id"), F.lit(0).alias("seg_idx"), "embedding"), first


@query("match_universal", with_tables(COSINES) + """
SELECT vec_id AS video_id, round(score, 5) AS score, (seq + 1)::DOUBLE AS weight, 'universal' AS reason, 'label ' || seq AS phrase FROM nearest WHERE score >= 0.65""")
def match_universal(spark, folder):
    vectors, first = _vectors(spark, folder)
    return M.match_universal(vectors, first).drop("seg_idx").withColumn("score", F.round("score", 5))


@query("match_segments", with_tables(C.SEGS, C.TRIGGERS, C.TOKENS, C.VOCABULARY, C.LEMMAS, RAW, STRICT, SOFT, COSINES) + """,
every AS (SELECT video_id, seg_idx, 0 AS rank, 1::DOUBLE AS score, weight, 'raw' AS reason, phrase FROM raw
  UNION ALL SELECT video_id, seg_idx, 1, 1, weight, 'strict:' || rule_lang, phrase FROM strict
  UNION ALL SELECT video_id, seg_idx, 2, 0.9::DOUBLE, weight, 'soft:' || rule_lang, phrase FROM soft
  UNION ALL SELECT vec_id, 0, 3, score, seq + 1, 'universal', 'label ' || seq FROM nearest WHERE score >= 0.65)
SELECT video_id, seg_idx, round(arg_min(score, rank), 5) AS score, arg_min(weight, rank) AS weight, arg_min(reason, rank) AS reason, arg_min(phrase, rank) AS phrase
FROM every JOIN segs USING (video_id, seg_idx) GROUP BY 1, 2""")
def match_segments(spark, folder):
    docs = C.table(spark, folder, "documents")
    vectors, first = _vectors(spark, folder)
    found = M.match_segments(
        C.doc_segments(docs), C.triggers(spark), "hybrid", settled(C.lemma_table(docs)), vectors, first
    )
    return found.drop("start", "end").withColumn("score", F.round("score", 5))


@query("parse_phrases", """
SELECT event_type AS kind, 'en' AS lang, 'p' || json_extract_string(props, '$.k') AS phrase, min(event_id) AS seq,
       arg_max(CASE WHEN event_id % 3 = 0 THEN 1::DOUBLE ELSE (event_id % 8) / 4::DOUBLE END, event_id) AS weight FROM events GROUP BY 1, 2, 3""")
def parse_phrases(spark, folder):
    entries = C.table(spark, folder, "events").select(
        F.col("event_type").alias("kind"), F.lit("en").alias("lang"), F.col("event_id").alias("seq"),
        F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("phrase"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 8) / 4).alias("weight"),
    )
    return M.parse_phrases(entries)


@query("merge_triggers", """
WITH b AS (SELECT 'raw' AS kind, '' AS lang, c_name AS phrase, 1::DOUBLE AS weight FROM customer),
u AS (SELECT DISTINCT 'raw' AS kind, '' AS lang, c_name AS phrase, 2::DOUBLE AS weight FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
      UNION SELECT 'raw', '', 'order ' || o_orderpriority, 0.5::DOUBLE FROM orders)
SELECT coalesce(u.kind, b.kind) AS kind, coalesce(u.lang, b.lang) AS lang, coalesce(u.phrase, b.phrase) AS phrase, coalesce(u.weight, b.weight) AS weight
FROM b FULL JOIN u USING (kind, lang, phrase)""")
def merge_triggers(spark, folder):
    customers, orders = C.table(spark, folder, "customer"), C.table(spark, folder, "orders")
    builtin = customers.select(F.lit("raw").alias("kind"), F.lit("").alias("lang"), F.col("c_name").alias("phrase"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("seq"))
    paid = orders.filter("o_orderstatus = 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    user = paid.select(F.lit("raw").alias("kind"), F.lit("").alias("lang"), F.col("c_name").alias("phrase"), F.lit(2.0).alias("weight"), F.col("c_custkey").alias("seq")).distinct()
    more = orders.select(F.lit("raw").alias("kind"), F.lit("").alias("lang"), F.concat(F.lit("order "), F.col("o_orderpriority")).alias("phrase"), F.lit(0.5).alias("weight"), F.lit(0).cast("long").alias("seq")).distinct()
    return M.merge_triggers(builtin, user.unionByName(more)).drop("seq")


# --- overlays, packing -------------------------------------------------------

@query("overlay_segments", with_tables(C.TALK) + """,
new AS (SELECT video_id, seg_idx, CASE WHEN video_id % 5 = 0 AND seg_idx = 1 THEN NULL ELSE 'x ' || text END AS text FROM talk WHERE NOT (video_id % 3 = 0 AND seg_idx = 0)),
ok AS (SELECT video_id FROM talk GROUP BY 1 HAVING count(*) = (SELECT count(text) FROM new WHERE new.video_id = talk.video_id)
         AND count(*) = (SELECT count(*) FROM new WHERE new.video_id = talk.video_id))
SELECT video_id, seg_idx, start, "end", CASE WHEN ok.video_id IS NOT NULL THEN new.text ELSE talk.text END AS text
FROM talk LEFT JOIN ok USING (video_id) LEFT JOIN new USING (video_id, seg_idx)""")
def overlay_segments(spark, folder):
    talk = C.talk_segments(C.table(spark, folder, "conversations"))
    new = talk.filter("not (video_id % 3 = 0 and seg_idx = 0)").select(
        "video_id", "seg_idx", F.when(~((F.col("video_id") % 5 == 0) & (F.col("seg_idx") == 1)), F.concat(F.lit("x "), "text")).alias("text")
    )
    return R.overlay_segments(talk, new)


FOLD = """
WITH RECURSIVE {rows},
fold AS (
  SELECT k, i, n, 0 AS chunk, n AS total, 1 AS items FROM rows WHERE i = 0
  UNION ALL SELECT r.k, r.i, r.n, CASE WHEN f.items >= {least} AND f.total + r.n > {budget} THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.items >= {least} AND f.total + r.n > {budget} THEN r.n ELSE f.total + r.n END,
    CASE WHEN f.items >= {least} AND f.total + r.n > {budget} THEN 1 ELSE f.items + 1 END
  FROM fold f JOIN rows r ON r.k = f.k AND r.i = f.i + 1)
"""


@query("chunk_by_tokens", FOLD.format(rows=C.SEGS + ", rows AS (SELECT video_id AS k, seg_idx AS i, greatest(1, length(text) // 4) AS n FROM segs)", least=1, budget=200)
       + "SELECT k AS video_id, i AS seg_idx, n AS tokens, CAST(chunk AS BIGINT) AS chunk FROM fold")
def chunk_by_tokens(spark, folder):
    return P.chunk_by_tokens(segments(spark, folder), 200).select("video_id", "seg_idx", "tokens", "chunk")


@query("chunk_line_items", """
WITH RECURSIVE sizes AS (SELECT 'all' AS video_id, l_orderkey * 8 + l_linenumber AS seg_idx, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (ORDER BY seg_idx) - 1 AS pos, sum(n) OVER (ORDER BY seg_idx) AS q FROM sizes),
links AS (SELECT pos, count(*) OVER (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 4000 - n FOLLOWING) AS next FROM p),
starts AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS chunk UNION ALL SELECT l.next, s.chunk + 1 FROM starts s JOIN links l USING (pos) WHERE l.next < (SELECT count(*) FROM sizes))
SELECT video_id, seg_idx, n, max(chunk) OVER (ORDER BY pos) AS chunk FROM p LEFT JOIN starts USING (pos)""")
def chunk_line_items(spark, folder):
    """All line items as one key."""
    sizes = C.table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seg_idx")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return P.greedy_chunks(sizes.select(F.lit("all").alias("video_id"), "seg_idx", "n"), "seg_idx", "n", 4000)


@query("pack_summaries", FOLD.format(rows="rows AS (SELECT source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, n_chars + length(lang) AS n, doc_id FROM documents)", least=2, budget=4000)
       + "SELECT k AS source, doc_id, CAST(chunk AS BIGINT) AS chunk FROM fold JOIN rows USING (k, i)")
def pack_summaries(spark, folder):
    docs = C.table(spark, folder, "documents")
    items = docs.select("source", F.col("doc_id").alias("item_idx"), F.col("lang").alias("header"), F.col("text").alias("summary"))
    return P.pack_summaries(items, 4000, ["source"]).select("source", F.col("item_idx").alias("doc_id"), "chunk")


@query("cap_transcript", "WITH " + C.SEGS + f""",
l AS (SELECT video_id, seg_idx, '[' || {sql_clock("start")} || '] ' || trim(text) AS line FROM segs),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY video_id ORDER BY seg_idx) - length(line) - 1 + length(line) AS upto FROM l),
s AS (SELECT video_id, min(seg_idx) AS stop FROM r WHERE upto > 2000 GROUP BY 1)
SELECT video_id, seg_idx, CASE WHEN seg_idx = stop THEN '[...truncated...]' ELSE line END AS line FROM r LEFT JOIN s USING (video_id) WHERE stop IS NULL OR seg_idx <= stop""")
def cap_transcript(spark, folder):
    return P.cap_transcript(segments(spark, folder), 2000)


@query("window_context", "WITH " + C.SEGS + """,
w AS (SELECT video_id, seg_idx AS win_idx, start, "end" FROM segs),
p AS (SELECT w.video_id, win_idx, string_agg(trim(text), ' ' ORDER BY seg_idx) AS t FROM w JOIN segs s
      ON s.video_id = w.video_id AND s."end" >= w.start - 6 AND s.start <= w."end" + 6 AND trim(text) <> '' GROUP BY 1, 2)
SELECT video_id, win_idx, coalesce(left(t, 700), '') AS transcript_context FROM w LEFT JOIN p USING (video_id, win_idx)""")
def window_context(spark, folder):
    segs = segments(spark, folder)
    windows = segs.select("video_id", F.col("seg_idx").alias("win_idx"), "start", "end")
    return I.window_context(windows, segs).select("video_id", "win_idx", "transcript_context")


@query("attach_speakers", with_tables(C.TALK, C.TURNS) + """,
o AS (SELECT t.video_id, t.seg_idx, speaker, turn_idx, least(t."end", u."end") - greatest(t.start, u.start) AS shared FROM talk t JOIN turns u USING (video_id)),
b AS (SELECT video_id, seg_idx, speaker FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY shared DESC, turn_idx) AS nth FROM o WHERE shared > 0) WHERE nth = 1)
SELECT video_id, seg_idx, coalesce('[' || speaker || '] ', '') || text AS text, speaker FROM talk LEFT JOIN b USING (video_id, seg_idx)""")
def attach_speakers(spark, folder):
    talk = C.table(spark, folder, "conversations")
    return I.attach_speakers(C.talk_segments(talk), C.talk_turns(talk)).select("video_id", "seg_idx", "text", "speaker")
