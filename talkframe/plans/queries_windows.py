"""Queries over windows, frames, silences and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.operators import cost as K
from talkframe.operators import intervals as I
from talkframe.operators import packs as P
from talkframe.operators import windows as W
from talkframe.plans import corpus as C
from talkframe.plans.moments import best_moments as moments_plan
from talkframe.plans.queries_segments import FIRST_HIT
from talkframe.plans.registry import query, with_tables


def windows(spark, folder):
    return C.event_windows(C.table(spark, folder, "events"))


MERGED = """reach AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, win_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {source}),
islands AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start, win_idx ROWS UNBOUNDED PRECEDING) AS island FROM reach),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY score * weight DESC, start, win_idx) AS best,
                  first_value(win_idx) OVER (PARTITION BY video_id, island ORDER BY start, win_idx) AS first_idx FROM islands),
merged AS (SELECT video_id, min(first_idx) AS win_idx, min(start) AS start, max("end") AS "end", max(reason) FILTER (best = 1) AS reason,
                  max(score) FILTER (best = 1) AS score, max(weight) FILTER (best = 1) AS weight, max(phrase) FILTER (best = 1) AS phrase
           FROM ranked GROUP BY video_id, island)"""


@query("merge_windows", with_tables(C.WINDOWS, MERGED.format(source="windows", gap=1)) + "SELECT * FROM merged")
def merge_windows(spark, folder):
    return W.merge_windows(windows(spark, folder))


BUDGET = """durations AS (SELECT video_id, max("end") AS duration FROM windows GROUP BY video_id),
sized AS (SELECT w.*, duration, count(*) OVER (PARTITION BY video_id) AS n FROM windows w JOIN durations USING (video_id)),
bucketed AS (SELECT *, row_number() OVER (PARTITION BY video_id, least(floor(start / (duration / 12)), 11) ORDER BY score * weight DESC, win_idx) AS best FROM sized)"""


@query("select_by_budget", with_tables(C.WINDOWS, BUDGET)
       + 'SELECT video_id, win_idx, start, "end", reason, score, weight, phrase FROM bucketed WHERE n <= 12 OR best = 1')
def select_by_budget(spark, folder):
    w = windows(spark, folder)
    durations = w.groupBy("video_id").agg(F.max("end").alias("duration"))
    return W.select_by_budget(w, durations, 12)


@query("detection_windows", with_tables(C.WINDOWS, C.FRAMES) + """
SELECT video_id, greatest(start - 1.5::DOUBLE, 0) AS start, "end" + 1.5::DOUBLE AS "end", reason, score, weight, phrase FROM windows
UNION ALL SELECT video_id, greatest(ts - 0.5::DOUBLE, 0), ts + 1.5::DOUBLE, 'scene_change', 0.5::DOUBLE, 1, '' FROM frames""")
def detection_windows(spark, folder):
    hits = windows(spark, folder).withColumnRenamed("win_idx", "seg_idx")
    scenes = C.order_frames(C.table(spark, folder, "orders")).select("video_id", "ts")
    return W.detection_windows(hits, scenes, "hybrid").drop("win_idx")


CHANGES = """changes AS (SELECT video_id, frame_idx, prev_ts, ts, bit_count(xor(hash, prev)) AS distance FROM (
  SELECT *, lag(ts) OVER v AS prev_ts, lag(hash) OVER v AS prev FROM frames WINDOW v AS (PARTITION BY video_id ORDER BY frame_idx))
  WHERE bit_count(xor(hash, prev)) >= 20)"""


@query("frame_changes", with_tables(C.FRAMES, CHANGES) + "SELECT video_id, frame_idx, prev_ts, ts, CAST(distance AS INTEGER) AS distance FROM changes")
def frame_changes(spark, folder):
    return I.frame_changes(C.order_frames(C.table(spark, folder, "orders")))


@query("refine_by_frame_diff", with_tables(C.FRAMES, CHANGES, C.CUSTOMER_WINDOWS) + """,
n AS (SELECT w.video_id, w.win_idx, count(ts) AS n FROM cwindows w LEFT JOIN changes c ON c.video_id = w.video_id AND prev_ts >= start AND ts <= "end" GROUP BY 1, 2)
SELECT video_id, win_idx, start, "end", reason, CASE WHEN reason <> 'raw' AND n >= 2 THEN least(score * 1.3::DOUBLE, 1) ELSE score END AS score, weight, phrase
FROM cwindows JOIN n USING (video_id, win_idx) WHERE reason = 'raw' OR n >= 1""")
def refine_by_frame_diff(spark, folder):
    frames = C.order_frames(C.table(spark, folder, "orders"))
    return I.refine_by_frame_diff(C.customer_windows(C.table(spark, folder, "customer")), frames, rich_changes=2)


@query("visuals_in_chunk", with_tables(C.FRAMES, C.CUSTOMER_WINDOWS) + """
SELECT f.video_id, frame_idx, ts AS v_start, win_idx AS chunk FROM frames f JOIN cwindows w ON w.video_id = f.video_id AND ts BETWEEN start AND "end" """)
def visuals_in_chunk(spark, folder):
    visuals = C.order_frames(C.table(spark, folder, "orders")).select("video_id", "frame_idx", F.col("ts").alias("start"))
    chunks = C.customer_windows(C.table(spark, folder, "customer")).withColumnRenamed("win_idx", "chunk")
    return I.visuals_in_chunk(visuals, chunks).select("video_id", "frame_idx", "v_start", "chunk")


@query("plan_cuts", with_tables(C.MEDIA, C.SILENCES) + """,
cuts AS (SELECT video_id, CAST(i AS BIGINT) AS cut_idx, i * (duration / n_chunks) AS ideal, duration / n_chunks AS seg FROM media, unnest(range(1, n_chunks)) AS u(i)),
near AS (SELECT c.video_id, cut_idx, least(greatest(ideal, start), "end") AS p, row_number() OVER (PARTITION BY c.video_id, cut_idx
           ORDER BY abs(least(greatest(ideal, start), "end") - ideal), start, "end") AS nth
         FROM cuts c JOIN silences s ON s.video_id = c.video_id AND "end" >= ideal - seg * 0.5 AND start <= ideal + seg * 0.5)
SELECT c.video_id, c.cut_idx, round(ideal, 6) AS ideal, round(coalesce(p, ideal), 6) AS cut, p IS NULL AS warning FROM cuts c LEFT JOIN (SELECT * FROM near WHERE nth = 1) n USING (video_id, cut_idx)""")
def plan_cuts(spark, folder):
    out = I.plan_cuts(C.media(C.table(spark, folder, "customer")), C.order_silences(C.table(spark, folder, "orders")))
    return out.withColumns({"ideal": F.round("ideal", 6), "cut": F.round("cut", 6)})


@query("speech_bounds", with_tables(C.MEDIA, C.SILENCES) + """,
s AS (SELECT video_id, start - (SELECT min(start) FROM silences x WHERE x.video_id = y.video_id) AS start, "end" - (SELECT min(start) FROM silences x WHERE x.video_id = y.video_id) AS "end" FROM silences y),
e AS (SELECT video_id, arg_min("end", start * 1000 + "end") AS fe, min(start) AS fs, arg_max("end", start * 1000 + "end") AS le, max(start) AS ls FROM s GROUP BY 1),
m AS (SELECT video_id, coalesce(le, 600) + (video_id % 2) AS duration, fe, fs, le, ls FROM media LEFT JOIN e USING (video_id))
SELECT video_id, CASE WHEN fs <= 0.5 AND fe - fs >= 1.5 THEN fe ELSE 0 END AS speech_start, CASE WHEN duration - le <= 0.5 AND le - ls >= 1.5 THEN ls ELSE duration END AS speech_end FROM m""")
def speech_bounds(spark, folder):
    silences = C.order_silences(C.table(spark, folder, "orders"))
    first = silences.groupBy("video_id").agg(F.min("start").alias("_0"), F.max_by("end", F.struct("start", "end")).alias("_1"))
    shifted = silences.join(first, "video_id").select("video_id", (F.col("start") - F.col("_0")).alias("start"), (F.col("end") - F.col("_0")).alias("end"))
    media = C.media(C.table(spark, folder, "customer")).join(first, "video_id", "left").select(
        "video_id", (F.coalesce(F.col("_1") - F.col("_0"), F.lit(600.0)) + F.col("video_id") % 2).alias("duration")
    )
    return I.speech_bounds(media, shifted)


@query("reassemble", with_tables(C.TALK) + """
SELECT t.video_id, seg_idx, start + off + trim_s AS start, "end" + off + trim_s AS "end", trim(text) AS text
FROM talk t JOIN (SELECT DISTINCT conv_id AS video_id, conv_id % 3 * 120::DOUBLE AS off, conv_id % 2 * 1.5::DOUBLE AS trim_s FROM conversations) USING (video_id)""")
def reassemble(spark, folder):
    talk = C.talk_segments(C.table(spark, folder, "conversations")).withColumn("chunk", F.lit(0))
    chunks = talk.select("video_id", "chunk").distinct().select(
        "video_id", "chunk", (F.col("video_id") % 3 * 120.0).alias("offset"), F.when(F.col("video_id") % 2 == 1, 1.5).alias("leading_trim")
    )
    return I.reassemble(talk, chunks).drop("chunk")


# --- frames ------------------------------------------------------------------

@query("dedup_frames_of_orders", """
WITH RECURSIVE frames AS (
  SELECT o_custkey AS video_id, 0 AS win_idx, o_orderkey AS frame_idx, xor(o_custkey * 2654435761, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) & 16383) AS hash FROM orders),
ordered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS nth FROM frames),
fold AS (
  SELECT video_id, frame_idx, nth, [hash] AS kept, TRUE AS keep FROM ordered WHERE nth = 1
  UNION ALL SELECT h.video_id, h.frame_idx, h.nth,
    CASE WHEN list_min([bit_count(xor(k, h.hash)) FOR k IN f.kept]) <= 5 THEN f.kept ELSE list_append(f.kept, h.hash) END,
    list_min([bit_count(xor(k, h.hash)) FOR k IN f.kept]) > 5
  FROM fold f JOIN ordered h ON h.video_id = f.video_id AND h.nth = f.nth + 1)
SELECT video_id, 0 AS win_idx, frame_idx FROM fold WHERE keep""")
def dedup_frames_of_orders(spark, folder):
    """One window a customer, whose frames differ in up to 14 bits."""
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    return P.dedup_frames(C.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("video_id"), F.lit(0).alias("win_idx"), F.col("o_orderkey").alias("frame_idx"),
        (F.col("o_custkey") * F.lit(2654435761)).bitwiseXOR(cents.bitwiseAND(16383)).alias("hash"),
    )).drop("hash")


@query("dedup_frames", """
WITH RECURSIVE frames AS (
  SELECT l_suppkey % 50 AS win_idx, l_orderkey AS video_id, CAST(l_linenumber AS BIGINT) AS frame_idx,
         CASE WHEN l_linenumber <> 3 THEN CAST(floor(l_extendedprice / 700) AS BIGINT) END AS hash
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 50, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
hashed AS (SELECT *, row_number() OVER (PARTITION BY video_id, win_idx ORDER BY frame_idx) AS nth FROM frames WHERE hash IS NOT NULL),
fold AS (
  SELECT video_id, win_idx, frame_idx, nth, [hash] AS kept, TRUE AS keep FROM hashed WHERE nth = 1
  UNION ALL SELECT h.video_id, h.win_idx, h.frame_idx, h.nth,
    CASE WHEN list_min([bit_count(xor(k, h.hash)) FOR k IN f.kept]) <= 5 THEN f.kept ELSE list_append(f.kept, h.hash) END,
    list_min([bit_count(xor(k, h.hash)) FOR k IN f.kept]) > 5
  FROM fold f JOIN hashed h ON h.video_id = f.video_id AND h.win_idx = f.win_idx AND h.nth = f.nth + 1)
SELECT video_id, win_idx, frame_idx FROM fold WHERE keep UNION ALL SELECT video_id, win_idx, frame_idx FROM frames WHERE hash IS NULL""")
def dedup_frames(spark, folder):
    from talkframe.operators.ordered import first_by

    items = C.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), (F.col("l_suppkey") % 50).alias("win_idx"), F.col("l_linenumber").cast("long").alias("frame_idx"),
        F.when(F.col("l_linenumber") != 3, F.floor(F.col("l_extendedprice") / 700)).alias("hash"), "l_partkey", "l_suppkey",
    )
    frames = first_by(items, ["video_id", "win_idx", "frame_idx"], [F.col("l_partkey"), F.col("l_suppkey")]).drop("l_partkey", "l_suppkey")
    return P.dedup_frames(frames).select("video_id", "win_idx", "frame_idx")


@query("rank_candidate_frames", """
WITH f AS (SELECT l_orderkey AS moment, CAST(l_linenumber AS BIGINT) AS cand_idx, CASE WHEN l_linenumber <> 4 THEN l_discount * 8 END AS slide,
             CAST(l_returnflag = 'R' AS DOUBLE) AS face, floor(l_quantity) AS sharpness, CASE WHEN l_linenumber <> 5 THEN floor(l_tax * 100) / 64::DOUBLE END AS diff_next
           FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
b AS (SELECT *, lag(diff_next) OVER (PARTITION BY moment ORDER BY cand_idx) AS before, max(sharpness) OVER (PARTITION BY moment) AS top FROM f),
s AS (SELECT *, CASE WHEN slide IS NULL THEN -1e9 ELSE slide + 0.5::DOUBLE * (1 - CASE WHEN before IS NULL AND diff_next IS NULL THEN 0
        ELSE (coalesce(before, 0) + coalesce(diff_next, 0)) / ((before IS NOT NULL)::INT + (diff_next IS NOT NULL)::INT) END) - face + 0.15::DOUBLE * (sharpness / top) END AS score FROM b)
SELECT moment, arg_min(cand_idx, -round(score, 9) * 1000 + cand_idx * 1e-9) AS cand_idx, round(max(score), 10) AS rank_score FROM s GROUP BY moment""")
def rank_candidate_frames(spark, folder):
    from talkframe.operators.ordered import first_by

    items = C.table(spark, folder, "lineitem").select(
        F.lit(0).alias("video_id"), F.col("l_orderkey").alias("moment"), F.col("l_linenumber").cast("long").alias("cand_idx"),
        F.when(F.col("l_linenumber") != 4, F.col("l_discount") * 8).alias("slide"), (F.col("l_returnflag") == "R").cast("double").alias("face"),
        F.floor("l_quantity").cast("double").alias("sharpness"), F.when(F.col("l_linenumber") != 5, F.floor(F.col("l_tax") * 100) / 64).alias("diff_next"),
        "l_partkey", "l_suppkey",
    )
    features = first_by(items, ["moment", "cand_idx"], [F.col("l_partkey"), F.col("l_suppkey")]).drop("l_partkey", "l_suppkey")
    return P.rank_candidate_frames(features).select("moment", "cand_idx", F.round("rank_score", 10).alias("rank_score"))


@query("expand_frame_times", """
SELECT DISTINCT user_id AS video_id, round_even(greatest(round_even(value * 1000, 0) / 1000 + o, 0) * 1000, 0) / 1000 AS frame_ts
FROM events, (VALUES (-1.5::DOUBLE), (0.3::DOUBLE), (2::DOUBLE)) AS offsets(o)""")
def expand_frame_times(spark, folder):
    return P.expand_frame_times(C.table(spark, folder, "events").select(F.col("user_id").alias("video_id"), F.col("value").alias("event_ts")))


@query("image_budget", """
SELECT report_id, section_idx, image_idx, ref FROM (
  SELECT o_custkey AS report_id, l_orderkey AS section_idx, l_partkey AS image_idx, l_suppkey AS ref,
         row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS nth
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount > 0.02) WHERE nth <= 10""")
def image_budget(spark, folder):
    items = C.table(spark, folder, "lineitem").join(C.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    images = items.select(
        F.col("o_custkey").alias("report_id"), F.col("l_orderkey").alias("section_idx"),
        F.struct(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("c")).alias("image_idx"),
        F.col("l_suppkey").alias("ref"), (F.col("l_discount") > 0.02).alias("resolvable"),
    )
    return P.image_budget(images, 10).select("report_id", "section_idx", F.col("image_idx.a").alias("image_idx"), "ref")


# --- cost --------------------------------------------------------------------

CALL_COST = """coalesce(greatest(0, prompt_tokens - cached_tokens) / 1000000 * input_rate + cached_tokens / 1000000 * input_rate * 0.25::DOUBLE + output_tokens / 1000000 * output_rate, 0)"""


@query("price_calls", with_tables(C.CALLS, C.PRICES) + f"""
SELECT model, input_rate IS NOT NULL AS priced, prompt_tokens, cached_tokens, round({CALL_COST}, 13) AS cost_usd FROM calls LEFT JOIN prices USING (model)""")
def price_calls(spark, folder):
    priced = K.price_calls(C.calls(C.table(spark, folder, "lineitem")), C.prices(spark))
    return priced.select("model", "priced", "prompt_tokens", "cached_tokens", F.round("cost_usd", 13).alias("cost_usd"))


@query("cost_by_stage", with_tables(C.CALLS, C.PRICES) + f""",
c AS (SELECT *, {CALL_COST} AS cost FROM calls LEFT JOIN prices USING (model))
SELECT run_id, stage, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, round_even(sum(cost) * 1000000, 0) / 1000000 AS cost_usd, stage IS NULL AS is_total
FROM c GROUP BY GROUPING SETS ((run_id, stage), (run_id))""")
def cost_by_stage(spark, folder):
    return K.cost_by_stage(C.calls(C.table(spark, folder, "lineitem")), C.prices(spark))


@query("unpriced_models", with_tables(C.CALLS, C.PRICES) + "SELECT DISTINCT model FROM calls WHERE model NOT IN (SELECT model FROM prices)")
def unpriced_models(spark, folder):
    return K.unpriced_models(C.calls(C.table(spark, folder, "lineitem")), C.prices(spark))


# --- flagship ----------------------------------------------------------------

HITS = """hits_raw AS ({raw}),
hits_strict AS ({strict}),
hits AS (SELECT video_id, seg_idx, weight, phrase, 'raw' AS reason FROM hits_raw
         UNION ALL SELECT video_id, seg_idx, weight, phrase, 'strict:' || rule_lang FROM hits_strict s WHERE NOT EXISTS (SELECT 1 FROM hits_raw r WHERE r.video_id = s.video_id AND r.seg_idx = s.seg_idx)),
found AS (SELECT video_id, CAST(seg_idx AS BIGINT) AS win_idx, greatest(start - 1.5::DOUBLE, 0) AS start, "end" + 1.5::DOUBLE AS "end", reason, 1::DOUBLE AS score, weight, phrase
          FROM hits JOIN segs USING (video_id, seg_idx))"""
CLEAN = """segs AS (SELECT * FROM lines WHERE NOT (trim(text) = '' OR ("end" - start >= 5 AND length(trim(text)) / ("end" - start) < 2 AND len(list_distinct([left(w, 4) FOR w IN
  string_split(trim(regexp_replace(regexp_replace(lower(text), '[.,!?:;\\-–—…"''()\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') IF w <> ''])) <= 2)))"""
MOMENTS = with_tables(
    C.SEGS.replace("segs AS (", "lines AS (", 1), CLEAN, C.TRIGGERS,
    HITS.format(raw=FIRST_HIT.format(rule="t.kind = 'raw'"), strict=FIRST_HIT.format(rule="t.kind = 'strict' AND t.lang = s.lang")),
    MERGED.format(source="found", gap=1),
) + """,
durations AS (SELECT doc_id AS video_id, n_chars / 15::DOUBLE AS duration FROM documents),
sized AS (SELECT m.*, duration, count(*) OVER (PARTITION BY video_id) AS n FROM merged m JOIN durations USING (video_id)),
bucketed AS (SELECT *, row_number() OVER (PARTITION BY video_id, least(floor(start / (duration / 4)), 3) ORDER BY score * weight DESC, win_idx) AS best FROM sized),
chosen AS (SELECT * FROM bucketed WHERE n <= 4 OR best = 1),
ctx AS (SELECT c.video_id, c.win_idx, string_agg(trim(text), ' ' ORDER BY seg_idx) AS t FROM chosen c JOIN segs s
        ON s.video_id = c.video_id AND s."end" >= c.start - 6 AND s.start <= c."end" + 6 AND trim(text) <> '' GROUP BY 1, 2)
SELECT video_id, win_idx, start, "end", reason, phrase, score * weight AS priority, coalesce(left(t, 700), '') AS transcript_context FROM chosen LEFT JOIN ctx USING (video_id, win_idx)"""


@query("best_moments", MOMENTS)
def best_moments(spark, folder):
    docs = C.table(spark, folder, "documents")
    durations = docs.select(F.col("doc_id").alias("video_id"), (F.col("n_chars") / 15).alias("duration"))
    found = moments_plan(C.doc_segments(docs), C.triggers(spark), durations, max_windows=4)
    return found.select("video_id", "win_idx", "start", "end", "reason", "phrase", "priority", "transcript_context")
