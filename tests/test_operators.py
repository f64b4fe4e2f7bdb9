"""Facts on small fixtures, and brute-force checks on shuffled and skewed rows."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from talkframe.functions import columns as X
from talkframe.functions.fixed_values import MODEL_PRICES
from talkframe.operators import channels, claims, cost, detect, hot_keys, intervals, matching, ordered, packs, phrases, quality, responses, targets, windows
from talkframe.operators.ordered import block_of, running_before


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SEG = "video_id string, seg_idx int, start double, end double, text string"
WIN = "video_id string, win_idx bigint, start double, end double, reason string, score double, weight double, phrase string"


def segs(spark, texts, seconds=5.0, video="v"):
    return spark.createDataFrame([(video, i, i * seconds, (i + 1) * seconds, t) for i, t in enumerate(texts)], SEG)


# --- ordered work ------------------------------------------------------------

def test_running_before_is_the_plain_window_for_any_block_size(spark):
    data = [(i % 2, i, (i * 7) % 13, i if i % 5 == 0 else None) for i in range(300)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k int, i int, v int, w int").repartition(5)
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("w"))}
    want = None
    for size in (1, 7, 1000):
        got = rows(running_before(df, ["k"], ["i"], block_of("i", size), specs), "k", "i", "s", F.coalesce("m", F.lit(-1)), F.coalesce("l", F.lit(-1)))
        want = want or got
        assert got == want
    done = {0: [], 1: []}
    for k, i, v, w in sorted(data, key=lambda r: r[1]):
        before = done[k]
        last = next((b[1] for b in reversed(before) if b[1] is not None), -1)
        assert (k, i, sum(b[0] for b in before), max((b[0] for b in before), default=-1), last) in want
        before.append((v, w))


# --- windows -----------------------------------------------------------------

def brute_merge(items, gap):
    out = []
    for w in sorted(items, key=lambda w: (w[2], w[1])):
        if out and w[2] <= out[-1][3] + gap:
            last = out[-1]
            best = last if last[5] * last[6] >= w[5] * w[6] else w
            out[-1] = (*last[:3], max(last[3], w[3]), *best[4:])
        else:
            out.append(w)
    return [(w[2], w[3], *w[4:]) for w in out]


@pytest.mark.parametrize("gap", [0.0, 1.0, 2.5])
def test_merge_windows_matches_a_fold(spark, gap):
    r = random.Random(3)
    items = []
    for i in range(400):
        # Nine in ten windows are in one video.
        video, start = ("hot" if r.random() < 0.9 else "cold"), r.randrange(0, 4000) / 4
        items.append((video, i, start, start + r.randrange(0, 12) / 4, f"r{i}", r.choice([0.25, 0.5, 1.0]), r.choice([1.0, 2.0]), f"p{i}"))
    got = rows(windows.merge_windows(spark.createDataFrame(items, WIN).repartition(7), gap), "video_id", "start", "end", "reason", "score", "weight", "phrase")
    want = sorted((v, *w) for v in ("hot", "cold") for w in brute_merge([x for x in items if x[0] == v], gap))
    assert got == want


def test_windows_that_end_before_they_start_do_not_merge_too_much(spark):
    items = [("v", 0, 10.0, 5.0, "a", 1.0, 1.0, ""), ("v", 1, 10.0, 12.0, "b", 0.5, 1.0, ""), ("v", 2, 12.5, 13.0, "c", 0.2, 1.0, "")]
    got = rows(windows.merge_windows(spark.createDataFrame(items, WIN)), "start", "end", "reason")
    assert got == [(10.0, 5.0, "a"), (10.0, 13.0, "b")]


def test_budget(spark):
    items = [("v", i, s, s + 1, n, p, 1.0, "") for i, (s, n, p) in enumerate([(1.0, "low", 0.2), (5.0, "fine", 0.5), (25.0, "high", 0.9), (45.0, "ok", 0.4)])]
    df = spark.createDataFrame(items, WIN)
    length = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    assert rows(windows.select_by_budget(df, length, 3), "reason") == [("fine",), ("high",), ("ok",)]
    assert windows.select_by_budget(df, length, 10).count() == 4
    assert windows.select_by_budget(df, length, 0).count() == 0
    assert windows.select_by_budget(df, length.withColumn("duration", F.lit(0.0)), 3).count() == 0


def test_frame_diff_drops_static_keeps_strong_and_raises_rich(spark):
    frames = [("v", i, float(i), (-1 if i % 2 else 0) if i >= 20 else 0) for i in range(40)]
    f = spark.createDataFrame(frames, "video_id string, frame_idx bigint, ts double, hash bigint")
    items = [("v", 0, 0.0, 10.0, "universal", 0.5, 1.0, ""), ("v", 1, 0.0, 10.0, "strict:en", 0.5, 1.0, ""), ("v", 2, 22.0, 30.0, "soft:en", 0.9, 1.0, ""), ("v", 3, 19.0, 21.0, "soft:en", 0.5, 1.0, "")]
    got = rows(intervals.refine_by_frame_diff(spark.createDataFrame(items, WIN), f), "win_idx", "score")
    assert got == [(1, 0.5), (2, 1.0), (3, 0.5)]


# --- intervals ---------------------------------------------------------------

def test_speaker_of_the_longest_overlap(spark):
    s = spark.createDataFrame([("v", 0, 3.0, 7.0, "hi"), ("v", 1, 20.0, 21.0, "alone"), ("v", 2, 100.0, 400.0, "long")], SEG)
    t = spark.createDataFrame([("v", 0, 0.0, 4.0, "A"), ("v", 1, 4.0, 10.0, "B"), ("v", 2, 90.0, 250.0, "C"), ("v", 3, 250.0, 410.0, "D")],
                              "video_id string, turn_idx int, start double, end double, speaker string")
    assert rows(intervals.attach_speakers(s, t), "text") == [("[B] hi",), ("[C] long",), ("alone",)]


def test_overlap_join_does_not_send_cells_to_the_driver(spark):
    chunks = spark.range(3).select(F.col("id").alias("video_id"), F.lit(0).alias("chunk"), F.lit(0.0).alias("start"), F.lit(6000.0).alias("end"))
    visuals = spark.range(3).select(F.col("id").alias("video_id"), F.lit(0).alias("visual_idx"), F.lit(59.0).alias("start"))
    pairs = intervals.visuals_in_chunk(visuals, chunks)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert rows(pairs, "video_id") == [(0,), (1,), (2,)]


def test_overlap_join_is_complete_for_any_cell(spark):
    r = random.Random(5)
    left = [("v", i, a := r.randrange(0, 500) / 2, a + r.randrange(0, 300) / 2) for i in range(80)]
    right = [("v", i, a := r.randrange(0, 500) / 2, a + r.randrange(0, 300) / 2) for i in range(80)]
    want = sorted((x[1], y[1]) for x in left for y in right if x[2] <= y[3] and y[2] <= x[3])
    a = spark.createDataFrame(left, "video_id string, l int, ls double, le double")
    b = spark.createDataFrame(right, "video_id string, r int, rs double, re double")
    for cell in (0.5, 10.0, 1000.0):
        got = intervals.overlapping(a, b, (F.col("ls"), F.col("le")), (F.col("rs"), F.col("re")), cell_seconds=cell)
        assert rows(got, "l", "r") == want


def test_cuts_move_to_silence_or_warn(spark):
    media = spark.createDataFrame([("v", 100.0, 2)], "video_id string, duration double, n_chunks int")
    near = spark.createDataFrame([("v", 48.0, 52.0)], "video_id string, start double, end double")
    far = spark.createDataFrame([("v", 1.0, 2.0)], "video_id string, start double, end double")
    assert rows(intervals.plan_cuts(media, near), "cut", "warning") == [(50.0, False)]
    assert rows(intervals.plan_cuts(media, far), "cut", "warning") == [(50.0, True)]


# --- replies and prompts -------------------------------------------------------

def test_replies_that_cannot_be_read_leave_the_original(spark):
    original = spark.createDataFrame([(v, i, float(i), i + 1.0, f"{v}{i}") for v in "abcdefgh" for i in range(2)], "video_id string, seg_idx int, start double, end double, text string")
    good = '[{"text": "x"}, {"start": 9, "text": 5}]'
    raws = {"a": good, "b": f" ```json\n{good}\n``` ", "c": f"Sure: {good}", "d": '[{"text": "x"}]', "e": '[{"text": "x"}, {"start": 1}]', "f": '{"text": "x"}', "g": '[1, 2]', "h": None}
    replies = spark.createDataFrame(list(raws.items()), "video_id string, raw string")
    got = {(r.video_id, r.seg_idx): (r.text, r.start) for r in responses.apply_segment_replies(original, replies).collect()}
    for v in "abcdefgh":
        assert [got[v, i] for i in range(2)] == ([("x", 0.0), ("5", 1.0)] if v in "ab" else [(f"{v}0", 0.0), (f"{v}1", 1.0)]), v


def test_screening_prompt_numbers_its_candidates(spark):
    candidates = spark.createDataFrame([("q", 2, None, None, None, 0), ("q", 1, "One", "C", date(2024, 1, 2), 3700), ("lost", 1, "x", None, None, None)], "response_id string, pos int, title string, channel string, upload_date date, duration_sec int")
    requests = spark.createDataFrame([("q", "cats"), ("none", None)], "response_id string, wanted string")
    pieces = responses.screening_prompts(candidates, requests, "T", "F").orderBy("response_id", "position").collect()
    text = {k: "".join(r.piece for r in pieces if r.response_id == k) for k in ("q", "none")}
    assert text == {"q": "T\n\nUser asks for: cats\n\nCandidates, numbered from 1:\n[1] One — C — 2024-01-02 — 1:01:40\n[2] (no title) — ? — ? — ?\n\nF", "none": "T\n\nUser asks for: \n\nCandidates, numbered from 1:\n\nF"}


def test_prompts_of_one_block_carry_no_rows(spark):
    """Lists whose candidates fit one block need no join with carried rows."""
    candidates = spark.createDataFrame([(q, p, "t", "c", date(2024, 1, 2), 5) for q in range(40) for p in (1, 2)], "response_id long, pos int, title string, channel string, upload_date date, duration_sec int")
    pieces = responses.screening_prompts(candidates, spark.range(40).select(F.col("id").alias("response_id"), F.lit("w").alias("wanted")))
    assert len(pieces.collect()) == 160
    final = pieces._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "LeftOuter" not in final


def test_heads_and_ends_around_items_of_many_blocks(spark):
    places = {"a": [300_001, 0, 100_000, 5, 99_999], "b": [1], "c": [], "twice": [250_000, 1]}
    items = spark.createDataFrame([(k, i, f"é{i}") for k, v in places.items() for i in v], "k string, _i long, _piece string").repartition(3)
    ends = spark.createDataFrame([(k, f"<{k}", "ü>") for k in places] + [("twice", "<<", "longer>"), (None, "<", None)], "k string, _head string, _end string")
    for gap in ("", "\n,"):
        got: dict = {}
        for r in ordered.enclosed_pieces(ends, items, "k", gap).orderBy("position").collect():
            own = got.setdefault(r.k, [])
            assert (r.position, r.offset) == (len(own), len("".join(own).encode())), r
            own.append(r.piece)
        for k, v in places.items():
            heads = sum(p.startswith("<") for p in got[k])
            assert got[k][heads:len(got[k]) - heads] == [(gap if n else "") + f"é{i}" for n, i in enumerate(sorted(v))], k
        assert (got["a"][0], got["a"][-1], got["c"], got[None]) == ("<a", "ü>", ["<c", "ü>"], ["<", ""])
        assert sorted(got["twice"][:2] + got["twice"][-2:]) == sorted(["<twice", "<<", "ü>", "longer>"])


def test_durations_as_text(spark):
    seconds = [0, 59, 60, 3599, 3600, 36_061, 360_000 * 10, -1, -3601, None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i int, s long").orderBy("i").select(X.format_duration("s")).collect()]
    assert got == ["0:00", "0:59", "1:00", "59:59", "1:00:00", "10:01:01", "1000:00:00", "59:59", "59:59", "—"]


def test_channels_at_their_cap(spark):
    entries = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 1), ("c", 1), ("c", 2), ("c", 3)], "channel_id string, n int")
    known = spark.createDataFrame([("a", "@a", "ua"), ("b", None, "ub"), ("c", None, "uc")], "channel_id string, handle string, url string")
    assert rows(channels.cap_reached(entries, known, 3), "channel_id", "label", "found") == [("a", "@a", 3), ("c", "c", 3)]
    assert channels.cap_reached(entries, known, 0).count() == 0


# --- common keys -------------------------------------------------------------

def test_common_keys_are_looked_up_without_a_shuffle(spark):
    rows_ = [("en", "the", i) for i in range(3000)] + [("en", f"w{i % 50}", i) for i in range(100)] + [("fr", None, 1), (None, "the", 2)]
    left = spark.createDataFrame(rows_, "lang string, word string, i int").repartition(6)
    lookup = spark.createDataFrame([("en", "the", 1), ("en", "w3", 2), ("fr", "the", 3)], "lang string, word string, k int")
    assert hot_keys.common_keys(left, ["lang", "word"])[0] == '{"lang":"en","word":"the"}'
    for how in ("left", "inner"):
        got, want = hot_keys.join_unique(left, lookup, ["lang", "word"], how), left.join(lookup, ["lang", "word"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert hot_keys.join_unique(left.limit(0), lookup, ["lang", "word"]).count() == 0


# --- phrases -----------------------------------------------------------------

def test_many_phrases_in_one_walk(spark):
    many = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit(";")).alias("phrase"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    texts = spark.createDataFrame([(1, "en", "x k10; k11;k59998;"), (2, "fr", "k11;k10;"), (3, None, "k10;"), (4, "en", None)], "id int, lang string, text string")
    got = phrases.phrase_hits(texts, many, ["id"], ["phrase"], scope=["lang"], broadcast_chars=100_000)
    assert rows(got, "id", "phrase", "at") == [(1, "k10;", 2), (1, "k59998;", 11), (2, "k11;", 0)]
    covered = phrases.with_phrase_spans(texts, many.select("phrase")).select("id", phrases.covered_chars().alias("n"))
    assert rows(covered, "id", "n") == [(1, 15), (2, 8), (3, 4), (4, 0)]


def test_phrase_search_finds_every_place_both_ways(spark):
    r = random.Random(7)
    texts = [(i, "".join(r.choice("ab é😀") for _ in range(r.randrange(0, 2600)))) for i in range(12)]
    needles = ["a", "ab", "aba", "b a", "abab ba", "é😀a", " é é", "ab" * 9, texts[3][1][1000:1060], texts[5][1][1015:1031]]
    needles = sorted({n for n in needles if n})
    want = sorted((i, n, p) for i, t in texts for n in needles for p in range(len(t)) if t.startswith(n, p))
    t = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame([(n,) for n in needles], "phrase string")
    for limit in (10_000, 0):
        assert rows(phrases.phrase_hits(t, p, ["id"], ["phrase"], broadcast_chars=limit), "id", "phrase", "at") == want


TRIG = "kind string, lang string, phrase string, weight double, seq int"


def test_matching_modes(spark):
    s = segs(spark, ["look HERE now", "we see this", "nothing"]).withColumn("lang", F.lit("en"))
    t = spark.createDataFrame([("raw", "", "here", 2.0, 0), ("strict", "en", "see", 1.5, 0), ("strict", "ru", "nothing", 9.0, 1)], TRIG)
    vectors = spark.createDataFrame([("v", i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.8, 0.6]])], "video_id string, seg_idx int, embedding array<float>")
    named = spark.createDataFrame([(0, "up", 1.0, [0.0, 1.0]), (1, "right", 1.0, [2.0, 0.0])], "seq int, phrase string, weight double, embedding array<float>")
    more = {"vectors": vectors, "phrase_vectors": named}
    assert rows(matching.match_segments(s, t, "keywords_only", **more), "seg_idx", "reason") == [(0, "raw"), (1, "strict:en")]
    assert rows(matching.match_segments(s, t, "semantic", **more), "seg_idx", "reason") == [(0, "raw"), (1, "universal"), (2, "universal")]
    assert rows(matching.match_segments(s, t, "hybrid", **more), "seg_idx", "reason", "phrase") == [(0, "raw", "here"), (1, "strict:en", "see"), (2, "universal", "right")]
    one = rows(matching.match_universal(vectors, named, 0.1), "seg_idx", "phrase")
    assert rows(matching.match_universal(vectors, named, 0.1, vectors_per_pass=1), "seg_idx", "phrase") == one


def test_first_ending_longest_phrase_wins(spark):
    t = spark.createDataFrame([("raw", "", "new york", 1.0, 0), ("raw", "", "york", 2.0, 1), ("raw", "", "york city", 3.0, 2)], TRIG)
    assert rows(matching.match_raw(segs(spark, ["in New York City"]), t), "phrase", "weight") == [("new york", 1.0)]


# --- quality and classifiers -------------------------------------------------

def test_hallucinations(spark):
    cases = [("Python Python", 30.0, True), ("We're no strangers to love", 21.9, False), ("", 1.0, True), ("  ", 1.0, True), ("[Music]", 2.0, True),
             ("Like and subscribe!", 2.0, True), ("like and subscribe to us please", 2.0, False), ("Продолжение следует...", 2.0, True), ("ok", 4.9, False)]
    df = spark.createDataFrame([("v", i, 0.0, s, t) for i, (t, s, _) in enumerate(cases)], SEG)
    kept, dropped = quality.filter_hallucinations(df)
    assert {r.seg_idx for r in dropped.collect()} == {i for i, c in enumerate(cases) if c[2]}
    assert kept.count() == sum(not c[2] for c in cases)


def test_quality_golden_cases(spark):
    cases = [
        ("by_hand", "en", "youtube_manual", "Today our garden club repots the tall ferns near the window."),
        ("plain", "en", "youtube_auto", "The river rose after rain and our boat drifted past the old mill. Nobody on the bank saw it pass."),
        ("noise", "ru", "youtube_auto", "щвпрк лдоэж зцбнт фывпр ждлцк бтюьм нгшщх цукен вапрж"),
        ("stuck", "en", "whisper", " ".join(["see you next week"] * 6)),
        ("tune", "en", "youtube_auto", "[Music] [Applause] [Music] [Music] fine"),
    ]
    known = {w.strip(".").lower() for c in cases[:2] for w in c[3].split()} | {"see", "you", "next", "week", "fine"}
    words = spark.createDataFrame([("en", w) for w in sorted(known)], "language string, word string")
    boilerplate = spark.createDataFrame([("see you next week",)], "phrase string")
    videos = spark.createDataFrame(cases, "video_id string, language string, source string, text string")
    one = spark.createDataFrame([(c[0], 0, 0.0, 12.0, c[3]) for c in cases], SEG)
    got = {r.video_id: r for r in quality.quality_report(videos, one, words, boilerplate).collect()}
    want = {"by_hand": 1.0, "plain": 17 / 18, "noise": 16 / 35, "stuck": 4.7 / 11, "tune": 0.3}
    assert {k: got[k].score for k in got} == pytest.approx(want)
    assert got["by_hand"].recommendation == got["plain"].recommendation == "use_as_is"
    assert "high_oov" in got["noise"].flags and "boilerplate_hallucinations" in got["stuck"].flags and got["tune"].flags == ["mostly_music"]


def test_trigram_share(spark):
    texts = ["a b c a b c a b c", "A b c d e f", "a b c d e", None, "", "x x x x x x x", "a b\nc a  b c"]
    want = [3 / 7, 1 / 4, 0.0, 0.0, 0.0, 1.0, 2 / 4]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", quality.trigram_repetition(F.col("t"))).collect())]
    assert got == pytest.approx(want)


def test_tutorial_and_types(spark):
    steps = segs(spark, ["click the button", "now press enter", "select it", "and save"] * 3)
    row = detect.detect_tutorial(steps).first()
    assert row.is_tutorial and row.action_count == 12 and row.sample_matches[:3] == ["click", "press", "select"]
    assert detect.detect_video_type(steps).first().video_type == "tutorial"
    assert detect.detect_video_type(segs(spark, ["blah blah"] * 20)).first().video_type == "talking_head"
    assert detect.detect_video_type(segs(spark, ["blah"])).first().video_type == "generic"
    assert detect.detect_video_type(segs(spark, ["сегодня я дома", "вчера я был"])).first().video_type == "vlog"


# --- packing -----------------------------------------------------------------

def brute_pack(sizes, budget, least):
    chunk, items, total, out = 0, 0, 0, []
    for n in sizes:
        if items >= least and total + n > budget:
            chunk, items, total = chunk + 1, 0, 0
        items, total = items + 1, total + n
        out.append(chunk)
    return out


@pytest.mark.parametrize("least,budget", [(1, 50), (2, 50), (2, 5), (3, 200)])
def test_greedy_chunks_match_the_fold_in_blocks_of_any_size(spark, least, budget):
    r = random.Random(11)
    sizes = {"a": [r.randrange(1, 40) for _ in range(230)], "b": [r.randrange(1, 90) for _ in range(5)]}
    data = [(k, i, n) for k, ns in sizes.items() for i, n in enumerate(ns)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "video_id string, i int, n int").repartition(4)
    want = sorted((k, i, c) for k, ns in sizes.items() for i, c in enumerate(brute_pack(ns, budget, least)))
    for block in (1, 3, 16, 1000):
        assert rows(packs.greedy_chunks(df, "i", "n", budget, least, block_rows=block), "video_id", "i", "chunk") == want


def brute_frames(frames, distance):
    kept = []
    for i, h in sorted(frames):
        if all(((h ^ k) & (1 << 64) - 1).bit_count() > distance for _, k in kept):
            kept.append((i, h))
    return [i for i, _ in kept]


@pytest.mark.parametrize("distance", [0, 5, 9])
def test_frames_are_kept_as_by_the_fold(spark, distance):
    r = random.Random(5)
    windows_of, data = {}, []
    for w in range(8):
        looks = [r.getrandbits(64) - (1 << 63) for _ in range(4)]
        frames = []
        for i in range(50):
            h = r.choice(looks)
            for _ in range(r.randint(0, 6)):
                h ^= 1 << r.randrange(63)
            frames.append((i, h))
        windows_of[w] = brute_frames(frames, distance)
        data += [("v", w, i, h) for i, h in frames]
    # Each frame near the one before: every other stays, round by round.
    chain = [(i, (1 << 6 * i) - 1) for i in range(9)]
    windows_of[90] = brute_frames(chain, distance)
    data += [("v", 90, i, h) for i, h in chain] + [("v", 0, 900, None)]
    r.shuffle(data)
    got = packs.dedup_frames(spark.createDataFrame(data, "video_id string, win_idx int, frame_idx int, hash long").repartition(3), distance)
    want = sorted([(w, i) for w, kept in windows_of.items() for i in kept] + [(0, 900)])
    assert sorted((x.win_idx, x.frame_idx) for x in got.collect()) == want


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def test_running_values_read_their_input_once(spark, monkeypatch, tmp_path):
    from talkframe.sources import artifacts

    monkeypatch.setattr(ordered.block_of, "__defaults__", (10,))
    spark.createDataFrame([(f"v{i % 3}", i // 3, float(i), i + 0.5, f"t{i}") for i in range(300)], "video_id string, seg_idx int, start double, end double, text string").write.parquet(f"{tmp_path}/s")
    segments = spark.read.parquet(f"{tmp_path}/s")
    for df in (ordered.numbered(segments, ["video_id"], "seg_idx"), artifacts.to_timestamped_txt(segments), artifacts.paragraph_rows(segments)):
        plan = final_plan(df)
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_running_values_of_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [("a", i) for i in range(5)], "k string, i int")
    got = ordered.running_before(df, ["k"], ["i"], ordered.block_of("i", 7), {"n": ("sum", F.lit(1))})
    assert got.filter("n <> i").count() == 0 and got.count() == 45 and got.columns == ["k", "i", "n"]


def test_cap_stops_at_the_first_overflow(spark):
    got = rows(packs.cap_transcript(segs(spark, ["a" * 20, "b" * 50, "c"]), 60), "seg_idx", "line")
    assert got == [(0, "[00:00:00] " + "a" * 20), (1, "[...truncated...]")]


# --- channels, targets -------------------------------------------------------

def test_cursor_moves_only_when_it_should(spark):
    at = datetime(2024, 1, 2)
    ch = spark.createDataFrame([("old", "x", datetime(2024, 1, 1)), ("new", None, None), ("idle", "y", datetime(2024, 1, 1))], "channel_id string, last_seen_video_id string, last_seen_published timestamp")
    entries = spark.createDataFrame([("old", "b", at, 0), ("new", "c", at, 0)], "channel_id string, video_id string, published timestamp, pos int")
    seen = lambda df: {r.channel_id: r.last_seen_video_id for r in df.collect()}
    assert seen(channels.advance_cursor(ch, entries)) == {"old": "b", "new": "c", "idle": "y"}
    assert seen(channels.advance_cursor(ch, entries, is_override=True)) == {"old": "x", "new": "c", "idle": "y"}
    assert seen(channels.advance_cursor(ch, entries, kept=entries.limit(0))) == {"old": "x", "new": None, "idle": "y"}
    with pytest.raises(channels.MissingCursorError, match="new"):
        channels.require_cursor(ch.withColumn("handle", F.lit(None).cast("string")), None)


def test_unknown_dates_and_lengths_pass(spark):
    t = spark.createDataFrame([(1, date(2024, 1, 1), 60), (2, None, None), (3, date(2024, 2, 1), 61)], "id int, upload_date date, duration_sec int")
    assert rows(targets.filter_targets(t, since=date(2024, 1, 15), include_shorts=False), "id") == [(2,), (3,)]


def test_date_window_arguments():
    today = date(2024, 5, 10)
    assert targets.date_window(days=9, today=today) == targets.DateWindow(date(2024, 5, 1), today)
    for bad in ({"days": 0}, {"days": 1, "since": today}, {"until": today}, {"since": today, "until": date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            targets.date_window(**bad, today=today)


def test_selection_errors(spark):
    for bad in ("", "0", "5-3", "x", "1,-2"):
        with pytest.raises(ValueError):
            targets.parse_selection(bad)
    df = spark.createDataFrame([("b", i) for i in range(3)], "batch string, i int")
    assert rows(targets.select_rows(df, "1,3", "i", ["batch"]), "i") == [(0,), (2,)]
    with pytest.raises(ValueError, match="out of range"):
        targets.select_rows(df, "4", "i", ["batch"])


# --- claims, responses, cost -------------------------------------------------

def test_claims(spark):
    df = spark.createDataFrame([(1, "78, 40"), (2, "124 750 and +4"), (3, "see arxiv.org/abs/2512.24601, «Vector Search» 36%")], "id int, caption string")
    got = rows(claims.extract_claims(df, ["id"]), "id", "kind", "value")
    assert got == [(1, "number", "40"), (1, "number", "78"), (2, "number", "+4"), (2, "number", "124 750"),
                   (3, "number", "36%"), (3, "term", "Vector Search"), (3, "url", "arxiv.org/abs/2512.24601")]


def test_scripts_are_counted_once(spark):
    langs = F.array(F.lit("ru"), F.lit("fr"), F.lit("fa"))
    texts = [(0, "xx", "слово abc"), (1, "fr", "слово"), (2, "xx", "abc def я"), (3, "xx", "12 34"), (4, None, "ab яб"), (5, "xx", None), (6, "", "שלום"), (7, "xx", "日本 а")]
    df = spark.createDataFrame(texts, "id int, lang string, t string")
    out = df.select("id", X.script_of("t").alias("script"), X.anchor_language("lang", "t", langs).alias("anchor"))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (0, "cyrillic", "ru"), (1, "cyrillic", "fr"), (2, "latin", "fr"), (3, None, "ru"), (4, "cyrillic", "ru"), (5, None, "ru"), (6, "arabic", "fa"), (7, "cjk", "ru")]
    for column in (X.script_of("t").alias("x"), X.anchor_language("lang", "t", langs).alias("x")):
        plan = df.select(column)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == 4


def test_phrase_vectors_meet_rows_in_one_step(spark):
    vectors = spark.createDataFrame([("v", i, [float(i % 3 == k) for k in range(3)]) for i in range(3000)], "video_id string, seg_idx int, embedding array<double>")
    named = spark.createDataFrame([(k, f"p{k}", 1.0, [float(k == j) for j in range(3)]) for k in range(3)], "seq bigint, phrase string, weight double, embedding array<double>")
    found = matching.match_universal(vectors, named, 0.5, vectors_per_pass=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows(found, "seg_idx", "phrase") == [(i, f"p{i % 3}") for i in range(3000)]


def test_grounding(spark):
    cap = spark.createDataFrame([("r", "i", "+3 of 142 at https://x.org/a «векторную базу»")], "report_id string, image string, caption string")
    atoms = spark.createDataFrame([("r", "i", ["34"], [], ["router.py 142 правки", "векторная база"])], "report_id string, image string, numbers array<string>, urls array<string>, terms array<string>")
    verdicts = {r.value: r.verdict for r in claims.ground_claims(cap, atoms).collect()}
    assert verdicts == {"+3": "hallucination", "142": "ok", "https://x.org/a": "hallucination", "векторную базу": "ok"}
    said = spark.createDataFrame([("r", "i", "the number is 3, really")], "report_id string, image string, transcript string")
    out = claims.ground_claims(cap, atoms, said)
    assert {r.value: r.verdict for r in out.collect()}["+3"] == "transcript_grounded"
    issue = claims.grounding_issues(out).first()
    assert (issue.severity, issue.blocking, issue.transcript_grounded) == ("hallucination", True, 1)


def test_grounding_looks_once_for_each_claim(spark):
    cap = spark.createDataFrame([("r", "i", "a 7 at x.org/a «Some Thing»")], "report_id string, image string, caption string")
    atoms = spark.createDataFrame([("r", "i", [], [], [])], "report_id string, image string, numbers array<string>, urls array<string>, terms array<string>")
    said = spark.createDataFrame([("r", "i", "some things 7 x org a")], "report_id string, image string, transcript string")
    issues = claims.grounding_issues(claims.ground_claims(cap, atoms, said))
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(_s_numbers") == 1 and plan.count("Contains(_s_terms") == 1
    assert rows(issues, "hallucination", "transcript_grounded", "unconfirmed") == [(0, 2, 0)]


def test_grounding_shuffles_inputs_and_not_claims(spark):
    said = [("r", "i", "a 7 at x.org/a «Some Thing»"), ("r", "i", "a 7 at x.org/a «Some Thing»"), ("r", "i", "8 and 7"), ("r", None, "9"), ("r", None, "9"), (None, "j", None)]
    items = spark.createDataFrame(said, "report_id string, image string, caption string").repartition("report_id", "image")
    keys, nothing = ["report_id", "image"], F.array().cast("array<string>")
    atoms = items.select(*keys, F.array("caption").alias("terms"), nothing.alias("numbers"), nothing.alias("urls")).distinct()
    found = claims.grounding_issues(claims.ground_claims(items, atoms, items.select(*keys, F.col("caption").alias("transcript"))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 3
    verdicts = claims.ground_claims(items, atoms.groupBy(*keys).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("numbers", "urls", "terms")]))
    assert rows(verdicts.na.fill("-"), "image", "kind", "value", "verdict") == [
        ("-", "number", "9", "hallucination"), ("i", "number", "7", "ok"), ("i", "number", "8", "ok"),
        ("i", "term", "Some Thing", "ok"), ("i", "url", "x.org/a", "ok"),
    ]


def test_responses(spark):
    raw = spark.createDataFrame([(1, '{"title": "T", "sections": [{"title": "S", "key_points": ["a", 2, ["x"], null], "timestamps": "[00:01]"}, 5]}'), (2, "sorry"), (3, "")], "response_id int, raw string")
    got = {r.response_id: r for r in responses.parse_outlines(raw).collect()}
    assert got[1].title == "T" and got[1].sections[0].key_points == ["a", "2"] and got[1].sections[0].timestamps == ["00:01"]
    assert got[2].sections[0].title == "Raw model output" and got[2].sections[0].summary == "sorry"
    assert got[3].sections == []


def test_cost(spark):
    calls = spark.createDataFrame([("r", "s", "m", 1_000_000, 0, 400_000), ("r", "s", "m", 10, 0, 20), ("r", "t", "?", 5, 5, 0)],
                                  "run_id string, stage string, model string, prompt_tokens bigint, output_tokens bigint, cached_tokens bigint")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_rate double, output_rate double")
    got = {(r.stage, r.is_total): r.cost_usd for r in cost.cost_by_stage(calls, prices).collect()}
    assert got == {("s", False): 0.700005, ("t", False): 0.0, (None, True): 0.700005}
    assert rows(cost.unpriced_models(calls, prices), "model") == [("?",)]


def test_columns(spark):
    df = spark.createDataFrame([("1:02", "youtu.be/abc"), ("1:12:07.5", None), ("::", "x"), ("-3", "x")], "t string, u string")
    assert [r[0] for r in df.select(X.parse_timestamp("t")).collect()] == [62.0, 4327.5, None, None]
    stamps = spark.createDataFrame([(59.9996,), (-1.0,), (3661.5,)], "s double").select(X.format_timestamp("s", ","))
    assert [r[0] for r in stamps.collect()] == ["00:00:60,000", "00:00:00,000", "01:01:01,500"]


def test_streamed_entries_of_several_batches_are_all_there(spark, tmp_path):
    """Old and undated entries that arrive after new ones are not late."""
    from talkframe.streaming import live

    batches = [[("c1", "new1", 9, datetime(2024, 5, 1)), ("c1", "new2", 8, datetime(2024, 4, 30))], [("c2", "old1", 7, datetime(2019, 1, 1)), ("c1", "new1", 9, datetime(2024, 5, 1))], [("c3", "old2", 5, datetime(1970, 1, 1)), ("c2", "old3", 4, datetime(2010, 1, 1))]]
    schema = "channel_id string, video_id string, pos bigint, published timestamp"
    for k, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(f"c{i}", None, None) for i in (1, 2, 3)], "channel_id string, last_seen_video_id string, last_seen_published timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stream_new_entries(stream, known).writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "video_id") == [("new1",), ("new2",), ("old1",), ("old2",), ("old3",)]


def test_defaults_are_used(spark):
    """Known prices and closing lines where no table is given, and a mean perplexity as one part of the score."""
    calls = spark.createDataFrame([("r", "s", m[0], 1_000_000, 0, 0) for m in MODEL_PRICES], "run_id string, stage string, model string, prompt_tokens bigint, output_tokens bigint, cached_tokens bigint")
    assert {r.priced for r in cost.price_calls(calls).collect()} == {True}
    text = "Thank you for watching. " * 8
    schema = "video_id string, language string, source string, text string, mean_perplexity double"
    videos = spark.createDataFrame([("a", "en", "whisper", text, None), ("b", "en", "whisper", text, 500.0)], schema)
    words = spark.createDataFrame([("en", w) for w in ("thank", "you", "for", "watching")], "language string, word string")
    one = spark.createDataFrame([(v, 0, 0.0, 12.0, text) for v in "ab"], SEG)
    got = {r.video_id: r for r in quality.quality_report(videos, one, words).collect()}
    assert "boilerplate_hallucinations" in got["a"].flags and got["b"].perplexity == 1.0 and "high_perplexity" in got["b"].flags
    assert got["a"].score > got["b"].score


def test_odd_vectors_and_languages_match_nothing_or_by_default(spark):
    schema = "video_id string, seg_idx int, embedding array<double>"
    vectors = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, None), ("v", 2, [1.0]), ("v", 3, [1.0, None]), ("v", 4, [0.0, 1.0])], schema)
    phrases_ = spark.createDataFrame([(1, "p", 1.0, [1.0, 0.1]), (2, "q", 1.0, None)], "seq bigint, phrase string, weight double, embedding array<double>")
    assert rows(matching.match_universal(vectors, phrases_, 0.5), "seg_idx", "phrase") == [(0, "p")]
    rules = spark.createDataFrame([("strict", "en", "red fox", 1.0, 0)], "kind string, lang string, phrase string, weight double, seq bigint")
    talk = segs(spark, ["A red fox.", "nothing"]).withColumn("lang", F.lit(None).cast("string"))
    assert rows(matching.match_segments(talk, rules, "keywords_only"), "seg_idx", "reason") == [(0, "strict:en")]


# --- steps that are worked out once ------------------------------------------

def test_unknown_words_are_found_in_the_row_and_written_once(spark):
    texts = spark.createDataFrame(
        [("a", "en", "One two, two ZZZ"), ("a", "en", "zzz one"), ("a", "en", None), ("b", "en", "zzz"), ("c", "en", "12 _x"), ("d", "xx", "one"), ("e", None, "one"), ("f", "fr", "one un")],
        "video_id string, language string, text string",
    ).repartition(3)
    listed = spark.createDataFrame([("en", "ONE"), ("en", "one"), ("en", "two"), ("fr", "un"), (None, "zzz")], "language string, word string")
    found = quality.oov_ratio(texts, listed, ["en", "fr"])
    assert rows(found, "video_id", "oov") == [("a", 1 / 6), ("b", 1.0), ("c", 1.0), ("d", -1.0), ("e", -1.0), ("f", 0.5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "to_json" not in plan


def test_soft_matches_split_their_texts_once(spark):
    texts = spark.createDataFrame([("v", i, "en", t) for i, t in enumerate(["The cats  ran", "a dog", None, "cats ran"])], "video_id string, seg_idx int, lang string, text string")
    lemmas = spark.createDataFrame([("en", "cats", "cat"), ("en", "ran", "run")], "lang string, word string, lemma string")
    found = matching.lemmatize(texts, lemmas, ["video_id", "seg_idx"])
    assert rows(found, "seg_idx", "lemma_text") == [(0, "cat run"), (1, "dog"), (3, "cat run")]
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_moment_kind_tries_a_pattern_once_and_only_where_its_letters_are(spark):
    import re

    from talkframe.functions import fixed_values as fixed

    heads = {p: fixed.leading_literals(p) for p in fixed.ACTION_PATTERNS + fixed.CONNECTIVE_PATTERNS}
    assert heads[r"\bжмём?\b"] == ["жмё"] and heads[r"\bafterwards?\b"] == ["afterward"] and heads[r"\bнажм[уём]\b"] == ["нажм"]
    assert heads[r"\bпереместим|перетащим|потащим\b"] == ["переместим", "перетащим", "потащим"] and fixed.leading_literals(r"\w+|then") == []
    odd = ["CLİCK preſs Klick ıt", "clıck, PREſſED then", "Straße press select OPEN", "Нажму, затем ШАГ", "НАЖМЁМ затем ᲀвод", "перетащимся Потащим потом шаг", "thenclick nextopen", "first second third", "", None]
    said = [f"{a} {b} {c}" for a in ("Click", "хклик", "ВВЕДИТЕ", "go to") for b in ("then", "ПОСЛЕ ЧЕГО", "step") for c in ("", "tapped, entered", "pasted!")]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(odd + said)], "i int, t string")

    def plain(patterns):
        t = F.coalesce("t", F.lit(""))
        return sum((t.rlike("(?iU)" + p).cast("int") for p in patterns), F.lit(0))

    a, c = plain(fixed.ACTION_PATTERNS), plain(fixed.CONNECTIVE_PATTERNS)
    want = F.when((c >= 3) | ((a >= 2) & (c >= 1)) | (a >= 3), "procedure").otherwise("showcase")
    counted = data.select("t", want.alias("want"), X.moment_kind("t").alias("kind"), a.alias("a"), X.pattern_hits(F.coalesce("t", F.lit("")), X.case_folded(F.coalesce("t", F.lit(""))), fixed.ACTION_PATTERNS).alias("hits"))
    assert [r for r in counted.collect() if r.want != r.kind or r.a != r.hits] == []
    plan = data.select(X.moment_kind("t").alias("kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RLIKE|rlike", plan)) <= len(heads) + 2


def test_lemmas_meet_words_of_chunks_and_not_tokens(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK_CHARS", 64)
    monkeypatch.setattr(matching, "HELD_WORDS", 5)
    said = ["The cats  ran", "a\u2003dog\x1cran", None, "the", "", "cats cats", "ran the İzmir"]
    texts = [("v", i, "en", t) for i, t in enumerate(said)] + [(None, 0, "en", "cats"), ("w", None, "fr", "the chats"), ("x", 0, "xx", "cats"), ("y", 0, None, "cats")]
    texts += [("v", 5, "en", "ran a dog"), ("v", 5, "fr", "chats")]
    lemmas = [("en", "cats", "cat"), ("en", "cats", "catz"), ("en", "ran", "run"), ("en", "dog", None), ("fr", "chats", "chat"), (None, "cats", "no")]
    found = matching.lemmatize(
        spark.createDataFrame(texts, "video_id string, seg_idx int, lang string, text string").repartition(3), spark.createDataFrame(lemmas, "lang string, word string, lemma string"), ["video_id", "seg_idx"]
    )
    assert rows(found.na.fill("-").na.fill(-1), "video_id", "seg_idx", "lang", "lemma_text") == [
        ("-", 0, "en", "cat"), ("v", 0, "en", "cat run"), ("v", 1, "en", "dog\x1cran"), ("v", 5, "en", "cat run cat dog"), ("v", 5, "fr", "chat"), ("v", 6, "en", "run i̇zmir"), ("w", -1, "fr", "the chat"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
