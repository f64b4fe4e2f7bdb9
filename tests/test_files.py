"""Files in, files out, and streams."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talkframe.operators import batch, channels, ordered
from talkframe.sources import artifacts as A
from talkframe.sources import transcripts as S
from talkframe.streaming import live

SEG = "video_id string, seg_idx int, start double, end double, text string"


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def parsed(df, *columns):
    return [tuple(r) for r in df.orderBy("file", "seg_idx").select(*columns).collect()]


def test_srt(spark, tmp_path):
    text = "1\n00:00:01,500 --> 00:00:02.000\nhello\nworld\n\n00:00:03,000 --> 00:00:04,000\nno index\n\n\n7\n00:00:05,000 --> 00:00:06,000\n\njunk\n"
    path = put(tmp_path, a__srt=text, b__srt="1\n0:00:01,5 --> 0:00:02,50\nshort\n")
    assert parsed(S.read_srt(spark, f"{path}/a.srt"), "start", "end", "text") == [(1.5, 2.0, "hello world"), (3.0, 4.0, "no index"), (5.0, 6.0, "")]
    assert S.read_srt(spark, f"{path}/b.srt").count() == 0
    assert parsed(S.read_srt(spark, f"{path}/b.srt", lenient=True), "start", "end", "text") == [(1.005, 2.05, "short")]
    assert [r[0] for r in parsed(S.read_srt(spark, f"{path}/a.srt", lenient=True), "text")] == ["hello world", "no index"]


def test_txt_json_and_captions(spark, tmp_path):
    path = put(
        tmp_path,
        a__txt="[00:00:01.000 --> 00:00:02.500] hi there\nnoise\n[00:01:00.000 --> 00:01:01.000] again\n", b__txt="  plain\ntext ",
        c__json=json.dumps({"language": "en", "segments": [{"start": 1, "end": 2, "text": "x"}, {"start": 3}, {"text": "y"}]}),
        d__json3=json.dumps({"events": [{"tStartMs": 500, "dDurationMs": 250, "segs": [{"utf8": "a"}, {"utf8": " b"}]}, {"tStartMs": 1}, {"tStartMs": 2, "segs": [{"utf8": "\n"}]}, {"tStartMs": 1000, "segs": [{"utf8": "c"}]}]}),
        e__srv3='<p t="100" d="50" w="1">a <s>b</s></p><p t="200" d="50"> </p><p t="300" d="50">c</p>',
    )
    assert parsed(S.read_timestamped_txt(spark, f"{path}/*.txt"), "start", "end", "text") == [(1.0, 2.5, "hi there"), (60.0, 61.0, "again"), (0.0, 0.0, "plain\ntext")]
    assert parsed(S.read_transcript_json(spark, f"{path}/c.json"), "language", "seg_idx", "start", "text") == [("en", 0, 1.0, "x"), ("en", 1, 0.0, "y")]
    assert parsed(S.read_caption_json3(spark, f"{path}/d.json3"), "seg_idx", "start", "end", "text") == [(0, 0.5, 0.75, "a b"), (1, 1.0, 1.0, "c")]
    assert parsed(S.read_caption_srv(spark, f"{path}/e.srv3"), "seg_idx", "start", "end", "text") == [(0, 0.1, 0.15, "a b"), (1, 0.3, 0.35, "c")]


def test_feed_manifest_and_urls(spark, tmp_path):
    head = '<feed xmlns:yt="http://www.youtube.com/xml/schemas/2015" xmlns="http://www.w3.org/2005/Atom"><title>Chan</title>'
    good = head + "<entry><yt:videoId>v1</yt:videoId><yt:channelId>UC1</yt:channelId><title>One</title><published>2026-05-12T14:00:00+00:00</published></entry><entry><title>no id</title></entry><entry><yt:videoId>v2</yt:videoId><published>soon</published></entry></feed>"
    manifest = {"videos": [
        {"index": 1, "status": "ok", "files": {"srt": "a.srt", "txt": "a.txt"}}, {"index": 2, "status": "failed", "files": {"txt": "b.txt"}},
        {"index": 3, "status": "ok", "files": {"txt": "../x.txt"}}, {"index": 4, "status": "ok", "files": {"json": "c.json"}}, {"index": 5, "status": "ok"},
    ]}
    path = put(tmp_path, f1__xml=good, f2__xml="<feed><entry>", m__json=json.dumps(manifest), u__lst="# c\n\n https://a/x # note\nhttps://b#frag\n")
    got = S.read_channel_feed(spark, f"{path}/*.xml").orderBy("pos").select("video_id", "title", "channel_id", F.year("published")).collect()
    assert [tuple(r) for r in got] == [("v1", "One", "UC1", 2026), ("v2", "", "", 1970)]
    assert [tuple(r) for r in S.read_manifest(spark, f"{path}/m.json").select("index", "rel_path").collect()] == [(1, "a.txt"), (4, "c.json")]
    assert [r.url for r in S.read_url_list(spark, f"{path}/u.lst").orderBy("pos").collect()] == ["https://a/x", "https://b#frag"]


def test_words(spark):
    words = [("v", i, f"w{i}", None, i * 0.5, i * 0.5 + 0.4) for i in range(20)]
    words[3] = ("v", 3, "w3", "W3.", 1.5, 1.9)
    df = spark.createDataFrame(words, "video_id string, word_idx int, word string, punctuated_word string, start double, end double")
    got = [tuple(r) for r in S.words_to_segments(df).orderBy("seg_idx").select("seg_idx", "start", "end").collect()]
    assert got == [(0, 0.0, 1.9), (4, 2.0, 9.4), (19, 9.5, 9.9)]


def _document(pieces):
    """The document of one key; places and offsets fit the pieces."""
    found = pieces.orderBy("position").collect()
    text = "".join(r.piece for r in found)
    at = 0
    for k, r in enumerate(found):
        assert (r.position, r.offset) == (k, at)
        at += len(r.piece.encode())
    return text


@pytest.mark.parametrize("block", [4, 100_000])
def test_pieces_are_the_document_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(ordered.block_of, "__defaults__", (block,))
    df = spark.createDataFrame([("v", i * 3, float(i), i + 0.5, f" t{i}é " if i != 7 else None) for i in range(23)], SEG).repartition(5)
    blocks = [f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},500\n{f't{i}é' if i != 7 else ''}\n" for i in range(23)]
    # A piece that is null is empty, but keeps its place and separator.
    assert _document(A.to_srt(df)) == "\n".join(b if i != 7 else "" for i, b in enumerate(blocks))
    assert _document(A.video_totals(df)) == " ".join(f" t{i}é " if i != 7 else "" for i in range(23))
    assert A.to_srt(df.limit(0)).count() == 0


def test_written_documents_are_cut_by_bytes_and_read_as_one(spark, tmp_path):
    rows = [(v, i, float(i), i + 0.5, f"t{i} ü" * (1 + i % 5)) for v, n in (("v", 200), ("w", 3)) for i in range(n)]
    pieces = A.to_srt(spark.createDataFrame(rows, SEG))
    A.write_documents(pieces, str(tmp_path / "out"), part_bytes=1000)
    for video in ("v", "w"):
        files = sorted((tmp_path / "out" / f"video_id={video}").glob("part=*/*.txt"))
        assert len(files) == len({f.parent for f in files}) and all(f.stat().st_size < 1200 for f in files)
        assert b"".join(f.read_bytes() for f in files).decode() == _document(pieces.filter(F.col("video_id") == video)) + "\n"
    entries = spark.createDataFrame([("v", i, 100 * i, f"line {i} " + "x" * 90 + "\n") for i in range(30)], "video_id string, position long, offset long, piece string")
    A.write_documents(entries, str(tmp_path / "log"), part_bytes=500, newline="after")
    files = sorted((tmp_path / "log" / "video_id=v").glob("part=*/*.txt"))
    assert len(files) == 6 and "".join(f.read_text() for f in files) == "".join(r.piece for r in entries.orderBy("position").collect())


def test_json_documents_of_any_size(spark):
    segments = spark.createDataFrame([("v", i, float(i), i + 1.0, f'q"{i}') for i in range(9)] + [("lost", 0, 0.0, 1.0, "x")], SEG)
    videos = spark.createDataFrame([("v", "en", "b", 9.0, 0.5), ("empty", None, None, None, None)], "video_id string, language string, backend string, duration_sec double, quality double")
    pieces = A.to_transcript_json(videos, segments)
    v = json.loads(_document(pieces.filter("video_id = 'v'")))
    assert v["segments"][3] == {"start": 3.0, "end": 4.0, "text": 'q"3'} and len(v["segments"]) == 9 and (v["language"], v["quality"]) == ("en", 0.5)
    assert json.loads(_document(pieces.filter("video_id = 'empty'"))) == {"language": None, "backend": None, "duration_sec": None, "segments": [], "quality": None}
    statuses = spark.createDataFrame([("b", 2, "u2", "ok")], "batch string, index int, url string, status string")
    failures = spark.createDataFrame([("b", 1, "u1", "download", "403", None)], "batch string, index int, url string, stage string, error string, hint string")
    meta = spark.createDataFrame([("b", "2026-01-01", "file", None, "smart", "auto")], "batch string, created_at string, source_type string, source_url string, backend string, language string")
    made = json.loads(_document(batch.build_manifest(statuses, failures, meta)))
    assert made["stats"] == {"total": 2, "ok": 1, "failed": 1} and [v["url"] for v in made["videos"]] == ["u1", "u2"] and made["videos"][0]["error"] == "403"


def test_combined_document_has_head_contents_sections_and_moments(spark):
    schema = "batch string, index int, url string, video_id string, title string, upload_date date, duration_sec int, channel string, language string, text string, status string, score double, flags array<string>, recommendation string"
    videos = spark.createDataFrame([
        ("b", 1, "u1", "v1", "One", datetime(2024, 1, 2).date(), 65, "C", "en", " said ", "ok", 0.25, ["looped"], "low_quality"),
        ("b", 2, "u2", None, None, None, None, None, None, None, "failed", None, None, None),
    ], schema)
    meta = spark.createDataFrame([("b", "2026-01-01T10:00:00", "file", None, "smart", "auto", {"model": "x"})], "batch string, created_at string, source_type string, source_url string, backend string, language string, backend_options map<string,string>")
    visuals = spark.createDataFrame([("b", 1, 4, 61.5, "A slide. More", 3, ["k.png"], ["chart"], "raw"), ("b", 1, 9, 62.0, "B", 1, None, None, None), ("b", 2, 0, 0.0, "lost", 1, None, None, None)],
                                    "batch string, index int, moment int, start double, description string, importance int, keyframes array<string>, detected_objects array<string>, trigger_reason string")
    got = _document(batch.combined_document(videos, meta, visuals, banner="> mind\n\n"))
    assert got == (
        "---\nbatch_name: b\ncreated_at: 2026-01-01T10:00:00\nsource: file\nsource_url: null\ntotal: 2\nok: 1\nfailed: 1\nbackend: smart\nmodel: x\nlanguage: auto\n---\n"
        "> mind\n\n# Batch transcript — b — 2026-01-01\n\n2 videos, backend: smart. 1 succeeded, 1 failed.\n\n## Inputs\n\n"
        "1. [One](u1) — 2024-01-02 • 1:05 • C\n2. [(untitled)](u2) — ❌ failed\n"
        "\n---\n\n## 1. One\n\n| Field | Value |\n|---|---|\n| URL | u1 |\n| Video ID | v1 |\n| Date | 2024-01-02 |\n| Duration | 1:05 |\n| Channel | C |\n| Language detected | en |\n"
        "\nsaid\n\n⚠ **Quality: low_quality** (score=0.25, flags=[looped])\n"
        "\n### Visual moments\n\n#### 00:01:01.500 — A slide (importance: 3)\n\n![](k.png)\n\nA slide. More\n\nObjects detected: chart\n\nTrigger: `raw`\n\n"
        "#### 00:01:02.000 — B (importance: 1)\n\nB\n\nTrigger: ``\n\n"
    )


def test_paragraphs(spark):
    times = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 10), (10, 11)]
    df = spark.createDataFrame([("v", i, float(s), float(e), f"t{i}") for i, (s, e) in enumerate(times)], SEG)
    assert _document(A.to_paragraphs(df)) == "t0 t1 t2 t3 t4\n\nt5\n\nt6 t7"


def test_no_failures_no_log(spark, tmp_path):
    empty = spark.createDataFrame([], "batch string, index int, entry string")
    assert not A.write_log(empty, str(tmp_path / "log")) and not (tmp_path / "log").exists()


ENTRY = "channel_id string, video_id string, pos bigint, published timestamp"


def test_followed_channels_move_their_cursors_and_survive_a_rerun(spark, tmp_path):
    source, out, cursors = (str(tmp_path / n) for n in ("in", "out", "channels"))
    start = spark.createDataFrame([("c", "v0", datetime(2024, 1, 1))], "channel_id string, last_seen_video_id string, last_seen_published timestamp")
    start.write.parquet(f"{cursors}/version=0")
    days = [[("c", "v1", 5, datetime(2024, 1, 2)), ("c", "old", 9, datetime(2023, 12, 31))], [("c", "v2", 4, datetime(2024, 1, 3)), ("c", "v1", 5, datetime(2024, 1, 2))]]
    for day in days:
        spark.createDataFrame(day, ENTRY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRY).parquet(source)
        live.follow_channels(stream, cursors, out, str(tmp_path / "progress")).awaitTermination()
    assert sorted(r.video_id for r in spark.read.parquet(out).collect()) == ["v1", "v2"]
    latest = spark.read.parquet(cursors).orderBy(F.col("version").desc()).first()
    assert latest.last_seen_video_id == "v2"


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    runs = spark.createDataFrame([("1", "research", "2024-01-01"), ("2", "subscribes", "2024-01-02")], "id string, type string, timestamp string")
    channels.append_run(path, runs)
    channels.append_run(path, runs.withColumn("timestamp", F.lit("2024-02-01")))
    log = spark.read.parquet(path)
    assert [r.id for r in channels.list_runs(log, limit=3).collect()] == ["1", "2", "2"]
    assert channels.get_run(log, "1").first().timestamp == "2024-02-01"
