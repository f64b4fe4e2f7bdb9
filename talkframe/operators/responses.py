"""Model responses back into rows, and prompts out of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions import fixed_values as fixed
from talkframe.functions.columns import format_duration, none_if_empty, split_fixed, strip
from talkframe.operators.ordered import block_of, enclosed_pieces, first_n, placed_pieces, running_before

FACTS = "candidates array<struct<topic: string, text: string, source_timestamp: string>>"


def parse_candidates(responses: DataFrame) -> DataFrame:
    """Fact rows of raw responses: plain JSON, else fenced JSON, else the first ``{…}``.

    ``responses(response_id, raw)``. Items without text are left out.
    """
    def parsed(text):
        valid = F.try_parse_json(text)
        return F.when(valid.isNotNull(), F.coalesce(F.from_json(text, FACTS), F.from_json(F.lit("{}"), FACTS)))

    raw = F.col("raw")
    fenced = none_if_empty(F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1))
    braced = none_if_empty(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    facts = F.coalesce(parsed(raw), parsed(fenced), parsed(braced))
    return (
        responses.select("response_id", F.posexplode(facts["candidates"]).alias("fact_idx", "_f"))
        .select("response_id", "fact_idx", "_f.topic", "_f.text", "_f.source_timestamp")
        .filter("text != ''")
    )


def parse_indices(responses: DataFrame) -> DataFrame:
    """``(response_id, indices)``: the first ``[…]`` as whole numbers, null where there is none."""
    bracket = none_if_empty(F.regexp_extract("raw", r"\[[^\]]*\]", 0))
    values = F.from_json(bracket, "array<string>", {"mode": "PERMISSIVE"})
    numbers = F.transform(values, lambda v: F.floor(v.try_cast("double")).cast("long"))
    whole = F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)
    return responses.select("response_id", whole.alias("indices"))


def screen_rows(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates the response selected by 1-based ``pos``; all where it cannot be read.

    ``candidates(response_id, pos, …)``. Numbers out of range select nothing.
    """
    chosen = parse_indices(responses)
    kept = candidates.join(chosen, "response_id", "left")
    return kept.filter(F.col("indices").isNull() | F.array_contains("indices", F.col("pos").cast("long"))).drop("indices")


def _text(value, path: str):
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _strings(value):
    """A JSON value as a list of strings: the plain items of a list, a scalar as one item, else nothing."""
    empty = F.array().cast("array<string>")
    nested = "^(ARRAY|OBJECT|VOID)"
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: ~F.schema_of_variant(v).rlike(nested))
    kind, scalar = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(kind.startswith("ARRAY"), F.transform(items, lambda v: F.try_variant_get(v, "$", "string")))
        .when(kind.rlike(nested) | (F.trim(scalar) == ""), empty)
        .otherwise(F.coalesce(F.array(scalar), empty))
    )


def parse_outlines(responses: DataFrame) -> DataFrame:
    """Report outlines: ``(response_id, title, summary, sections)``.

    Code fences and text around the JSON are cut off. List fields may be single
    strings. A response that is no JSON becomes one section with its first 1000
    characters.
    """
    raw = F.col("raw")
    text = F.trim(F.regexp_replace(strip(raw), r"(?s)^```[^\n]*\n|\n```[^\n]*$", ""))
    body = F.coalesce(none_if_empty(F.regexp_extract(text, r"(?s)\{.*\}", 0)), text)
    doc = F.try_parse_json(body)
    empty = F.array().cast("array<string>")

    def listed(section, path):
        return F.array_compact(F.coalesce(_strings(F.try_variant_get(section, path, "variant")), empty))

    def section(s):
        stamps = F.transform(listed(s, "$.timestamps"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[\[\]]+|[\[\]]+$", "")))
        return F.struct(
            _text(s, "$.title").alias("title"),
            _text(s, "$.summary").alias("summary"),
            listed(s, "$.key_points").alias("key_points"),
            listed(s, "$.image_refs").alias("image_refs"),
            stamps.alias("timestamps"),
        )

    items = F.try_variant_get("_doc", "$.sections", "array<variant>")
    sections = F.transform(F.filter(items, lambda s: F.schema_of_variant(s).startswith("OBJECT")), section)

    def single(title, summary):
        return F.array(F.struct(
            F.lit(title).alias("title"), summary.alias("summary"), empty.alias("key_points"),
            empty.alias("image_refs"), empty.alias("timestamps"),
        ))

    blank = F.coalesce(raw, F.lit("")) == ""
    parsed = responses.withColumn("_doc", doc).withColumn("_ok", F.col("_doc").isNotNull())
    no_sections = F.filter(single("", F.lit("")), lambda s: F.lit(False))
    return parsed.select(
        "response_id",
        F.when(blank, F.lit("")).when(~F.col("_ok"), F.lit("Outline parse failed")).otherwise(_text("_doc", "$.title")).alias("title"),
        F.when(blank, F.lit("")).when(~F.col("_ok"), F.lit("LLM response could not be parsed as JSON.")).otherwise(_text("_doc", "$.summary")).alias("summary"),
        F.when(blank, no_sections).when(~F.col("_ok"), single("Raw model output", F.substring(raw, 1, 1000))).otherwise(F.coalesce(sections, no_sections)).alias("sections"),
    )


def assemble_outline(outlines: DataFrame) -> DataFrame:
    """``(video_id, title, summary, source_chunks, position, section)``: one outline per video from its chunk outlines, a row a section.

    ``outlines(video_id, chunk, title, summary, sections)``. Title of the first chunk, summaries joined and cut to 500
    characters, all sections in chunk order; ``position`` counts them from 0. A video without sections has one row without.
    """
    # Every summary adds a character at least, so 500 of them are enough.
    told = first_n(outlines.filter("summary != ''").select("video_id", "chunk", "summary"), ["video_id"], ["chunk"], 500)
    summaries = told.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "summary"))).alias("_s")
    ).select("video_id", F.substring(F.array_join(F.col("_s.summary"), " "), 1, 500).alias("summary"))
    heads = outlines.groupBy("video_id").agg(
        F.min_by("title", "chunk").alias("title"), F.count("*").alias("source_chunks")
    )
    listed = outlines.select("video_id", "chunk", F.posexplode("sections").alias("_nth", "section"))
    placed = running_before(listed, ["video_id"], ["chunk", "_nth"], block_of("chunk"), {"position": ("sum", F.lit(1))})
    return heads.join(summaries, "video_id", "left").join(placed.drop("chunk", "_nth"), "video_id", "left").select(
        "video_id", "title", F.coalesce("summary", F.lit("")).alias("summary"), "source_chunks", F.col("position").cast("long").alias("position"), "section"
    )


def overlay_segments(original: DataFrame, replacement: DataFrame) -> DataFrame:
    """Replacement texts on the original timing, by position.

    ``replacement(video_id, seg_idx, text)`` may be a correction or a translation. A
    video keeps its original texts unless the replacement has as many rows and a text
    in each.
    """
    have = original.groupBy("video_id").agg(F.count("*").alias("_n"))
    got = replacement.groupBy("video_id").agg(F.count("*").alias("_m"), F.count("text").alias("_t"))
    usable = have.join(got, "video_id").filter("_n = _m and _m = _t").select("video_id")
    texts = replacement.select("video_id", "seg_idx", F.col("text").alias("_new")).join(usable, "video_id", "left_semi")
    return (
        original.join(texts, ["video_id", "seg_idx"], "left")
        .withColumn("text", F.coalesce("_new", "text"))
        .drop("_new")
    )


def parse_segment_replies(replies: DataFrame) -> DataFrame:
    """``(video_id, seg_idx, text)`` of corrected or translated segments in raw model replies.

    ``replies(video_id, raw)``: a JSON array of objects with ``text``, in a code fence or not, in the order of the segments. A reply that is
    anything else gives no rows: no array, an item that is no object, or one without text.
    """
    bare = strip(F.regexp_replace(strip("raw"), r"^```(?:json)?\s*|\s*```\s*$", ""))
    items = F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>")
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$.text", "string"))
    whole = replies.select("video_id", texts.alias("_t")).filter(F.col("_t").isNotNull() & F.forall("_t", lambda t: t.isNotNull()))
    return whole.select("video_id", F.posexplode("_t").alias("seg_idx", "text"))


def apply_segment_replies(original: DataFrame, replies: DataFrame) -> DataFrame:
    """Segments with the texts of the replies on their own timing; a video whose reply is unreadable or of another length stays as it is."""
    return overlay_segments(original, parse_segment_replies(replies))


#: How a model is asked to choose rows of a list.
SCREENING_TASK = "Choose the videos of the list that fit what the user asks for."
SCREENING_FORM = "Answer with a JSON array of their numbers and nothing else, for example [1, 3, 5]."


def screening_prompts(candidates: DataFrame, requests: DataFrame, task: str = SCREENING_TASK, form: str = SCREENING_FORM) -> DataFrame:
    """``(response_id, position, offset, piece)``: a prompt per list of candidates, a piece a candidate; see :func:`screen_rows` for the answer.

    ``candidates(response_id, pos, title, channel, upload_date, duration_sec)`` with ``pos`` from 1, ``requests(response_id, wanted)``.
    Unknown facts are shown as ``?``. Lists without a request are left out.
    """
    head = F.concat(F.lit(f"{task}\n\nUser asks for: "), F.coalesce("wanted", F.lit("")), F.lit("\n\nCandidates, numbered from 1:"))
    ends = requests.select("response_id", head.alias("_head"), F.lit(f"\n\n{form}").alias("_end"))
    known = F.when(F.coalesce("duration_sec", F.lit(0)) > 0, format_duration("duration_sec")).otherwise(F.lit("?"))
    line = F.concat(
        F.lit("\n["), F.col("pos").cast("string"), F.lit("] "), F.coalesce(none_if_empty("title"), F.lit("(no title)")), F.lit(" — "),
        F.coalesce(none_if_empty("channel"), F.lit("?")), F.lit(" — "), F.coalesce(F.col("upload_date").cast("string"), F.lit("?")), F.lit(" — "), known,
    )
    asked = candidates.join(requests.select("response_id"), "response_id", "left_semi")
    return enclosed_pieces(ends, asked.select("response_id", F.col("pos").alias("_i"), line.alias("_piece")), "response_id")


def split_texts(texts: DataFrame, size: int, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys, piece_idx, piece)``: pieces of ``size`` characters."""
    return texts.select(*keys, F.posexplode(split_fixed(text, size)).alias("piece_idx", "piece"))


def prompt_headers(videos: DataFrame) -> DataFrame:
    """Add ``header``: number, title, known facts and source of each video.

    ``videos(pack_id, pos, title, stem, upload_date, duration_sec, language, url)``; pos
    counts from 1.
    """
    bits = F.array_join(
        F.array_compact(F.array(
            none_if_empty("upload_date"),
            F.when(F.col("duration_sec").isNotNull(), format_duration("duration_sec")),
            none_if_empty("language"),
        )),
        ", ",
    )
    header = F.concat(
        F.lit("### ["), F.col("pos").cast("string"), F.lit("] "), F.coalesce(none_if_empty("title"), F.col("stem")),
        F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(F.lit("")),
        F.when(none_if_empty("url").isNotNull(), F.concat(F.lit("\nSource: "), F.col("url"))).otherwise(F.lit("")),
    )
    return videos.withColumn("header", header)


def prompt_pack(videos: DataFrame, max_chars: int = 60_000) -> DataFrame:
    """``(pack_id, position, offset, piece)``: the transcript blocks of each pack, a piece each, in order.

    Needs the columns of :func:`prompt_headers` and ``body``. Bodies are cut at
    ``max_chars`` with a marker; an empty one says so.
    """
    cut = F.concat(F.rtrim(F.substring("body", 1, max_chars)), F.lit("\n[...truncated...]"))
    body = (
        F.when(F.coalesce("body", F.lit("")) == "", F.lit("(empty transcript)"))
        .when(F.length("body") <= max_chars, F.col("body"))
        .otherwise(cut)
    )
    block = F.concat(F.col("header"), F.lit("\n\n"), body, F.lit("\n\n---\n"))
    return placed_pieces(prompt_headers(videos), ["pack_id"], ["pos"], block_of("pos"), block, "\n")


# --- errors ------------------------------------------------------------------

def classify_errors(log: DataFrame, rules: list[fixed.ErrorRule] | None = None, text: str = "stderr") -> DataFrame:
    """Add ``error_class`` and ``retryable``: the first rule that matches, a platform's before the generic.

    ``log(platform, stderr)``.
    """
    rules = fixed.ERROR_RULES if rules is None else rules
    message = F.coalesce(F.col(text), F.lit(""))
    ordered = [r for r in rules if r.platform != "generic"] + [r for r in rules if r.platform == "generic"]
    verdict = None
    for rule in ordered:
        hit = message.rlike("(?iU)" + rule.pattern)
        if rule.platform != "generic":
            hit = (F.col("platform") == rule.platform) & hit
        value = F.struct(F.lit(rule.error_class).alias("c"), F.lit(rule.retryable).alias("r"))
        verdict = F.when(hit, value) if verdict is None else verdict.when(hit, value)
    unknown = F.struct(F.lit("unknown").alias("c"), F.lit(False).alias("r"))
    return (
        log.withColumn("_v", verdict.otherwise(unknown))
        .withColumn("error_class", F.col("_v.c"))
        .withColumn("retryable", F.col("_v.r"))
        .drop("_v")
    )
