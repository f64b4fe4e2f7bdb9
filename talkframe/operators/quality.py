"""Transcript quality: repetition, music, unknown words, boilerplate, and the report."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions import fixed_values as fixed
from talkframe.functions.columns import words
from talkframe.operators.hot_keys import join_unique
from talkframe.operators.phrases import covered_chars, with_phrase_spans
from talkframe.operators.tables import settled, small_table


# --- segment filter ----------------------------------------------------------

def filler_text(text) -> Column:
    """Comparison form of a segment: lower case, punctuation and white space squeezed."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.trim(F.regexp_replace(lowered, rf"(?U)[\s{fixed.FILLER_PUNCTUATION}]+", " "))


def is_hallucination(start="start", end="end", text="text") -> Column:
    """True for segments a speech recogniser most likely made up on silence.

    Empty text; a known filler as the whole text; or at least 5 s with under two
    characters a second and at most two distinct word stems.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = filler_text(clean)
    seconds = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    stems = F.size(F.array_distinct(F.transform(words(plain), lambda w: F.substring(w, 1, 4))))
    sparse = (
        (seconds >= fixed.FILLER_MIN_SECONDS)
        & (F.length(clean) / seconds < fixed.FILLER_MAX_CHARS_PER_SECOND)
        & (stems <= fixed.FILLER_MAX_STEMS)
    )
    return (clean == "") | plain.isin(fixed.FILLER_PHRASES) | sparse


def flag_hallucinations(segments: DataFrame) -> DataFrame:
    return segments.withColumn("is_hallucination", is_hallucination())


def filter_hallucinations(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split segments into (kept, dropped)."""
    flagged = flag_hallucinations(segments)
    kept = flagged.filter(~F.col("is_hallucination")).drop("is_hallucination")
    dropped = flagged.filter("is_hallucination").drop("is_hallucination")
    return kept, dropped


# --- single measures ---------------------------------------------------------

#: Characters whose trigrams are counted together.
SLICE_CHARS = 1 << 20


def _trigram_shares(texts: list[str]) -> np.ndarray:
    """Words as numbers, trigrams as one number each, counted by sorting."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    result = np.zeros(len(texts))
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for x in split for w in x), np.int64, int(sizes.sum()))
    if len(code) < 6:
        return result
    # Pairs of words by number, then a text and its pair and third word: what is sorted is one number at a time.
    pair = np.unique(code[:-1] * len(known) + code[1:], return_inverse=True)[1]
    triple = np.unique(pair[:-1] * len(known) + code[2:], return_inverse=True)[1]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[2:] == owner[:-2]
    width = int(triple.max()) + 1
    kinds, times = np.unique((owner[2:] * width + triple)[inside], return_counts=True)
    np.maximum.at(result, kinds // width, times)
    return np.where(sizes < 6, 0.0, result / np.maximum(sizes - 2, 1))


@F.pandas_udf(T.DoubleType())
def _top_trigram_share(texts: pd.Series) -> pd.Series:
    """All texts of a slice at once; a slice has about ``SLICE_CHARS`` characters."""
    values = texts.fillna("").tolist()
    out, begin, held = [], 0, 0
    for i, value in enumerate(values):
        if held and held + len(value) > SLICE_CHARS:
            out.append(_trigram_shares(values[begin:i]))
            begin, held = i, 0
        held += len(value)
    out.append(_trigram_shares(values[begin:]))
    return pd.Series(np.concatenate(out))


def trigram_repetition(text) -> Column:
    """Share of the most frequent word trigram; 0 under six words.

    Counts inside one text, in slices of Arrow batches: nothing is shuffled.
    """
    return _top_trigram_share(text)


def non_speech_ratio(segments: DataFrame) -> DataFrame:
    """Share of a video's time in segments marked as music, applause and the like."""
    seconds = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    marked = F.col("text").rlike(fixed.NON_SPEECH_PATTERN)
    total, music = F.sum(seconds), F.sum(F.when(marked, seconds).otherwise(F.lit(0.0)))
    return segments.groupBy("video_id").agg(
        F.when(total > 0, music / total).otherwise(F.lit(0.0)).alias("music")
    )


def words_of_rows(texts: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """``(video_id, language, n, words)``: how many words each row of a supported language has, and its distinct words; a null text has null."""
    supported = fixed.DICTIONARY_LANGUAGES if supported is None else supported
    found = F.regexp_extract_all(F.lower("text"), F.lit(fixed.WORD_PATTERN), F.lit(0))
    return (
        texts.filter(F.coalesce(F.col("language").isin(supported), F.lit(False)))
        .select("video_id", "language", found.alias("_w"))
        .select("video_id", "language", F.size("_w").cast("long").alias("n"), F.array_distinct("_w").alias("words"))
    )


def oov_ratio(texts: DataFrame, dictionary: DataFrame, supported: list[str] | None = None) -> DataFrame:
    """Distinct unknown words over all words, per video.

    ``texts(video_id, language, text)``, one or many rows a video;
    ``dictionary(language, word)``. −1 for a language without a word list, 1 where
    there are no words. The distinct words of each row are found in the row, and written once like the word list, as both are read several times;
    the most common words meet their entries by broadcast and only the others are shuffled, see
    :func:`talkframe.operators.hot_keys.join_unique`. Only unknown words are grouped by video.
    """
    supported = fixed.DICTIONARY_LANGUAGES if supported is None else supported
    known = dictionary.select("language", F.lower("word").alias("word")).distinct().withColumn("_known", F.lit(True))
    listed = settled(known.filter(F.col("language").isin(supported)))
    rows = settled(words_of_rows(texts, supported)).filter("n > 0")
    found = rows.select("video_id", "language", F.explode("words").alias("word"))
    unknown = join_unique(found, listed, ["language", "word"], "left").filter(F.col("_known").isNull()).select("video_id", "language", "word").distinct()
    counts = rows.select("video_id", "n", F.lit(0).cast("long").alias("_u")).unionByName(
        unknown.groupBy("video_id").agg(F.count("*").alias("_u")).withColumn("n", F.lit(0).cast("long"))
    )
    ratios = counts.groupBy("video_id").agg((F.sum("_u") / F.sum("n")).alias("_r"))
    known_language = F.coalesce(F.col("language").isin(supported), F.lit(False))
    videos = texts.groupBy("video_id").agg(F.bool_or(known_language).alias("_sup"))
    return videos.join(ratios, "video_id", "left").select(
        "video_id",
        F.when(~F.col("_sup"), F.lit(-1.0)).otherwise(F.coalesce("_r", F.lit(1.0))).alias("oov"),
    )


def _with_coverage(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``texts`` with ``boh``, the share of characters inside any of the phrases."""
    listed = phrases.select(F.lower("phrase").alias("phrase")).distinct()
    spanned = with_phrase_spans(texts.withColumn("_low", F.lower("text")), listed, "_spans", "_low")
    share = F.when(F.length("text") > 0, covered_chars("_spans") / F.length("text")).otherwise(F.lit(0.0))
    return spanned.withColumn("boh", share).drop("_low", "_spans")


def phrase_coverage(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Share of a text's characters inside any of the phrases, overlaps counted once.

    ``texts(video_id, text)`` with one row a video, ``phrases(phrase)``. Case is ignored.
    """
    return _with_coverage(texts.select("video_id", "text"), phrases).select("video_id", "boh")


def perplexity_score(mean_perplexity) -> Column:
    """0 for a normal language-model perplexity, 1 for 200 and more."""
    p = F.col(mean_perplexity) if isinstance(mean_perplexity, str) else mean_perplexity
    scaled = (p - fixed.PERPLEXITY_BASE) / fixed.PERPLEXITY_RANGE
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))


# --- report ------------------------------------------------------------------

def recommendation(score) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (
        F.when(score >= 0.6, "use_as_is").when(score >= 0.3, "fallback_recommended").otherwise("low_quality")
    )


def quality_report(
    videos: DataFrame,
    segments: DataFrame,
    dictionary: DataFrame,
    phrases: DataFrame | None = None,
    supported: list[str] | None = None,
) -> DataFrame:
    """Score, measures, flags and recommendation of each video.

    ``videos(video_id, language, source, text)`` and, optionally, ``perplexity`` (0–1,
    null or negative where unknown) or ``mean_perplexity``, which gives it. ``phrases(phrase)``
    are by default the common closing lines. Manual captions score 1 and mostly-music videos
    0.3 without the costly measures: they are split off before those joins.
    """
    if phrases is None:
        phrases = small_table(videos.sparkSession, [(p,) for p in fixed.BOILERPLATE_PHRASES], "phrase string")
    if "perplexity" not in videos.columns and "mean_perplexity" in videos.columns:
        videos = videos.withColumn("perplexity", perplexity_score("mean_perplexity"))
    if "perplexity" not in videos.columns:
        videos = videos.withColumn("perplexity", F.lit(None).cast("double"))
    manual = F.coalesce(F.col("source") == "youtube_manual", F.lit(False))
    no_flags = F.array().cast("array<string>")
    unknown = F.lit(None).cast("double")
    columns = ["video_id", "score", "music", "oov", "repetition", "boh", "perplexity", "flags", "recommendation"]

    as_is = videos.filter(manual).select(
        "video_id", F.lit(1.0).alias("score"), unknown.alias("music"), unknown.alias("oov"),
        unknown.alias("repetition"), unknown.alias("boh"), unknown.alias("perplexity"),
        no_flags.alias("flags"), F.lit("use_as_is").alias("recommendation"),
    )

    # Repetition and boilerplate come from one walk over the texts; only word counts and shares are joined.
    shares = settled(non_speech_ratio(segments))
    checked = videos.filter(~manual).join(shares, "video_id", "left")
    checked = checked.withColumn("music", F.coalesce("music", F.lit(0.0)))
    is_music = F.col("music") > fixed.MUSIC_THRESHOLD
    music = checked.filter(is_music).select(
        "video_id", F.lit(0.3).alias("score"), "music", unknown.alias("oov"), unknown.alias("repetition"),
        unknown.alias("boh"), unknown.alias("perplexity"), F.array(F.lit("mostly_music")).alias("flags"),
        F.lit("fallback_recommended").alias("recommendation"),
    )

    speech = checked.filter(~is_music)
    told = _with_coverage(speech.select("video_id", "music", "perplexity", "text"), phrases)
    measured = told.select("video_id", "music", "perplexity", "boh", trigram_repetition("text").alias("repetition")).join(
        oov_ratio(speech, dictionary, supported), "video_id"
    )

    def headroom(name, limit):
        return 1 - F.least(F.col(name) / limit, F.lit(1.0))

    with_words = (
        0.40 * headroom("oov", fixed.OOV_THRESHOLD)
        + 0.30 * headroom("repetition", fixed.REPETITION_THRESHOLD)
        + 0.30 * headroom("boh", fixed.BOILERPLATE_THRESHOLD)
    )
    without_words = (
        0.4 * headroom("repetition", fixed.REPETITION_THRESHOLD)
        + 0.4 * headroom("boh", fixed.BOILERPLATE_THRESHOLD)
        + 0.2 * F.lit(0.5)
    )
    base = F.when(F.col("oov") < 0, without_words).otherwise(with_words)
    odd = F.coalesce(F.col("perplexity") >= 0, F.lit(False))
    score = F.when(odd, F.greatest(base - fixed.PERPLEXITY_PENALTY * F.col("perplexity"), F.lit(0.0))).otherwise(base)
    flags = F.array_compact(
        F.array(
            F.when(F.col("oov") > fixed.OOV_THRESHOLD, "high_oov"),
            F.when(F.col("repetition") > fixed.REPETITION_THRESHOLD, "looped"),
            F.when(F.col("boh") > fixed.BOILERPLATE_THRESHOLD, "boilerplate_hallucinations"),
            F.when(odd & (F.col("perplexity") > fixed.PERPLEXITY_THRESHOLD), "high_perplexity"),
        )
    )
    scored = measured.withColumn("score", score).withColumn("flags", flags)
    scored = scored.withColumn("recommendation", recommendation("score")).select(*columns)
    return as_is.select(*columns).unionByName(music.select(*columns)).unionByName(scored)


def label_agreement(report: DataFrame, labels: DataFrame) -> DataFrame:
    """How the recommendation agrees with given gold labels: counts and mean score per pair."""
    return (
        report.join(labels, "video_id")
        .groupBy("recommendation", "quality")
        .agg(F.count("*").alias("videos"), F.avg("score").alias("mean_score"))
    )
