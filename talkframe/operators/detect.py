"""Classifiers over the segments of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkframe.functions import fixed_values as fixed
from talkframe.functions.columns import none_if_empty, round_to


def _minutes():
    return F.greatest(F.coalesce(F.max_by("end", "seg_idx"), F.lit(0.0)) / 60.0, F.lit(0.1))


def detect_tutorial(segments: DataFrame, patterns: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Is a video a screen tutorial? Segments with an action word, per minute.

    The length is the end of the last segment by position. ``sample_matches`` holds
    the first hits: in each segment, the match of the first pattern that occurs.
    """
    patterns = fixed.ACTION_PATTERNS if patterns is None else patterns
    acts = F.coalesce(F.col("text").rlike(fixed.any_of(patterns)), F.lit(False))
    totals = segments.groupBy("video_id").agg(
        F.count_if(acts).alias("action_count"), _minutes().alias("_min")
    )
    nth = F.row_number().over(W.partitionBy("video_id").orderBy("seg_idx"))
    first_match = F.coalesce(*[none_if_empty(F.regexp_extract("text", "(?iU)" + p, 0)) for p in patterns])
    shown = (
        segments.filter(acts)
        .select("video_id", "seg_idx", "text")
        .withColumn("_nth", nth)
        .filter(F.col("_nth") <= samples)
        .groupBy("video_id")
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", first_match.alias("m")))).alias("_s"))
        .select("video_id", F.col("_s.m").alias("sample_matches"))
    )
    density = F.col("action_count") / F.col("_min")
    return totals.join(shown, "video_id", "left").select(
        "video_id",
        ((F.col("_min") >= fixed.TUTORIAL_MIN_MINUTES) & (density >= fixed.TUTORIAL_MIN_PER_MINUTE)).alias("is_tutorial"),
        "action_count",
        round_to("_min", 2).alias("duration_min"),
        round_to(density, 2).alias("density_per_min"),
        F.coalesce("sample_matches", F.array().cast("array<string>")).alias("sample_matches"),
    )


def detect_video_type(segments: DataFrame, rules: list[fixed.TypeRule] | None = None) -> DataFrame:
    """Type of each video by the densest rule against its threshold.

    A segment counts once per rule. The first rule wins ties. Without a rule over
    its threshold: ``talking_head`` for a minute or more with hardly a hit, else
    ``generic``. One aggregation over the segments serves all rules.
    """
    rules = fixed.TYPE_RULES if rules is None else rules
    hits = [
        F.count_if(F.coalesce(F.col("text").rlike(fixed.any_of(r.patterns)), F.lit(False))).alias(f"_n_{r.name}")
        for r in rules
    ]
    totals = segments.groupBy("video_id").agg(_minutes().alias("_min"), *hits)

    def density(rule):
        return F.col(f"_n_{rule.name}") / F.col("_min")

    scores = [F.least(density(r) / r.per_minute, F.lit(fixed.TYPE_MAX_SCORE)) for r in rules]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    winner = F.when(scores[0] == F.col("_top"), rules[0].name)
    for rule, score in zip(rules[1:], scores[1:]):
        winner = winner.when(score == F.col("_top"), rule.name)
    signals = F.col(f"_n_{rules[0].name}")
    for rule in rules[1:]:
        signals = signals + F.col(f"_n_{rule.name}")

    matched = F.col("_top") >= 1.0
    quiet = (F.col("_min") >= fixed.TALKING_HEAD_MIN_MINUTES) & (
        signals / F.col("_min") < fixed.TALKING_HEAD_MAX_PER_MINUTE
    )
    confidence = F.least(F.lit(1.0), 0.4 + 0.15 * F.col("_top"))
    return totals.withColumn("_top", top).select(
        "video_id",
        F.when(matched, winner).when(quiet, "talking_head").otherwise("generic").alias("video_type"),
        F.when(matched, round_to(confidence, 2)).when(quiet, F.lit(0.5)).otherwise(F.lit(0.0)).alias("confidence"),
        round_to("_min", 2).alias("duration_min"),
        F.create_map(*[x for r in rules for x in (F.lit(r.name), F.col(f"_n_{r.name}"))]).alias("counts_per_type"),
        F.create_map(*[x for r in rules for x in (F.lit(r.name), round_to(density(r), 2))]).alias("densities_per_type"),
    )
