"""Plans that chain operators over a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.operators.intervals import refine_by_frame_diff, window_context
from talkframe.operators.matching import match_segments
from talkframe.operators.quality import filter_hallucinations
from talkframe.operators.tables import settled
from talkframe.operators.windows import detection_windows, merge_windows, select_by_budget


def best_moments(
    segments: DataFrame,
    triggers: DataFrame,
    durations: DataFrame,
    max_windows: int = 10,
    mode: str = "keywords_only",
    frames: DataFrame | None = None,
    scenes: DataFrame | None = None,
    **matching,
) -> DataFrame:
    """The best moments of every video with their transcript context.

    Match triggers, pad to windows, merge, drop static ones (``hybrid`` with frames),
    keep within the budget, and attach the words around.
    """
    kept, _ = filter_hallucinations(segments)
    hits = match_segments(kept, triggers, mode, **matching)
    windows = merge_windows(detection_windows(hits, scenes, mode))
    if mode == "hybrid" and frames is not None:
        windows = refine_by_frame_diff(windows, frames)
    chosen = settled(select_by_budget(settled(windows), durations, max_windows))
    return window_context(chosen, kept).withColumn("priority", F.col("score") * F.col("weight"))
