"""Joins with keys that many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are looked up by broadcast, at most, and the share of rows that makes a key common.
COMMON_KEYS, COMMON_SHARE = 1_000, 1 / 2_000


def common_keys(rows: DataFrame, on: list[str], key: Column | None = None) -> list:
    """The keys that make up more than ``COMMON_SHARE`` of the rows, by a sketch; at most ``COMMON_KEYS`` pass the driver. As JSON, or as ``key`` tells them."""
    key = F.to_json(F.struct(*on)) if key is None else key
    found = rows.select(key.alias("_k")).agg(F.call_function("approx_top_k", F.col("_k"), F.lit(COMMON_KEYS), F.lit(10 * COMMON_KEYS)).alias("_top"), F.count("*").alias("_n")).first()
    return [x["item"] for x in found["_top"] or [] if x["count"] > max(found["_n"] * COMMON_SHARE, 1)]


def join_unique(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, whose keys are unique; ``how`` is ``inner`` or ``left``.

    Common keys are found first; their entries of ``lookup``, one each, are broadcast to their rows, which stay where they are. Only the rows of
    other keys are shuffled, so no task gets the rows of a key that most rows share. Keys are told by their hash; one that shares it with a common key
    goes along with that on both sides. The sketch is read while the plan is built.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    key = F.xxhash64(*on)
    keys = common_keys(rows, on, key)
    if not keys:
        return rows.join(lookup, on, how)
    is_common = key.isin(keys)
    few = F.broadcast(lookup.filter(is_common))
    return rows.filter(is_common).join(few, on, how).unionByName(rows.filter(~is_common).join(lookup.filter(~is_common), on, how))
