"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.storage import parts_for, settle


def connected(links: DataFrame, files: int | None = None) -> DataFrame:
    """``(id, component)`` of every id in ``links`` (``a``, ``b``); a component is named by its smallest id.

    Each round hangs the larger neighbours of an id on its smallest one, then the smaller ones, until nothing moves: a few rounds, as
    paths at least halve. Minima combine before they are shuffled, and both sides of a join are tables of their own, so that Spark
    can split the rows of a hub. Repeated links and links of an id with itself change nothing.
    ``files`` bounds the files of the first table, where a bound on the links is known.
    """
    a, b = F.col("a"), F.col("b")
    stars = settle(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links", files)
    seen, parts = None, 8
    while True:
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen, parts = (mark["n"], mark["h"]), parts_for(mark["n"], 250_000)
        both = stars.unionByName(stars.select(b.alias("a"), a.alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least", parts)
        large = settle(both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("least").alias("b")).filter(a != b).distinct(), "large-stars", parts)
        least = settle(large.groupBy("a").agg(F.min("b").alias("least")), "least", parts)
        # Only ids with two smaller neighbours or more have anything to move.
        small = large.join(least, "a").filter(b != F.col("least")).select(b.alias("a"), F.col("least").alias("b"))
        stars = settle(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "small-stars", parts)
    return stars.select(a.alias("id"), b.alias("component")).unionByName(stars.select(b.alias("id"), b.alias("component")).distinct())
