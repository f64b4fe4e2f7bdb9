"""Ordered work over keys of any size.

A plain window over ``(video)`` sends a whole video to one task. Here the rows of
a key are cut into blocks by a number that grows with the order, the window runs
inside ``(key, block)``, and each block gets one carried row that sums up the
blocks before it. A key of a billion rows is then a few thousand tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK_ROWS = 100_000
# Up to this rank Spark drops rows beyond the limit before it shuffles.
RANKED_ROWS = 1000


def block_of(index, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a row from its position (or another growing number)."""
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / F.lit(rows)).cast("long")


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    aggregates: dict[str, tuple[str, Column]],
    keep_block: bool = False,
) -> DataFrame:
    """Add running aggregates over the rows before each row of its key.

    The input is used once: rows are dealt by ``(key, block)``, and both the rows and the totals of the
    blocks come from that one exchange, which Spark reuses; only a carried row a block is joined. For this
    both sides need the same columns, so select those that the result needs beforehand.

    ``aggregates`` maps the new column to ``(kind, value)``; kind is ``sum`` (0 at
    the first row), ``max`` (null there), ``last`` (the latest non-null value,
    null there) or ``total`` (the sum over all rows of the key, for rows whose block is not null).
    ``block`` must not fall along ``order``. Blocks bound the size of
    a window group; the carried rows are at most one per block after a key's first,
    with a ``total`` one per block of a key that has several.

    ``keep_block`` leaves the block in the result as ``_key`` and ``_blk``; a next call with
    ``block=None`` uses it again, and so needs neither a shuffle nor a sort.
    """
    if block is not None:
        # A struct of the keys is never null, so rows without a key are joined like others.
        df = df.withColumns({"_key": F.struct(*keys), "_blk": block}).repartition("_key", "_blk")
    source = df.columns
    inputs = {name: f"_in_{name}" for name in aggregates}
    df = df.withColumns({inputs[name]: value for name, (_, value) in aggregates.items()})

    inside = W.partitionBy("_key", "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_key").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    # In the order of the other windows, so that Spark takes them in one pass.
    block_rows = W.partitionBy("_key", "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    key_blocks = W.partitionBy("_key").orderBy("_blk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    totals, carried, local, merged = [], {}, {}, {}
    for name, (kind, _) in aggregates.items():
        value, total, carry = F.col(inputs[name]), f"_tot_{name}", f"_carry_{name}"
        if kind == "sum":
            totals.append(F.sum(value).alias(total))
            carried[carry] = F.sum(total).over(before)
            local[name] = F.coalesce(F.sum(value).over(inside), F.lit(0))
            merged[name] = F.col(name) + F.coalesce(F.col(carry), F.lit(0))
        elif kind == "max":
            totals.append(F.max(value).alias(total))
            carried[carry] = F.max(total).over(before)
            local[name] = F.max(value).over(inside)
            merged[name] = F.coalesce(F.greatest(F.col(name), F.col(carry)), F.col(name), F.col(carry))
        elif kind == "last":
            present = F.when(value.isNotNull(), F.struct(*order))
            totals.append(F.max_by(value, present).alias(total))
            carried[carry] = F.last(total, ignorenulls=True).over(before)
            local[name] = F.last(value, ignorenulls=True).over(inside)
            merged[name] = F.coalesce(F.col(name), F.col(carry))
        elif kind == "total":
            totals.append(F.sum(value).alias(total))
            carried[carry] = F.sum(total).over(key_blocks)
            local[name] = F.sum(value).over(block_rows)
            merged[name] = F.coalesce(carry, name)
        else:
            raise ValueError(f"unknown running aggregate: {kind}")

    # A total is carried to the first block too, where there are more.
    nth_block = F.count("*").over(key_blocks) if any(kind == "total" for kind, _ in aggregates.values()) else F.row_number().over(W.partitionBy("_key").orderBy("_blk"))
    # Names all columns, so that the exchange below the totals is that of the rows.
    same = F.max(F.xxhash64(*source)).alias("_same")
    carry_rows = (
        df.groupBy("_key", "_blk")
        .agg(*totals, same)
        .withColumns({**carried, "_nth": nth_block})
        .filter("_nth > 1 and _same is not null")
        .select("_key", "_blk", *carried)
    )
    done = (
        df.withColumns(local)
        .join(carry_rows, ["_key", "_blk"], "left")
        .withColumns(merged)
        .drop(*inputs.values(), *carried)
    )
    return done.select(*source, *aggregates) if keep_block else done.select(*[c for c in source if c not in ("_key", "_blk")], *aggregates)


def numbered(df: DataFrame, keys: list[str], index: str, name: str = "pos") -> DataFrame:
    """Add the dense 0-based position of each row in its key by ``index``."""
    df = running_before(df, keys, [index], block_of(index), {name: ("sum", F.lit(1))})
    return df.withColumn(name, F.col(name).cast("long"))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int, block: Column | None = None) -> DataFrame:
    """The first ``n`` rows of each key by ``order``.

    Spark limits small ranks before the shuffle. For larger ones rows are counted in
    blocks, by default of the first order column's numbers.
    """
    if n <= RANKED_ROWS:
        nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")
    counted = running_before(df, keys, order, block_of(order[0]) if block is None else block, {"_nth": ("sum", F.lit(1))})
    return counted.filter(F.col("_nth") < n).drop("_nth")


def placed_pieces(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    piece: Column,
    separator: str = "",
    joined: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(keys, position, offset, piece)``: the pieces of each key's document, whatever its size.

    Concatenating the pieces of a key by ``position`` (from 0) gives the document; ``offset`` is the exact place
    of a piece in it, in bytes of UTF-8. ``separator`` stands before each ``joined`` piece but the first such;
    all are joined by default. A null piece is empty. ``block``, of the order's columns, as in :func:`running_before`; ``keep`` names more columns to return.
    """
    keep = keep or []
    own = [] if joined is None else [joined.alias("_joined")]
    parts = rows.select(*keys, *order, *[c for c in keep if c not in order], F.coalesce(piece, F.lit("")).alias("piece"), *own)
    gap, size = len(separator.encode()), F.octet_length("piece")
    if joined is None:
        placed = running_before(parts, keys, order, block, {"position": ("sum", F.lit(1)), "offset": ("sum", size + gap)})
        takes = follows = F.col("position") > 0
    else:
        placed = running_before(parts, keys, order, block, {
            "position": ("sum", F.lit(1)), "offset": ("sum", size + F.when(F.col("_joined"), gap).otherwise(0)), "_before": ("sum", F.col("_joined").cast("int")),
        })
        follows = F.col("_before") > 0
        takes = F.col("_joined") & follows
    text = F.when(takes, F.concat(F.lit(separator), "piece")).otherwise(F.col("piece"))
    return placed.select(
        *keys, F.col("position").cast("long").alias("position"),
        (F.col("offset") - F.when(follows, gap).otherwise(0)).cast("long").alias("offset"), text.alias("piece"), *keep,
    )


def enclosed_pieces(ends: DataFrame, items: DataFrame, key: str, separator: str = "") -> DataFrame:
    """``(key, position, offset, piece)``: the pieces of documents as in :func:`placed_pieces`, a head before the items of a key and an end after them.

    ``ends(key, _head, _end)``, ``items(key, _i, _piece)`` in the order of the number ``_i``, counted from 0 or 1; every item has its key in ``ends``.
    ``separator`` stands before each item but the first. The head is dealt with the first block of its items and brings the end along, which is
    placed by the totals of the key, so a key whose items fit one block has no carried row.
    """
    gap, size, is_end = len(separator.encode()), F.octet_length("piece"), F.col("_end").isNotNull()
    heads = ends.select(key, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_i"), F.coalesce("_head", F.lit("")).alias("piece"), F.coalesce("_end", F.lit("")).alias("_end"))
    rows = heads.unionByName(items.select(key, F.lit(1).alias("_side"), F.col("_i").cast("long").alias("_i"), F.coalesce("_piece", F.lit("")).alias("piece"), F.lit(None).cast("string").alias("_end")))
    first, wide = F.lit(0).cast("long"), size + F.col("_side") * gap
    placed = running_before(rows, [key], ["_side", "_i"], F.when(F.col("_i").isNotNull(), F.greatest(block_of("_i"), first)), {
        "position": ("sum", F.lit(1)), "offset": ("sum", wide), "_rows": ("total", F.lit(1)), "_bytes": ("total", wide),
        "_ends": ("sum", is_end.cast("int")), "_ended": ("sum", F.coalesce(F.octet_length("_end"), F.lit(0))),
        **({"_before": ("sum", F.col("_side")), "_items": ("total", F.col("_side"))} if gap else {}),
    })
    follows, has_items = (F.col("_before") > 0, F.col("_items") > 0) if gap else (F.lit(False), F.lit(False))
    text = F.when((F.col("_side") == 1) & follows, F.concat(F.lit(separator), "piece")).otherwise(F.col("piece"))

    def at(position: Column, offset: Column, piece: Column) -> Column:
        return F.struct(position.cast("long").alias("position"), offset.cast("long").alias("offset"), piece.alias("piece"))

    own = at(F.col("position"), F.col("offset") - F.when(follows, gap).otherwise(0), text)
    end = at(F.col("_rows") + F.col("_ends"), F.col("_bytes") - F.when(has_items, gap).otherwise(0) + F.col("_ended"), F.col("_end"))
    return placed.select(key, F.inline(F.when(is_end, F.array(own, end)).otherwise(F.array(own))))


def whole_documents(pieces: DataFrame, keys: list[str], name: str = "content") -> DataFrame:
    """``(keys, <name>)``: documents in one row each, for those known to fit one."""
    held = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("_p"))
    return held.select(*keys, F.array_join(F.col("_p.piece"), "").alias(name))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``. Combines before the shuffle, so hot keys are cheap.

    Order columns compare ascending; give ``-col`` for descending numbers.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
