"""Packing token sequences: best fit in every partition, then in a tree over what stays underfull.

Round 0 packs each partition's pieces, longest first, each into the open sequence with the least room that still holds it.
Nearly full sequences are done. The others are items of the next round, eight partitions to one, until one
partition is left or a round no longer saves a sequence. A task holds about ``ITEMS`` items at any size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, pieces, settle
from talkframe.llm.tokenizing import tokenizer_path, word_encoder

CAPACITY = 4096
#: Items of one task.
ITEMS = 20_000
#: Partitions that become one in the next round.
FAN_IN = 8
#: A sequence with so much of its capacity used is done.
FULL = 0.995

_PIECES = "doc_id bigint, item bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, item, piece, start, length, ids_crc32)``: the ids of each text and ``end_id``, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        number = TaskContext.get().partitionId() << 36
        for batch, texts in pieces(batches):
            ids, ends = encoder.encode(texts)
            out: dict[str, list] = {"doc_id": [], "item": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            begin = 0
            for doc, end in zip(column(batch, "doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[begin:end], end_id).astype("<u4")
                begin = end
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    for name, value in zip(out, (doc, number, k, at, len(part), zlib.crc32(part.tobytes()))):
                        out[name].append(value)
                    number += 1
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return documents.select("doc_id", "text").mapInArrow(cut, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each item, and what each sequence holds; longest items first, each into the least room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = k, used[k]
        used[k] += size
        left = room - size
        by_room.setdefault(left, []).append(k)
        rooms |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _round(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Each item with its sequence, its offset there and what the sequence holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        order = np.argsort(table["item"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        bins, offsets, used = best_fit(table["length"].to_numpy(), capacity)
        first = (level << 58) + (TaskContext.get().partitionId() << 28)
        table = table.append_column("sequence", pa.array(bins + first)).append_column("offset", pa.array(offsets)).append_column("used", pa.array(used[bins]))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", sequence bigint, offset bigint, used bigint"
    return items.mapInArrow(pack, schema)


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a unique ``item`` and a ``length`` of 1 to ``capacity``.

    Every item is placed once. Equal lengths are placed in order of ``item``. No rows give no rows.
    """
    count = parts.count()
    tasks = max(1, -(-count // ITEMS))
    placed = settle(_round(parts.repartition(tasks, "item"), 0, capacity), "packed-0")
    moves: list[DataFrame] = []
    level = 0
    last = placed
    while True:
        done = int(capacity * FULL)
        underfull = last.filter(F.col("used") < done).groupBy(F.col("sequence").alias("item")).agg(F.max("used").alias("length"))
        underfull = settle(underfull, f"underfull-{level}")
        open_before = underfull.count()
        if open_before < 2 or (level and tasks == 1):
            break
        level += 1
        tasks = max(1, min(-(-tasks // FAN_IN), tasks - 1), -(-open_before // ITEMS))
        last = settle(_round(underfull.repartition(tasks, "item"), level, capacity), f"packed-{level}")
        moves.append(last.select(F.col("item").alias("sequence_id"), F.col("sequence").alias("to"), F.col("offset").alias("by")))
        if last.select("sequence").distinct().count() == open_before:
            break
    out = placed.drop("used").withColumnRenamed("sequence", "sequence_id")
    for move in moves:
        out = out.join(move, "sequence_id", "left").withColumn("offset", F.col("offset") + F.coalesce("by", F.lit(0)))
        out = out.withColumn("sequence_id", F.coalesce("to", "sequence_id")).drop("to", "by")
    return out


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """All texts as pieces in sequences of at most ``capacity`` ids.

    A null or empty text is one piece of the end id. Rows without a ``doc_id`` and repeated rows are packed like any other; other
    columns are not read. An empty table gives no rows.
    """
    parts = settle(token_pieces(documents, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in as few sequences of 4096 ids as the tree of best fits needs."""
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
