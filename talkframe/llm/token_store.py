"""Token ids in wavelet-matrix shards.

Documents are dealt by ranges of ``doc_id``, encoded, and written in ascending order as shards of about
``shard_tokens`` ids. A shard is one file of one row: its payload holds the succinct bit planes with their rank
directories, and the documents' ids and lengths. Token access, counting, rank, select and occurrences all work on the payload
without expanding it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, new_path, pieces
from talkframe.llm.tokenizing import tokenizer_path, word_encoder

MAGIC = b"TFWM1\0\0\0"
#: Bits whose ones are counted once in the rank directory.
BLOCK = 512
#: Ids of a plane that are dealt together.
STRETCH = 1 << 15
#: Ids after which a shard is closed.
SHARD_TOKENS = 2_000_000
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_shard(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> bytes:
    """The payload of a shard; ``known`` is false where a document has no id."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    row = ids.astype(np.uint16) if bits <= 16 else ids
    zeros, planes, ranks = [], [], []
    for level in range(bits - 1, -1, -1):
        # Stretches that stay in a core's cache.
        packed, low, high = [], [], []
        for begin in range(0, n, STRETCH):
            part = row[begin:begin + STRETCH]
            ones = ((part >> level) & 1).astype(bool)
            packed.append(np.packbits(ones, bitorder="little"))
            low.append(part.take(np.flatnonzero(~ones)))
            high.append(part.take(np.flatnonzero(ones)))
        plane = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
        sums = _BYTE_ONES[plane].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)]))
        planes.append(plane)
        zeros.append(sum(map(len, low)))
        row = np.concatenate([*low, *high]) if n else row
    head = MAGIC + struct.pack("<QIIQ", n, bits, BLOCK, len(doc_ids))
    body = [np.array(zeros, "<u8").tobytes(), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(known, np.uint8).tobytes(), np.asarray(lengths, "<u8").tobytes()]
    for plane, rank in zip(planes, ranks):
        body += [plane.tobytes(), rank.astype("<u4").tobytes()]
    return head + b"".join(body)


class Shard:
    """A wavelet matrix read from its payload."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.bits, block, docs = struct.unpack_from("<QIIQ", payload, 8)
        at = 8 + struct.calcsize("<QIIQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.zeros = take("<u8", self.bits)
        self.doc_ids, self.known, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        whole = -(-((self.n + 7) // 8) // (block // 8)) * (block // 8)
        self.planes, self.ranks = [], []
        for _ in range(self.bits):
            self.planes.append(take("u1", whole))
            self.ranks.append(take("<u4", whole // (block // 8) + 1))

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane ``k`` before place ``i``."""
        block, width = i // BLOCK, BLOCK // 8
        count = int(self.ranks[k][block])
        byte = i // 8
        count += int(_BYTE_ONES[self.planes[k][block * width:byte]].sum())
        if i % 8:
            count += int(_BYTE_ONES[int(self.planes[k][byte]) & ((1 << (i % 8)) - 1)])
        return count

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            one = (int(self.planes[k][i // 8]) >> (i % 8)) & 1
            value = value * 2 + one
            ones = self._ones(k, i)
            i = int(self.zeros[k]) + ones if one else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if token < 0 or token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            if (token >> (self.bits - 1 - k)) & 1:
                low, high = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before place ``i``."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, k: int, one: int, j: int) -> int:
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(k, mid + 1)
            if (ones if one else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, j: int) -> int:
        """The place of occurrence ``j`` (from 0) of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(j)
        at = low + j
        for k in range(self.bits - 1, -1, -1):
            if (token >> (self.bits - 1 - k)) & 1:
                at = self._select_bit(k, 1, at - int(self.zeros[k]))
            else:
                at = self._select_bit(k, 0, at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids in order."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            above, bit = np.empty_like(row), row.dtype.type(1 << (self.bits - 1 - k))
            low, high = 0, int(self.zeros[k])
            for begin in range(0, self.n, STRETCH):
                part = above[begin:begin + STRETCH]
                ones = np.unpackbits(self.planes[k][begin // 8:(begin + STRETCH) // 8], count=len(part), bitorder="little").astype(bool)
                one, zero = np.flatnonzero(ones), np.flatnonzero(~ones)
                part[zero] = row[low:low + len(zero)]
                part[one] = row[high:high + len(one)] | bit
                low, high = low + len(zero), high + len(one)
            row = above
        return row.astype(np.uint32)


_SHARDS = "part int, seq int, part_start bigint, n_tokens bigint, n_docs bigint, payload binary"


def write_shards(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes ``documents`` (``doc_id``, ``text``) as shards under ``path``, in ascending order of ``doc_id``.

    A null text is empty and gives the end id alone. Rows without a ``doc_id`` come first and keep a mark; repeated ids
    are all written, ordered by text. Other columns are not read. An empty table writes no shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held, docs
            lengths = np.array([len(x) for _, x in docs], np.int64)
            payload = pack_shard(np.concatenate([x for _, x in docs]), np.array([d or 0 for d, _ in docs], np.int64), lengths, np.array([d is not None for d, _ in docs]))
            row = {"part": [part], "seq": [seq], "part_start": [before], "n_tokens": [int(lengths.sum())], "n_docs": [len(docs)], "payload": [payload]}
            seq, before, held, docs = seq + 1, before + int(lengths.sum()), 0, []
            return pa.RecordBatch.from_pydict(row, schema)

        for batch, texts in pieces(batches):
            ids, ends = encoder.encode(texts)
            begin = 0
            for doc, end in zip(column(batch, "doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[begin:end], end_id).astype(np.uint32)
                docs.append((doc, own))
                held, begin = held + len(own), end
                if held >= shard_tokens:
                    yield close()
        if docs:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
    # Rows of one id are parted by the beginnings of their texts.
    wanted = documents.select("doc_id", "text")
    dealt = wanted.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(encode, _SHARDS).write.option("maxRecordsPerFile", 1).parquet(path)


def shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(part, part_offset)``: ids before each written part. One number a part passes the driver."""
    totals = spark.read.schema(_SHARDS).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    rows, before = [], 0
    for row in totals:
        rows.append((row["part"], before))
        before += row["n"]
    return spark.createDataFrame(rows, "part int, part_offset bigint")


def _stretches(batch: pa.RecordBatch, ids_at_once: int = 500_000) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Documents of the shards in a batch, some at a time: their columns, all their ids in a row, and where each document begins and ends."""
    for i in range(batch.num_rows):
        shard = Shard(column(batch, "payload")[i].as_py())
        ids = shard.ids()
        ends = np.concatenate([[0], np.cumsum(shard.lengths.astype(np.int64))])
        begin = 0
        while begin < len(ends) - 1:
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ids_at_once)))
            stop = min(stop, len(ends) - 1)
            columns = [
                pa.array(shard.doc_ids[begin:stop], mask=shard.known[begin:stop] == 0),
                pa.array([column(batch, "part")[i].as_py()] * (stop - begin), pa.int32()),
                pa.array(ends[begin:stop] + column(batch, "part_start")[i].as_py()),
                pa.array(shard.lengths[begin:stop].astype(np.int64)),
            ]
            yield columns, ids[ends[begin]:ends[stop]], ends[begin:stop + 1] - ends[begin]
            begin = stop


_DOCUMENT = ["doc_id", "part", "part_place", "n_tokens"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, part_place, n_tokens, ids)`` of every document in the shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, ids, ends in _stretches(batch):
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], [*_DOCUMENT, "ids"])

    files = spark.read.schema(_SHARDS).parquet(path)
    return files.mapInArrow(decode, "doc_id bigint, part int, part_place bigint, n_tokens bigint, ids array<int>")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the shards; ids stay in the decoding task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, ids, ends in _stretches(batch):
                data = memoryview(ids.astype("<u4").tobytes())
                places = (4 * ends).tolist()
                sums = [zlib.crc32(data[a:b]) for a, b in zip(places[:-1], places[1:])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], [*_DOCUMENT, "ids_crc32"])

    rows = spark.read.schema(_SHARDS).parquet(path).mapInArrow(digest, "doc_id bigint, part int, part_place bigint, n_tokens bigint, ids_crc32 bigint")
    offsets = shard_offsets(spark, path)
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_place") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``(part, seq, n)``: how often each shard holds a token, from its bit planes alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Shard(x.as_py()).count(token) for x in column(batch, "payload")]
            yield pa.RecordBatch.from_arrays([column(batch, "part"), column(batch, "seq"), pa.array(counts, pa.int64())], ["part", "seq", "n"])

    return spark.read.schema(_SHARDS).parquet(path).mapInArrow(count, "part int, seq int, n bigint")


def op8_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as wavelet-matrix shards and read back."""
    path = new_path(spark, "token-shards")
    write_shards(spark.read.parquet(f"{folder}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"))
    return document_digests(spark, path)
