"""Passages that repeat, byte for byte, by merging Burrows-Wheeler transforms.

Every window of ``length`` bytes has an anchor: its ``gram`` of least hash, the first on ties. Equal windows have equal anchors at the same place,
so windows meet only inside groups of one anchor. Neighbouring windows with one anchor are a *site*, a short string. Equal sites need no
further look. The other sites of a group go to a cell of bounded size; there each shard of sites has its suffixes sorted and gives its
Burrows-Wheeler transform, and the transforms are merged by refining the interleave: dealing all places by the symbol before them sorts
the merged suffixes one symbol deeper, until places of one class agree on ``length`` bytes. Classes with two windows or more repeat. A symbol is a
string of several bytes. Groups too large for a cell are dealt anew by what ever fewer windows have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, settle

LENGTH = 200
#: Bytes of text that are looked at together; longer texts are cut into pieces that overlap by a window.
CHUNK = 1 << 18
#: Sites of one group that meet in a cell, bytes after which a cell is closed, and shards in it.
CELL_SITES, CELL_BYTES, SHARDS = 512, 1 << 17, 4
#: Ranges of anchor offsets that a site is looked at in before it goes to a cell.
BANDS = 8
#: Bits of the map of anchors that occur twice, and of a piece of it: 16 MB at any size of the input.
MAP_BITS, PIECE_BITS = 1 << 27, 1 << 15
#: Sites, or spans, whose table is broadcast; more are joined by a shuffle.
BROADCAST_ITEMS = 1_000_000

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_of(length: int) -> int:
    """Bytes of an anchor: a power of two, about a third of a window."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    table = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) * _MIX2 >> np.uint64(31))
    h, reach = table[data], 1
    while reach < gram:
        h = h[:-reach] * _MIX + h[reach:] * _MIX2
        h ^= h >> np.uint64(29)
        reach *= 2
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(keys[:len(keys) - more], keys[more:]) if more else keys


def sites_of(buffer: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sites of the strings that follow each other in ``buffer``: number of the string, anchor hash, first window, windows, anchor's place, digest."""
    gram = gram_of(length)
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none, none, none, none, none, none
    hashes = _gram_hashes(np.frombuffer(buffer, np.uint8), gram)
    low = np.uint64((1 << max(22, len(hashes).bit_length())) - 1)
    anchors = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(ends)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    if not len(place):
        return none, none, none, none, none, none
    at = anchors[place]
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    first, at, owner = place[opens], at[opens], owner[opens]
    count = np.diff(np.append(opens, len(place)))
    digest = hashlib.blake2b
    digests = b"".join([digest(buffer[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (first + count + (length - 1)).tolist())])
    return owner, hashes[at].view(np.int64), first - starts[owner], count, at - first, np.frombuffer(digests, np.int64)


_SKETCH = "r bigint, digest binary, v array<bigint>, s array<bigint>, first array<bigint>, n array<int>, anchor array<int>"


def _sketches(texts: DataFrame, length: int) -> DataFrame:
    """The sites of every text of at least ``length`` bytes, a row a text; ``r`` numbers the rows."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal row, held, size
            parts, owners, bases = [], [], []
            for i, (text, _) in enumerate(held):
                for begin in range(0, len(text) - length + 1, CHUNK):
                    parts.append(text[begin:begin + CHUNK + length - 1] if len(text) > CHUNK else text)
                    owners.append(i)
                    bases.append(begin)
            found: list[list[np.ndarray]] = []
            begin = 0
            while begin < len(parts):
                stop, total = begin, 0
                while stop < len(parts) and (stop == begin or total + len(parts[stop]) <= CHUNK):
                    total += len(parts[stop])
                    stop += 1
                owner, v, first, n, anchor, s = sites_of(b"".join(parts[begin:stop]), np.cumsum([len(p) for p in parts[begin:stop]]), length)
                text = np.array(owners[begin:stop], np.int64)[owner]
                found.append([text, v, s, first + np.array(bases[begin:stop], np.int64)[owner], n, anchor])
                begin = stop
            text, v, s, first, n, anchor = [np.concatenate(x) for x in zip(*found)]
            offsets = pa.array(np.searchsorted(text, np.arange(len(held) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, s, first, n.astype(np.int32), anchor.astype(np.int32))]
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(held))), pa.array([d for _, d in held], pa.binary()), *lists], ["r", "digest", "v", "s", "first", "n", "anchor"])
            row, held, size = row + len(held), [], 0
            return out

        for batch in batches:
            for data, digest in zip(column(batch, "data"), column(batch, "digest")):
                data = data.as_py()
                if len(data) >= length:
                    held.append((data, digest.as_py()))
                    size += len(data)
                    if size >= CHUNK:
                        yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(sketch, _SKETCH)


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative codes, 16 bits at a time."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    if len(codes) and int(codes.max()) >> 16:
        order = order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def shard_transform(symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all places of some strings, read round their ends, to ``depth`` bytes; and the symbol before each place in that order."""
    at = np.arange(len(symbols)) - begins

    def moved(by: int) -> np.ndarray:
        return begins + (at + by) % lengths

    rank, have = symbols, step
    while have < depth:
        jump = min(have, depth - have)
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[moved(jump)], return_inverse=True)[1]
        have += jump
    order = _stable_order(rank)
    return order, symbols[moved(-step)][order]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms of shards: which shard each merged place belongs to, and its class.

    A round deals the places by the symbol before them, in the order so far: that order is then right one symbol deeper. Places
    share a class while they agree on all symbols up to there; a class border that appears in round h is a common prefix of
    h - 1 symbols.
    """
    last = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    classes = np.zeros(len(last), np.int64)
    symbol = np.empty_like(last)
    border = np.ones(len(last), bool)
    for _ in range(rounds):
        symbol[np.argsort(shard, kind="stable")] = last
        order = _stable_order(symbol)
        shard, dealt, before = shard[order], symbol[order], classes[order]
        border[1:] = (dealt[1:] != dealt[:-1]) | (before[1:] != before[:-1])
        classes = np.cumsum(border)
    return shard, classes


def repeated_windows(strings: list[bytes], length: int, shards: int = SHARDS) -> np.ndarray:
    """For the places of all strings in a row: whether a window of ``length`` bytes starts there that also starts elsewhere in them."""
    step = next(k for k in (8, 4, 2, 1) if length % k == 0)
    lengths = np.array([len(x) for x in strings], np.int64)
    size = np.repeat(lengths, lengths)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(size))
    # Symbols: numbers of the strings of ``step`` bytes, read round the ends.
    data = np.frombuffer(b"".join([x + x[:step - 1] for x in strings]), np.uint8)
    at = place + np.repeat(np.arange(len(strings)) * (step - 1), lengths)
    code = np.zeros(len(size), np.uint64)
    for k in range(step):
        code = (code << np.uint64(8)) | data[at + k]
    symbols = np.unique(code, return_inverse=True)[1].astype(np.int64)
    cuts = np.searchsorted(np.cumsum(lengths), len(size) * np.arange(1, shards) / shards)
    cuts = np.unique(np.concatenate([[0], cuts, [len(strings)]]))
    ends = np.concatenate([[0], np.cumsum(lengths)])[cuts]
    orders, transforms = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        order, transform = shard_transform(symbols[a:b], begin[a:b] - a, size[a:b], step, length)
        orders.append(order + a)
        transforms.append(transform)
    shard, classes = merge_transforms(transforms, length // step)
    own = np.empty(len(size), np.int64)
    own[np.concatenate(orders)] = classes[np.argsort(shard, kind="stable")]
    whole = place - begin + length <= size
    counts = np.bincount(own[whole], minlength=len(size) + 1)
    return whole & (counts[own] > 1)


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


#: A site in a cell: its group, the offsets ``a`` to ``b`` of anchors in windows that count, and where its text stood.
_ASKED = "key binary, a int, b int, v bigint, s bigint, r bigint, first bigint, n int, anchor int, answer boolean, site binary"
_HITS = "r bigint, begin bigint, stop bigint"


def _pieces(group: list[tuple], length: int) -> list[tuple[int, int, bool, bytes]]:
    """The parts of a group's sites that may hold windows of another site: number and place of the text, whether it asks, the part.

    Windows whose anchor lies in one range of offsets have most of their bytes in common; only sites that share those bytes go on.
    """
    width = length - gram_of(length) + 1
    step = -(-width // BANDS)
    met: dict[tuple[int, bytes], list[int]] = {}
    for i, (_, a, b, _, _, _, _, n, anchor, _, site) in enumerate(group):
        for band in range(max(a, anchor - n + 1) // step, min(b - 1, anchor) // step + 1):
            low, high = band * step, min((band + 1) * step, width)
            met.setdefault((band, site[anchor - low:anchor + length + 1 - high]), []).append(i)
    alive: list[list[int]] = [[] for _ in group]
    for (band, _), found in met.items():
        if len(found) > 1 and any(group[i][9] for i in found):
            for i in found:
                alive[i].append(band)
    out = []
    for bands, (_, a, b, _, _, r, first, n, anchor, wanted, site) in zip(alive, group):
        bands.sort()
        while bands:
            stop = 1
            while stop < len(bands) and bands[stop] == bands[stop - 1] + 1:
                stop += 1
            least, most = max(a, anchor - n + 1, bands[0] * step), min(b - 1, anchor, (bands[stop - 1] + 1) * step - 1)
            out.append((r, first + anchor - most, wanted, site[anchor - most:anchor - least + length]))
            del bands[:stop]
    return out


def _cells(asked: DataFrame, length: int) -> DataFrame:
    """``(r, begin, stop)``: windows of the asked sites that repeat in their group, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        cell: list[tuple[int, int, bool, bytes]] = []
        last = None

        def answer(cell: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
            strings = [x[3] for x in cell]
            begins, stops = _runs(repeated_windows(strings, length))
            sizes = np.array([len(x) for x in strings])
            ends = np.cumsum(sizes)
            of = np.searchsorted(ends, begins, side="right")
            rows, place, wanted = np.array([x[0] for x in cell], np.int64), np.array([x[1] for x in cell], np.int64) - (ends - sizes), np.array([x[2] for x in cell], bool)[of]
            return pa.RecordBatch.from_arrays([pa.array(rows[of][wanted]), pa.array((begins + place[of])[wanted]), pa.array((stops + place[of])[wanted])], ["r", "begin", "stop"])

        for batch in batches:
            for row in zip(*[column(batch, f.split()[0]).to_pylist() for f in _ASKED.split(", ")]):
                if last is not None and row[0] != last[0]:
                    cell += _pieces(group, length)
                    group = []
                    if sum(len(x[3]) for x in cell) >= CELL_BYTES:
                        yield answer(cell)
                        cell = []
                # Copies of a text give a site more than once.
                if last is None or (row[0], row[3], row[4]) != (last[0], last[3], last[4]):
                    group.append(row)
                last = row
        cell += _pieces(group, length)
        if cell:
            yield answer(cell)

    return asked.repartition("key").sortWithinPartitions("key", "v", "s").mapInArrow(run, _HITS)


def _halved(asked: DataFrame, length: int) -> DataFrame:
    """Every site once for each half of its offsets that it has windows in; the key is what all windows of the half have in common."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _ASKED.split(", ")]
        for batch in batches:
            out = []
            for _, a, b, v, s, r, first, n, anchor, answer, site in zip(*[column(batch, c).to_pylist() for c in names]):
                mid = (a + b) // 2
                for low, high in ((a, mid), (mid, b)):
                    if low < high and low <= anchor and anchor - n + 1 < high:
                        core = site[anchor - low:anchor + length + 1 - high]
                        key = hashlib.blake2b(b"%d:%d:" % (low, high) + core, digest_size=16).digest()
                        out.append((key, low, high, v, s, r, first, n, anchor, answer, site))
            columns = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return asked.mapInArrow(halve, _ASKED)


def _repeats_in_groups(asked: DataFrame, large: bool, length: int) -> DataFrame:
    """:func:`_cells` for groups of any size; ``m`` of ``asked`` is the number of different sites in a group.

    A group beyond a cell is halved by the offset of the anchor in a window, and dealt anew by the common part of each half's windows:
    sites alone with theirs drop out. Where one offset is left, the common part is the window itself.
    """
    if not large:
        return _cells(asked.drop("m"), length)
    found = [_cells(asked.filter(F.col("m") <= CELL_SITES).drop("m"), length)]
    waiting = settle(asked.filter(F.col("m") > CELL_SITES).drop("m").dropDuplicates(["v", "s"]), "large-groups")
    for _ in range((length - gram_of(length) + 1).bit_length()):
        halves = settle(_halved(waiting, length), "halved-groups")
        sizes = settle(halves.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "group-sizes")
        shared = settle(halves.join(sizes, "key"), "shared-groups")
        whole = shared.filter("b - a = 1 and answer").select("r", (F.col("first") + F.col("anchor") - F.col("a")).alias("begin"))
        found.append(whole.select("r", "begin", (F.col("begin") + 1).alias("stop")))
        found.append(_cells(shared.filter((F.col("b") - F.col("a") > 1) & (F.col("m") <= CELL_SITES)).drop("m"), length))
        waiting = shared.filter((F.col("b") - F.col("a") > 1) & (F.col("m") > CELL_SITES)).drop("m")
        if waiting.isEmpty():
            break
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits


def _anchor_map(anchors: DataFrame) -> np.ndarray:
    """A bit map of ``v``, of one size whatever the number of anchors; where they crowd it lets more through."""
    piece = (F.col("v").bitwiseAND(MAP_BITS - 1) / PIECE_BITS).cast("int")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            v, p = column(batch, "v").to_numpy() & (PIECE_BITS - 1), column(batch, "p").to_numpy()
            order = np.argsort(p, kind="stable")
            cuts = np.flatnonzero(np.diff(p[order])) + 1
            for places in np.split(order, cuts):
                if len(places):
                    held.setdefault(int(p[places[0]]), np.zeros(PIECE_BITS, bool))[v[places]] = True
        if held:
            yield pa.RecordBatch.from_pydict({"p": pa.array(list(held), pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())})

    whole = np.zeros((MAP_BITS // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    marked = anchors.select("v", piece.alias("p")).repartition(64, "p").mapInArrow(mark, "p int, bits binary")
    for row in marked.toLocalIterator():
        whole[row["p"]] |= np.frombuffer(row["bits"], np.uint8)
    return whole.ravel()


def _candidates(sketch: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(v, s, r, first, n, anchor)``: the sites of all sketches whose anchor is in the map of ``anchors``."""
    shared = sketch.sparkSession.sparkContext.broadcast(_anchor_map(anchors))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            v = column(batch, "v")
            at = (v.flatten().to_numpy() & (MAP_BITS - 1)).astype(np.int64)
            kept = pa.array(np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1))
            rows = np.repeat(column(batch, "r").to_numpy(), v.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([v.flatten().take(kept), column(batch, "s").flatten().take(kept), pa.array(rows).take(kept), *[column(batch, c).flatten().take(kept) for c in ("first", "n", "anchor")]], ["v", "s", "r", "first", "n", "anchor"])

    return sketch.select("r", "v", "s", "first", "n", "anchor").mapInArrow(pick, "v bigint, s bigint, r bigint, first bigint, n int, anchor int")


def _small(df: DataFrame, items: int) -> DataFrame:
    return F.broadcast(df) if items <= BROADCAST_ITEMS else df


def with_repeated_spans(documents: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``documents`` with ``repeated``: the spans (``begin``, ``stop``, in bytes of UTF-8) that repeated strings of ``length`` bytes cover.

    A string repeats that also starts anywhere else in the column, in the same text included; strings do not cross texts. Null texts are
    empty; empty and short texts, and texts without repeats, have no spans. Rows with equal texts are each other's repeats. Other
    columns are passed through; a column ``repeated`` of the input is replaced.
    """
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    digest = F.unhex(F.sha2(data, 256))
    texts = documents.select(data.alias("data"), digest.alias("digest"))
    sketch = settle(_sketches(texts, length), "repeat-sites")
    known = settle(sketch.groupBy("digest").agg(F.min("r").alias("r"), F.count("*").alias("copies")), "repeat-texts")

    # Sites of different texts whose anchor occurs twice, and the classes of equal ones.
    kept = known.filter("copies > 1").select("digest", F.col("r").alias("kept"))
    extra = settle(sketch.select("r", "digest").join(kept, "digest").filter("r <> kept").select("r"), "repeat-copies")
    single = sketch.join(_small(extra, extra.count()), "r", "left_anti")
    twice = single.select(F.explode("v").alias("v")).groupBy("v").agg(F.count("*").alias("k")).filter("k > 1").select("v")
    shared = settle(_candidates(single, twice), "repeat-candidates")
    classes = settle(shared.groupBy("v", "s").agg(F.count("*").alias("k"), F.min(F.struct("r", "first", "n", "anchor")).alias("at")), "repeat-classes")
    several = classes.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    border = settle(classes.join(several, "v").select("v", "s", "at.*", (F.col("k") == 1).alias("answer"), "m"), "repeat-border")

    # The text of the others, one row a class.
    counts = border.agg(F.count("*").alias("n"), F.coalesce(F.max("m"), F.lit(0)).alias("m")).first()
    site = F.struct("v", "s", "r", "first", "n", "anchor", "answer", "m")
    wanted = border.join(known.hint("merge"), "r").groupBy("digest").agg(F.collect_list(site).alias("sites"), F.first("copies").alias("copies"))
    wanted = settle(wanted, "repeat-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # texts of this task that have copies
        width = length - gram_of(length) + 1
        for batch in batches:
            data, own = column(batch, "data"), column(batch, "digest").to_pylist()
            copies, lists = column(batch, "copies").to_pylist(), column(batch, "sites")
            for i, d in enumerate(own):
                if copies[i] > 1:
                    if d in seen:
                        continue
                    seen.add(d)
                whole, rows = data[i].as_py(), lists[i].values
                first, n = rows.field("first").to_pylist(), rows.field("n").to_pylist()
                v, m = rows.field("v"), len(rows)
                keys = [x.to_bytes(8, "little", signed=True) for x in v.to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array([0] * m, pa.int32()), pa.array([width] * m, pa.int32()), v, *[rows.field(c) for c in ("s", "r", "first", "n", "anchor", "answer")],
                    pa.array([whole[a:a + b + length - 1] for a, b in zip(first, n)], pa.binary()), rows.field("m"),
                ], [*[f.split()[0] for f in _ASKED.split(", ")], "m"])

    located = texts.join(_small(wanted, counts["n"]), "digest").select("digest", "data", "copies", "sites")
    asked = located.mapInArrow(cut, _ASKED + ", m bigint")
    hits = _repeats_in_groups(asked, counts["m"] > CELL_SITES, length)
    equal = shared.join(classes.filter("k > 1").select("v", "s").hint("merge"), ["v", "s"], "left_semi")
    hits = hits.unionByName(equal.select("r", F.col("first").alias("begin"), (F.col("first") + F.col("n")).alias("stop")))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for values in column(batch, "hits"):
                begin, stop = values.values.field("begin").to_numpy(), values.values.field("stop").to_numpy()
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(stop[order] + length - 1)
                opens = np.concatenate([[True], begin[1:] > reach[:-1]])
                last = np.append(np.flatnonzero(opens)[1:], len(begin)) - 1
                out.append([{"begin": a, "stop": b} for a, b in zip(begin[opens].tolist(), reach[last].tolist())])
            yield pa.RecordBatch.from_arrays([column(batch, "r"), pa.array(out, kind)], ["r", "spans"])

    gathered = hits.groupBy("r").agg(F.collect_list(F.struct("begin", "stop")).alias("hits"))
    spans = gathered.mapInArrow(cover, "r bigint, spans array<struct<begin:bigint,stop:bigint>>")
    # Texts with copies repeat from end to end, whatever else they have in common with others.
    removal = known.join(spans.hint("merge"), "r", "left").filter("copies > 1 or spans is not null").select("digest", (F.col("copies") > 1).alias("copied"), F.when(F.col("copies") == 1, F.col("spans")).alias("spans"))
    removal = settle(removal, "repeat-spans")
    items = removal.agg(F.coalesce(F.sum(1 + F.coalesce(F.size("spans"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    span = "array<struct<begin:bigint,stop:bigint>>"
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.octet_length(data).cast("bigint").alias("stop")))
    others = [c for c in documents.columns if c != "repeated"]
    named = removal.select(F.col("digest").alias("_digest"), F.col("copied").alias("_copied"), F.col("spans").alias("_spans"))
    joined = documents.select(*others).withColumn("_digest", digest).join(_small(named, items), "_digest", "left")
    return joined.select(*others, F.when(F.col("_copied"), whole).otherwise(F.coalesce("_spans", F.array().cast(span))).cast(span).alias("repeated"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(<key>, n_bytes, n_removed, n_spans, kept_sha256, kept)``: ``kept`` are the bytes of each text outside repeated spans.

    Cuts fall on bytes, so ``kept`` may begin or end inside a character. Cases as in :func:`with_repeated_spans`; a key may be null or repeated.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(column(batch, "data"), column(batch, "repeated").to_pylist()):
                data, at, parts = data.as_py(), 0, []
                for span in spans:
                    parts.append(data[at:span["begin"]])
                    at = span["stop"]
                kept = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = with_repeated_spans(documents.select(key, text), length, text)
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    kind = documents.schema[key].dataType.simpleString()
    rows = spans.select(F.col(key).alias("key"), data.alias("data"), "repeated").mapInArrow(remove, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return rows.withColumnRenamed("key", key)


def op13_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the bytes that strings of 200 repeated bytes cover."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return remove_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP13_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, b, substr(x, 512 * b + 1, 910) AS y FROM (SELECT r, x, unnest(range(0, (length(x) // 2 + 56) // 256)) AS b FROM texts)),
windows AS (SELECT r, 256 * b + i AS i, md5_number(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT r, b, y, unnest(range(0, length(y) // 2 - 199)) AS i FROM blocks)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM windows SEMI JOIN twice USING (h)),
islands AS (SELECT r, i, count(*) FILTER (prev IS NULL OR i > prev + 200) OVER (PARTITION BY r ORDER BY i) AS g FROM starts),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY r, g),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
heads AS (
  SELECT r, sum(b - a) AS removed, count(*) AS n, max(b) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cuts JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM texts LEFT JOIN heads USING (r)
"""
