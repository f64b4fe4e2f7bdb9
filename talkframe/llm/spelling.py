"""Spelling variants by a dictionary of pairs of trie nodes.

Words are numbered as paths of two tries, one of the words and one of the reversed words. A word of length L is L + 1 pairs (node of a
prefix, node of the suffix that follows), and a position that is skipped leaves a pair of the same kind. Two words are one letter apart
exactly if skipping a position in both gives the same pair at the same place (a replaced letter), or skipping one in the longer gives a
pair of the shorter (an inserted one). So neighbours meet in the rows of one pair of integers; no two words are compared. A pair and a
letter make a word, so a pair never has more rows than there are letters, and one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, settle

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
RATIO = 5
#: One occurrence of a run in about so many loses a letter.
NOISE = 199
#: Runs of letters in UTF-8: ASCII and U+00C0 to U+00FF.
_RUN = re.compile(b"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Bytes of distinct words that a task holds before it passes its counts on.
HELD_BYTES = 32 << 20


def word_counts(documents: DataFrame, noise: int = NOISE, letters: int = LEAST_LETTERS) -> DataFrame:
    """``(word, n)``: how often each word of at least ``letters`` letters occurs.

    A word is a run of letters, A-Z in lower case; with h the crc32 of ``<doc_id>:<run>``, a run whose h ``noise`` divides loses letter
    h modulo its length (0: no run does). A null ``doc_id`` is written as nothing, a null text has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def flush() -> pa.RecordBatch:
            words = [w.decode() for w in counts]
            kept = [i for i, w in enumerate(words) if len(w) >= letters]
            numbers = list(counts.values())
            return pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in kept], pa.string()), "n": pa.array([numbers[i] for i in kept], pa.int64())})

        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                runs = Counter(_RUN.findall((text or "").encode().lower()))
                start = zlib.crc32(b"" if doc is None else str(doc).encode())
                start = zlib.crc32(b":", start)
                if noise:
                    hit = [(r, runs.pop(r)) for r in [r for r in runs if zlib.crc32(r, start) % noise == 0]]
                    for run, n in hit:
                        word = run.decode()
                        at = zlib.crc32(run, start) % len(word)
                        runs[(word[:at] + word[at + 1:]).encode()] += n
                before = len(counts)
                counts.update(runs)
                # New words are not longer than the text.
                held += (len(counts) - before) * 64 + (sum(map(len, runs)) if len(counts) > before else 0)
                if held > HELD_BYTES:
                    yield flush()
                    counts.clear()
                    held = 0
        if counts:
            yield flush()

    parts = documents.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_nodes(words: DataFrame, path: Column, name: str) -> DataFrame:
    """``(word, <name>)``: the numbers of the trie nodes on each word's ``path``, from the root to its end.

    Paths are sorted by ranges; each task numbers the nodes that its paths open, in their order. A path that a range shares with the last
    one before it has numbers already: those are put right from two words a range, which pass the driver. The last number of a path is its
    own, and grows with the order of paths.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = part << 40
        before, stack, fresh = "", [base], base + 1
        for batch in batches:
            out = []
            for text in column(batch, "path").to_pylist():
                keep = _shared(before, text) + 1
                stack = stack[:keep] + list(range(fresh, fresh + len(text) + 1 - keep))
                fresh += len(text) + 1 - keep
                before = text
                out.append(stack)
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "path"), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["word", "path", "part", "nodes"])

    paths = words.select("word", path.alias("path"))
    ranged = paths.repartitionByRange("path").sortWithinPartitions("path")
    numbered = settle(ranged.mapInArrow(number, "word string, path string, part int, nodes array<bigint>"), f"trie-{name}")
    ends = numbered.groupBy("part").agg(F.min_by(F.struct("path", "nodes"), "path").alias("first"), F.max_by(F.struct("path", "nodes"), "path").alias("last"))
    same: dict[int, int] = {}
    last, canonical = "", None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        if canonical is not None:
            keep = _shared(last, row["first"]["path"]) + 1
            same.update(zip(row["first"]["nodes"][:keep], canonical[:keep]))
        last, canonical = row["last"]["path"], [same.get(i, i) for i in row["last"]["nodes"]]
    if not same:
        return numbered.select("word", F.col("nodes").alias(name))

    def settle_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [[same.get(i, i) for i in x] for x in column(batch, "nodes").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "word"), pa.array(nodes, pa.list_(pa.int64()))], ["word", name])

    return numbered.select("word", "nodes").mapInArrow(settle_numbers, f"word string, {name} array<bigint>")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, id, n_near, near)`` of distinct ``words`` (``word``, ``n``).

    ``id`` numbers the words in code-point order. Near words differ by one inserted, deleted or replaced letter; ``near`` is the most
    frequent as a struct (``n``, ``-id``), the first in code-point order on ties, null without near words.
    """
    forward = trie_nodes(words, F.col("word"), "p")
    backward = trie_nodes(words, F.reverse("word"), "s")
    size = F.size("p") - 1
    rows = settle(words.join(forward, "word").join(backward, "word").withColumn("id", F.element_at("p", -1)), "word-paths")
    me = F.struct("n", (-F.col("id")).alias("k"))
    at = F.sequence(F.lit(0), size)
    whole = rows.select(me.alias("me"), F.explode(F.transform(at, lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", size - i).alias("s")))).alias("x"))
    # A letter like the one before it leaves the same word when skipped; only the first of them counts as deleted.
    first = lambda i: (i == 0) | (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i, F.lit(1)))
    skips = F.transform(F.slice(at, F.lit(1), size), lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", size - i - 1).alias("s"), first(i).alias("deletes")))
    skipped = rows.select(me.alias("me"), F.explode(skips).alias("x"))
    pairs = whole.select("x.p", "x.s", "me", F.lit(True).alias("is_word"), F.lit(False).alias("deletes")).unionByName(
        skipped.select("x.p", "x.s", "me", F.lit(False).alias("is_word"), "x.deletes")
    )
    member = F.struct("me", "deletes")
    met = pairs.groupBy("p", "s").agg(
        F.max(F.when(F.col("is_word"), F.col("me"))).alias("short"),
        F.collect_list(F.when(~F.col("is_word"), member)).alias("long"),
    ).filter((F.size("long") > 1) | (F.col("short").isNotNull() & (F.size("long") > 0)))
    met = met.withColumns({
        "best": F.slice(F.sort_array(F.transform("long", lambda m: m["me"]), False), 1, 2),
        "longer": F.filter("long", lambda m: m["deletes"]),
    })
    other = F.when(F.get("best", F.lit(0)) == F.col("m.me"), F.get("best", F.lit(1))).otherwise(F.get("best", F.lit(0)))
    shorter = F.when(F.col("m.deletes"), F.col("short"))
    of_long = met.select("short", "best", F.size("long").alias("size"), F.explode("long").alias("m")).select(
        F.col("m.me.k").alias("k"), (F.col("size") - 1 + shorter.isNotNull().cast("int")).cast("bigint").alias("links"), F.greatest(other, shorter).alias("near")
    )
    of_short = met.filter(F.col("short").isNotNull() & (F.size("longer") > 0)).select(
        F.col("short.k").alias("k"), F.size("longer").cast("bigint").alias("links"), F.array_max(F.transform("longer", lambda m: m["me"])).alias("near")
    )
    found = of_long.unionByName(of_short).filter("links > 0").groupBy("k").agg(F.sum("links").alias("n_near"), F.max("near").alias("near"))
    found = found.select((-F.col("k")).alias("id"), "n_near", "near")
    return rows.select("word", "n", "id").join(found, "id", "left").select("word", "n", "id", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "near")


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of distinct ``words`` (``word``, ``n``).

    The form of a word is its most frequent near word (the first in code-point order on ties) where that is at least ``ratio`` (2 or more)
    times as frequent, else null; the root follows forms to the last one. Without words there are no rows.
    """
    near = settle(near_words(words), "near-words")
    has = F.col("near.n") >= ratio * F.col("n")
    forms = near.withColumns({"to": F.when(has, -F.col("near.k")), "form_n": F.when(has, F.col("near.n"))}).drop("near")
    # Counts grow by the ratio with every step, so a chain is short; each round doubles the steps taken.
    most = forms.agg(F.max("form_n").alias("n")).first()["n"] or 1
    steps = 1
    while ratio ** steps <= most:
        steps += 1
    links = settle(forms.filter("to is not null").select("id", "to"), "forms")
    taken = 1
    while taken < steps:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        links = settle(links.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "roots")
        taken *= 2
    named = near.select(F.col("id"), F.col("word").alias("name"))
    first = named.select(F.col("id").alias("to"), F.col("name").alias("form"))
    roots = links.join(named.select(F.col("id").alias("to"), F.col("name").alias("root")), "to").select("id", "root")
    return (
        forms.join(first, "to", "left").join(roots, "id", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def spelling_variants(documents: DataFrame, noise: int = 0, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Forms of the words that occur ``least`` times or more in ``documents``; see :func:`word_counts` and :func:`spelling_forms`.

    Repeated rows count again. Other columns are not read.
    """
    words = settle(word_counts(documents, noise, letters).filter(F.col("n") >= least), "words")
    return spelling_forms(words, ratio)


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of ``documents`` with one letter in 199 runs lost, and the more frequent words that they are variants of."""
    return spelling_variants(spark.read.parquet(f"{folder}/documents.parquet"), NOISE)


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS step, CAST(i AS UBIGINT) AS c FROM range(256) r(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM bits WHERE step < 8
),
codes AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z\x{C0}-\x{FF}]+')) AS run FROM lowered),
runs AS (SELECT run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM split GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(CAST(4294967295 AS UBIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(length(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS UBIGINT))),
    lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1]))) AS h
  FROM runs, codes
),
noisy AS (
  SELECT k, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed
),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
skips AS (SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON s.head || s.tail = w.word
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON s.head || s.tail = w.word
),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, o := other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * w.n THEN b.o END AS form, CASE WHEN -b.m >= 5 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
