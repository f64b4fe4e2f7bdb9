"""Trigger phrases and phrase vectors against segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.functions import fixed_values as fixed
from talkframe.operators.phrases import phrase_hits

SEGMENT = ["video_id", "seg_idx"]
VECTORS_PER_PASS = 4096
#: Rows whose cosines with a block of phrases are held at once.
ROWS_PER_SLICE = 1024
DEFAULT_LANGUAGE = "en"
#: Characters of the texts whose words are looked up together, about; chunks of a smaller table, so that all cores have some.
CHUNK_CHARS, LEAST_CHUNKS = 1 << 22, 32
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 500_000
#: White space as in Java's Unicode patterns.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_DETERMINERS = frozenset(fixed.ENGLISH_DETERMINERS)


def parse_phrases(entries: DataFrame) -> DataFrame:
    """Trigger rows from config entries ``(kind, lang, seq, phrase, weight)``; a missing weight is 1.

    Of entries with the same phrase the last wins, at the place of the first.
    Empty phrases are an error in the reference data and are dropped here.
    """
    rows = entries.filter(F.coalesce("phrase", F.lit("")) != "").withColumn(
        "weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    )
    return rows.groupBy("kind", "lang", "phrase").agg(
        F.max_by("weight", "seq").alias("weight"), F.min("seq").alias("seq")
    )


def merge_triggers(builtin: DataFrame, user: DataFrame, mode: str = "extend") -> DataFrame:
    """Built-in triggers overridden and extended by the user's; ``replace`` takes the user's only.

    New phrases go after the built-in ones in ``seq``.
    """
    keys = ["kind", "lang", "phrase"]
    if mode == "replace":
        return user.select(*keys, "weight", "seq")
    both = builtin.select(*keys, "weight", "seq", F.lit(0).alias("_layer")).unionByName(
        user.select(*keys, "weight", "seq", F.lit(1).alias("_layer"))
    )
    place = F.min(F.struct("_layer", "seq"))
    return (
        both.groupBy(*keys)
        .agg(F.max_by("weight", "_layer").alias("weight"), place.alias("_place"))
        .select(*keys, "weight", (F.col("_place._layer") * F.lit(1 << 31) + F.col("_place.seq")).alias("seq"))
    )


def match_exact(segments: DataFrame, triggers: DataFrame, kinds: tuple[str, ...] = ("raw", "strict")) -> DataFrame:
    """First ``raw`` match of each segment, else its first ``strict`` match, in one pass over the text.

    In each kind the phrase that ends first wins, the longest on equal ends. Strict
    phrases count in segments of their own language (``lang``).
    """
    carried = [c for c in ("lang", "start", "end") if c in segments.columns]
    strict = F.col("kind") == "strict"
    lowered = (
        triggers.filter(F.col("kind").isin(list(kinds)))
        .groupBy("kind", F.when(strict, F.col("lang")).alias("rule_lang"), F.lower("phrase").alias("phrase"))
        .agg(F.max_by("weight", "phrase").alias("weight"))
    )
    texts = segments.select(*SEGMENT, *carried, F.lower("text").alias("text"))
    hits = phrase_hits(texts, lowered, [*SEGMENT, *carried], ["kind", "rule_lang", "phrase", "weight"])
    if "strict" in kinds:
        hits = hits.filter(~strict | (F.col("rule_lang") == F.col("lang")))
    order = F.struct(F.when(strict, 1).otherwise(0), F.col("at") + F.col("length"), -F.col("length"))
    reason = F.when(strict, F.concat(F.lit("strict:"), F.col("rule_lang"))).otherwise("raw")
    best = F.min_by(F.struct(F.lit(1.0).alias("score"), "weight", reason.alias("reason"), "phrase"), order)
    return hits.groupBy(*SEGMENT, *carried).agg(best.alias("_b")).select(*SEGMENT, *carried, "_b.*")


def match_raw(segments: DataFrame, triggers: DataFrame) -> DataFrame:
    """Phrase that ends first in each segment, the longest on equal ends; case ignored.

    ``triggers(kind, lang, phrase, weight, seq)``; uses the kind ``raw``.
    """
    return match_exact(segments, triggers, ("raw",)).select(*SEGMENT, "score", "weight", "reason", "phrase")


def match_strict(segments: DataFrame, triggers: DataFrame) -> DataFrame:
    """As :func:`match_raw`, with the phrases of the segment's own language (kind ``strict``)."""
    return match_exact(segments, triggers, ("strict",)).select(*SEGMENT, "score", "weight", "reason", "phrase")


def _tokens(text: str) -> list[str]:
    """As ``words`` of ``talkframe.functions.columns`` tells the tokens of a text."""
    return [w for w in _SPACE.split(text) if w]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each chunk and language, but for those a later batch repeats after ``HELD_WORDS`` others."""
    held: dict[tuple[int, str], set[str]] = {}

    def rows() -> pa.RecordBatch:
        sizes = [len(x) for x in held.values()]
        chunks, langs = ([k for k, n in zip(column, sizes) for _ in range(n)] for column in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(langs, pa.string()), pa.array([w for x in held.values() for w in x], pa.string())], ["_chunk", "lang", "word"])

    for batch in batches:
        for chunk, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            held.setdefault((chunk, lang), set()).update(_tokens(text))
        if sum(len(x) for x in held.values()) > HELD_WORDS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def lemmatize(texts: DataFrame, lemmas: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, lang, lemma_text)``: each token replaced by its lemma, else kept.

    ``texts(keys, lang, text)``, ``lemmas(lang, word, lemma)``. English determiners are
    left out. Languages without lemmas give no rows; rows of equal keys and language are one text, by the places of their tokens.

    Texts are dealt in chunks of a bounded size, once. The distinct words of a chunk meet the lemmas as rows; those found go back to the chunk, where tokens
    are replaced in place, so no token is shuffled and a task holds the words of one chunk. The number of chunks is read while the plan is built.
    """
    texts = texts.join(F.broadcast(lemmas.select("lang").distinct()), "lang", "left_semi").select(*keys, "lang", F.lower("text").alias("_low")).filter("_low is not null")
    chars = texts.agg(F.sum(F.length("_low").cast("long"))).first()[0] or 0
    chunks = max(-(-chars // CHUNK_CHARS), min(LEAST_CHUNKS, -(-chars // (CHUNK_CHARS // LEAST_CHUNKS))), 1)
    dealt = texts.withColumn("_chunk", F.pmod(F.xxhash64(*keys, "lang"), F.lit(chunks))).repartition("_chunk")
    distinct = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("word", T.StringType())])
    listed = lemmas.groupBy("lang", "word").agg(F.min("lemma").alias("lemma")).filter("lemma is not null")
    found = dealt.select("_chunk", "lang", "_low", *keys).mapInArrow(_distinct_words, distinct).join(listed, ["lang", "word"]).select("_chunk", "lang", "word", "lemma")
    whole = dealt.groupBy("_chunk", *keys, "lang").agg(F.collect_list("_low").alias("_low"))
    schema = T.StructType([*[whole.schema[k] for k in (*keys, "lang")], T.StructField("lemma_text", T.StringType())])

    def replace(texts: pa.Table, words: pa.Table) -> pa.Table:
        lemma: dict[str, dict[str, str]] = {}
        for lang, word, form in zip(words["lang"].to_pylist(), words["word"].to_pylist(), words["lemma"].to_pylist()):
            lemma.setdefault(lang, {})[word] = form
        out = []
        for lang, parts in zip(texts["lang"].to_pylist(), texts["_low"].to_pylist()):
            known, skipped = lemma.get(lang, {}), _DETERMINERS if lang == "en" else ()
            split = [[(i, known.get(w, w)) for i, w in enumerate(_tokens(x)) if w not in skipped] for x in parts]
            tokens = split[0] if len(split) == 1 else sorted(x for some in split for x in some)
            out.append(" ".join([w for _, w in tokens]) if tokens else None)
        named = texts.select([*keys, "lang"]).append_column("lemma_text", pa.array(out, pa.string()))
        return named.filter(pc.is_valid(named["lemma_text"]))

    return whole.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(replace, schema)


def match_soft(segments: DataFrame, triggers: DataFrame, lemmas: DataFrame) -> DataFrame:
    """First phrase in config order whose lemmas occur in the segment's lemmas (kind ``soft``)."""
    soft = triggers.filter("kind = 'soft'").select("lang", "phrase", "weight", "seq")
    phrase_lemmas = lemmatize(
        soft.withColumn("text", F.col("phrase")), lemmas, ["phrase", "weight", "seq"]
    )
    text_lemmas = lemmatize(segments.select(*SEGMENT, "lang", "text"), lemmas, SEGMENT)
    hits = phrase_hits(
        text_lemmas, phrase_lemmas, SEGMENT, ["phrase", "weight", "seq"],
        text="lemma_text", phrase="lemma_text", scope=["lang"],
    )
    return (
        hits.groupBy("lang", *SEGMENT)
        .agg(F.min_by(F.struct("phrase", "weight"), F.struct("seq", "phrase")).alias("_b"))
        .select(
            *SEGMENT, F.lit(fixed.SOFT_SCORE).alias("score"), "_b.weight",
            F.concat(F.lit("soft:"), "lang").alias("reason"), "_b.phrase",
        )
    )


def _best_vector(df: DataFrame, vector: str, blocks: list) -> DataFrame:
    """Add the best phrase vector of each row (``_cos``, ``_nr``) over all broadcast blocks, in one step."""
    import numpy as np

    schema = T.StructType([*df.schema.fields, T.StructField("_cos", T.DoubleType()), T.StructField("_nr", T.LongType())])

    def nearest(rows):
        best, best_nr = np.full(len(rows), -2.0), np.full(len(rows), 1 << 62)
        lengths = np.linalg.norm(rows, axis=1)
        for block in blocks:
            numbers, matrix, norms = block.value
            cosine = rows @ matrix.T
            cosine /= np.outer(lengths, norms) + 1e-9
            at = cosine.argmax(axis=1)
            top, nr = cosine[np.arange(len(at)), at], numbers[at]
            better = (top > best) | ((top == best) & (nr < best_nr))
            best, best_nr = np.where(better, top, best), np.where(better, nr, best_nr)
        return best, best_nr

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_PER_SLICE):
                batch = whole.slice(begin, ROWS_PER_SLICE)
                flat = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False)
                best, nr = nearest(flat.astype("float64").reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(nr)], names=[*batch.schema.names, "_cos", "_nr"])

    return df.mapInArrow(score, schema)


def match_universal(
    vectors: DataFrame,
    phrase_vectors: DataFrame,
    threshold: float = fixed.UNIVERSAL_THRESHOLD,
    keys: list[str] | None = None,
    vectors_per_pass: int = VECTORS_PER_PASS,
) -> DataFrame:
    """Nearest phrase of each segment by cosine, where it reaches the threshold.

    ``vectors(keys, embedding)``, ``phrase_vectors(seq, phrase, weight, embedding)``. The widest
    phrase sets the width; vectors that are null, hold nulls or have another width match
    nothing. The first phrase in ``seq`` wins ties. Phrases come in blocks of a
    bounded number, all in one step inside the same tasks, so a worker holds the cosines of one slice of rows and one block,
    no pair of segment and phrase becomes a row and nothing is shuffled but the final lookup.
    """
    import numpy as np

    keys = keys or SEGMENT
    size = phrase_vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    usable = (F.size("embedding") == (size["width"] or 0)) & F.forall("embedding", lambda x: x.isNotNull())
    phrase_vectors = phrase_vectors.filter(usable)
    passes = max(1, -(-size["n"] // vectors_per_pass))
    slot = F.pmod(F.xxhash64("seq"), F.lit(passes))
    context, blocks = vectors.sparkSession.sparkContext, []
    for i in range(passes):
        part = phrase_vectors.filter(slot == i).select("seq", "embedding").collect()
        if part:
            part.sort(key=lambda r: r["seq"])
            matrix = np.array([r["embedding"] for r in part], dtype="float64")
            blocks.append(context.broadcast((np.array([r["seq"] for r in part], dtype="int64"), matrix, np.linalg.norm(matrix, axis=1))))
    best = _best_vector(vectors.filter(usable).select(*keys, "embedding"), "embedding", blocks)
    named = phrase_vectors.select(F.col("seq").cast("long").alias("_nr"), "phrase", "weight")
    return (
        best.filter(F.col("_cos") >= threshold)
        .select(*keys, F.col("_cos").alias("score"), "_nr")
        .join(named, "_nr")
        .select(*keys, "score", "weight", F.lit("universal").alias("reason"), "phrase")
    )


def match_segments(
    segments: DataFrame,
    triggers: DataFrame,
    mode: str = "hybrid",
    lemmas: DataFrame | None = None,
    vectors: DataFrame | None = None,
    phrase_vectors: DataFrame | None = None,
    threshold: float = fixed.UNIVERSAL_THRESHOLD,
) -> DataFrame:
    """The first match of each segment by priority: raw, strict, soft, universal.

    ``keywords_only`` leaves out vectors, ``semantic`` leaves out the language rules;
    branches a mode does not use never enter the plan. A segment without a language has
    ``DEFAULT_LANGUAGE``.
    """
    if mode not in ("keywords_only", "semantic", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    segments = segments.withColumn("lang", F.coalesce("lang", F.lit(DEFAULT_LANGUAGE)))
    exact = match_exact(segments, triggers, ("raw",) if mode == "semantic" else ("raw", "strict"))
    timing = segments.select(*SEGMENT, "start", "end")
    branches = [exact]
    if mode != "semantic" and lemmas is not None:
        branches.append(match_soft(segments, triggers, lemmas).join(timing, SEGMENT))
    if mode != "keywords_only" and vectors is not None and phrase_vectors is not None:
        branches.append(match_universal(vectors, phrase_vectors, threshold).join(timing, SEGMENT))
    if len(branches) == 1:
        return exact.select(*SEGMENT, "start", "end", "score", "weight", "reason", "phrase")
    ranked = None
    for rank, branch in enumerate(branches):
        match = F.struct("start", "end", "score", "weight", "reason", "phrase")
        rows = branch.select(*SEGMENT, F.lit(rank).alias("_rank"), match.alias("_m"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy(*SEGMENT).agg(F.min_by("_m", "_rank").alias("_m")).select(*SEGMENT, "_m.*")
