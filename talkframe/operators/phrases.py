"""Exact search for many phrases in many texts by automata.

All phrases of a block become one automaton, which finds every occurrence of every phrase in one walk over a text. Blocks
have a bounded number of characters, so an automaton of bounded size is sent to the tasks and built once a worker; more phrases are more
blocks, and each block is one more walk. Texts stay where they are: nothing is shuffled, and no text is joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the phrases that are broadcast as one automaton; a longer phrase is alone.
BROADCAST_CHARS = 2_000_000
SPANS = "array<struct<at:bigint,stop:bigint>>"


def _blocks(phrases: DataFrame, phrase: str, columns: list[str], chars: int = BROADCAST_CHARS) -> Iterator[pa.Table]:
    """The phrases that are not empty, in tables of bounded size, one after another."""
    held, size, given = [], 0, False
    kept = phrases.filter(F.length(phrase) > 0).select(F.col(phrase).alias("_phrase"), *columns)
    schema = T.StructType(kept.schema.fields)
    for row in kept.toLocalIterator():
        if held and size + len(row[0]) > chars:
            yield _table(held, schema)
            held, size, given = [], 0, True
        held.append(row)
        size += len(row[0])
    if held or not given:
        yield _table(held, schema)


def _table(rows: list, schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


_BUILT: list[tuple[pa.Table, list[str], dict]] = []


def _automata(shared, scope: list[str]) -> tuple[pa.Table, dict[tuple, ahocorasick.Automaton]]:
    """The block, and one automaton for each value of its scope. A worker builds them once and keeps those of two blocks."""
    table = shared.value
    for known, of, built in _BUILT:
        if known is table and of == scope:
            return table, built
    rows: dict[tuple, dict[str, list[int]]] = {}
    scopes = list(zip(*[table[c].to_pylist() for c in scope])) if scope else [()] * table.num_rows
    for i, (text, value) in enumerate(zip(table["_phrase"].to_pylist(), scopes)):
        rows.setdefault(value, {}).setdefault(text, []).append(i)
    built = {}
    for value, texts in rows.items():
        automaton = ahocorasick.Automaton()
        for text, places in texts.items():
            automaton.add_word(text, (len(text), places))
        automaton.make_automaton()
        built[value] = automaton
    del _BUILT[:-1]
    _BUILT.append((table, scope, built))
    return table, built


def phrase_hits(
    texts: DataFrame,
    phrases: DataFrame,
    text_keys: list[str],
    phrase_keys: list[str],
    text: str = "text",
    phrase: str = "phrase",
    scope: list[str] | None = None,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """All places where a phrase occurs in a text, overlapping ones too.

    ``scope`` columns must be equal on both sides (a language, a batch). Compares
    characters as they are, so lower both sides for a case-blind search. Returns
    ``text_keys``, ``scope``, ``phrase_keys``, ``at`` (0-based) and ``length``. Phrases are read, a block at a time, while the plan is built.
    """
    scope = scope or []
    carried = [*scope, *[k for k in text_keys if k not in scope]]
    source = texts.select(*carried, F.col(text).alias("_text"))
    own = [T.StructField(k, phrases.schema[k].dataType) for k in phrase_keys]
    schema = T.StructType([*[source.schema[c] for c in carried], *own, T.StructField("at", T.LongType()), T.StructField("length", T.LongType())])

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, automata = _automata(shared, scope)
            for batch in batches:
                columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                scopes = list(zip(*[columns[c].to_pylist() for c in scope])) if scope else [()] * batch.num_rows
                rows, places, starts, lengths = [], [], [], []
                for i, (value, of) in enumerate(zip(columns["_text"], scopes)):
                    automaton = automata.get(of)
                    value = value.as_py()
                    if automaton is None or not value or None in of:
                        continue
                    for end, (length, hit) in automaton.iter(value):
                        for place in hit:
                            rows.append(i)
                            places.append(place)
                            starts.append(end - length + 1)
                            lengths.append(length)
                found, at = pa.array(rows, pa.int64()), pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[columns[c].take(found) for c in carried], *[table[k].combine_chunks().take(at) if table.num_rows else pa.array([], table[k].type) for k in phrase_keys], pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                    [*carried, *phrase_keys, "at", "length"],
                )

        return run

    context = texts.sparkSession.sparkContext
    hits = [source.mapInArrow(search(context.broadcast(block)), schema) for block in _blocks(phrases, phrase, [*scope, *[k for k in phrase_keys if k not in scope]], broadcast_chars)]
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def with_phrase_spans(texts: DataFrame, phrases: DataFrame, name: str = "spans", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """``texts`` with the spans (``at``, ``stop``, in characters) that any of the phrases covers, merged and in order.

    One walk over the texts for each block of phrases, all in one stage; a null text has no spans. Cases must agree already.
    """
    out = texts.withColumn(name, F.array().cast(SPANS))

    def cover(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, automata = _automata(shared, [])
            automaton = automata.get(())
            kind = pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64())]))
            for batch in batches:
                at, held = batch.schema.get_field_index(text), batch.schema.get_field_index(name)
                spans = []
                for value, before in zip(batch.column(at), batch.column(held).to_pylist()):
                    value = value.as_py()
                    found = [(s["at"], s["stop"]) for s in before]
                    if automaton is not None and value:
                        found += [(end - length + 1, end + 1) for end, (length, _) in automaton.iter(value)]
                    merged: list[dict[str, int]] = []
                    for begin, stop in sorted(found):
                        if merged and begin <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                        else:
                            merged.append({"at": begin, "stop": stop})
                    spans.append(merged)
                yield batch.set_column(held, batch.schema.field(held), pa.array(spans, kind).cast(batch.schema.field(held).type))

        return run

    context = texts.sparkSession.sparkContext
    for block in _blocks(phrases, phrase, []):
        out = out.mapInArrow(cover(context.broadcast(block)), out.schema)
    return out


def covered_chars(spans: str = "spans") -> Column:
    """Characters in the spans of :func:`with_phrase_spans`."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["at"])
