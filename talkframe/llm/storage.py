"""Tables written once in the shared folder, and text in bounded pieces.

Operators that use an intermediate result several times write it as Parquet under the folder that the session
names in ``spark.checkpoint.dir``: it cuts the lineage, and a lost executor costs its running tasks alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Whether the files of a query's shuffles are removed at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
#: The tables, and their paths, that were written in the innermost ``passing_tables``.
_PASSING: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("passing tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder in local mode only, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="talkframe-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """The same rows, written once and read back; in at most ``parts`` files, where a bound on the rows is known.

    The shuffles of the plan go as soon as the rows are written; otherwise they stay until the driver happens to collect its garbage.
    """
    path = new_path(df.sparkSession, name)
    df = df if parts is None else df.coalesce(parts)
    with session_setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append((table, path))
    return table


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are settled inside are removed at its end, but for those that the function it gives is called with.

    What is built on a table that goes must be settled before the end. A table that stays passes to the next one around, if there is one.
    """
    outer, written, kept = _PASSING.get(), [], []
    token = _PASSING.set(written)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for table, path in written:
            if not any(table is x for x in kept):
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            elif outer is not None:
                outer.append((table, path))


def parts_for(rows: int, each: int = 50_000) -> int:
    """Files for so many narrow rows: enough for all cores of a small cluster, and of bounded size on any."""
    return max(8, -(-rows // each))


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """Holds a session setting while an action runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of text each; a null text is empty. A longer text is alone."""
    for batch in batches:
        values = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        begin = held = 0
        for i, value in enumerate(values):
            if held and held + len(value) > chars:
                yield batch.slice(begin, i - begin), values[begin:i]
                begin, held = i, 0
            held += len(value)
        if begin < len(values):
            yield batch.slice(begin), values[begin:]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
