"""Register of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def with_tables(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql_timestamp(x: str, separator: str = ".") -> str:
    hours, minutes = f"CAST(floor({x} / 3600) AS BIGINT)", f"CAST(floor(({x} % 3600) / 60) AS BIGINT)"
    seconds, millis = f"CAST(floor({x} % 60) AS BIGINT)", f"CAST(round_even(({x} - floor({x})) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{separator}%03d', {hours}, {minutes}, {seconds}, {millis})"


def sql_clock(x: str) -> str:
    t = f"CAST(floor({x}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60)"


def sql_duration(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, {x} % 3600 // 60, {x} % 60) "
        f"ELSE printf('%d:%02d', {x} // 60, {x} % 60) END"
    )


def sql_pieces(rows: str, keys: str, order: str, extra: str = "") -> str:
    """Places of the pieces in ``rows``, which has the keys, the order and ``piece``."""
    window = f"(PARTITION BY {keys} ORDER BY {order})"
    sums = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"SELECT {keys}, row_number() OVER {window} - 1 AS position, "
        f'CAST(coalesce(sum(strlen(piece)) OVER {sums}, 0) AS BIGINT) AS "offset", piece{extra} FROM {rows}'
    )
