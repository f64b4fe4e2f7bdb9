"""Registered queries against their SQL on the smallest tables; all of them by ``oracle_check.py``."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from talkframe.plans import load_queries
from tests.oracle_check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect(config={"threads": 8})
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    registered = load_queries()
    assert set(registered.QUERIES) == set(registered.SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", ["best_moments", "merge_windows", "cost_by_stage", "advance_cursor", "stream_merge_windows", "extract_claims"])
def test_query_equals_sql(spark, db, name):
    verdict, _, _, note = compare(spark, db, name, FOLDER)
    assert verdict == "equal", note


def test_phrases_are_looked_for_in_whole_texts(spark, db, tmp_path):
    texts = ["lorem ipsum " * 30 + "Der, DIE Schenungen", "lorem ipsum " * 30, None]
    spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["phrase_confirmed_whole"](spark, str(tmp_path))
    assert sorted(r[:3] for r in got.filter("confirmed").collect()) == [(0, "soft", 3), (0, "strict", 2)]
    assert got.filter("not confirmed").count() == 3 * 6 - 2
    verdict, _, _, note = compare(spark, db, "phrase_confirmed_whole", FOLDER)
    assert verdict == "equal", note


def test_entry(spark):
    assert entry.entry(spark).columns == ["video_id", "win_idx", "start", "end", "reason", "phrase", "priority", "transcript_context"]
