"""Every registered query with check SQL, side by side with DuckDB on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STREAMS = {"stream_decisions", "stream_ingest_stats"}  # exercised in test_streaming.py


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - STREAMS))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
