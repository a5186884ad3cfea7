"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
from larder.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


def test_queries_without_sql(spark):
    """These walk a text in Python; tests/test_capture.py holds their rules."""
    assert set(QUERIES) - set(SQL) == {"page_text", "markdown_chunks"}
    for name in ("page_text", "markdown_chunks"):
        assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())


def test_entry_imports_without_a_session():
    import subprocess

    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
