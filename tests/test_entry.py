"""The driver's contract: names, columns, and the DuckDB SQL of a few queries."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from reportmill.plans import queries as plans

WITH_SQL = sorted(plans.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 40


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, sf, name):
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(map(shown, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


def test_imports_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    (tmp_path / "reportmill").mkdir()
    for part in (root / "reportmill").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "reportmill" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
