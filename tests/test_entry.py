"""The driver contract, and every registered query with SQL against DuckDB over the smallest test tables."""

import os
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def names():
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    return sorted(sql)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    df = entry.queries()[name](spark, str(FOLDER))
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id1", "id2"]


def test_nothing_outside_needs_the_subpackage():
    package = Path(__file__).resolve().parents[1] / "pairloom"
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert "pairloom.llm" not in path.read_text(), path
    assert os.path.exists(package)
