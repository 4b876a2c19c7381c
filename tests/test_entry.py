"""Every registered query on the small tables; those with SQL against DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from sievespark.plans import queries as core

DATA = "/root/testdata/sf0.001"


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    df = core.QUERIES[name](spark, DATA)
    got = df.collect()
    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert len(got) == len(set(map(str, got)))
    assert canon(got, df.columns) == canon(want.fetchall(), want.columns)


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(core.ORACLES) == set(core.QUERIES)
    if Path(DATA).exists():
        assert entry.entry(spark).count() > 0
