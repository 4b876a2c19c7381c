"""The registered queries of this package: SQL where there is some."""

import sys
from pathlib import Path

import duckdb
import pytest

from sievespark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ("op2_projected_neighbours", "op6_repeated_passages"):
        ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
        assert sorted(r.doc_id for r in rows) == ids
    if name in queries.ORACLES:
        db = duckdb.connect()
        for path in Path(DATA).glob("*.parquet"):
            db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = db.sql(queries.ORACLES[name])
        assert canon(rows, df.columns) == canon(want.fetchall(), want.columns)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names
    assert "sievespark.llm" in sys.modules
