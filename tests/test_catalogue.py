"""Queries against their SQL, on the smallest tables where they are there."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")

NAMES = ["provisional_tier", "components", "gene_annotation", "qc_full", "caller_manta", "caller_factera", "split_read_clusters", "library_stats", "cohort_lineage"]


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, name):
    from junctura.plans import catalogue

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_imports_and_every_query_has_a_name():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
