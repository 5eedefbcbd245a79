from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_names_match():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_core_does_not_import_llm():
    code = "import sys, corvine.plans.quality, corvine.plans.catalog, corvine.plans.search, corvine.plans.vectors, corvine.plans.ranking, corvine.plans.sequences, corvine.plans.verification, corvine.plans.projections, corvine.plans.sources; sys.exit(any(m.startswith('corvine.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "catalog_first_wins", "admin_browse", "field_search_exact", "rank_decide", "rate_limit"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).iterdir():
        con.execute(f"create view {path.name.removesuffix('.parquet')} as select * from '{path}'")
    found = __spark_entry__.queries()[name](spark, DATA)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    rows = lambda data: sorted(data, key=str)
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(result.fetchall())
