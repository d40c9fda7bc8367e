"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from weftgraph import queries as Q

from .conftest import ROOT

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(Q.queries()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        path = f"{SF}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = Q.queries()[name](spark, SF)
    got = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)

    def clean(v):
        return float(f"{v:.9g}") if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    want = sorted((tuple(map(clean, r)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_without_the_operators():
    """Neither subpackage nor pipeline can be imported: the rest is there."""
    code = "import sys; sys.modules['weftgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(Q.queries()) and out[1:] == ["False", "False"]
