"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    names, sql = set(e.queries()), set(e.oracle_sql())
    assert sql <= names and len(names) > 100
    assert e.entry(spark).limit(1).count() in (0, 1) if not Path("/root/testdata/sf0.001").exists() else e.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lattica.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op1") or k == "pipeline" for k in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


@pytest.mark.parametrize("name", ["degree_topk", "triangles", "clustering_directed", "pagerank", "critical_path", "betweenness", "strong_components"])
def test_queries_match_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in data.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    want, got = c.execute(e.oracle_sql()[name]).df(), e.queries()[name](spark, str(data)).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, want[cols].values.tolist())) == sorted(map(str, got[cols].values.tolist()))
