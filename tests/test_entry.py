"""The driver contract and the SQL of small queries."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillgraph.plans import registry

DATA = "/root/testdata/sf0.001"
SMALL = [
    "tokenize_stats", "word_sets", "query_routes", "stable_ids", "kg_edges", "degree_top15", "stack_parent",
    "optional_country", "last_view_before_purchase", "holm_correction", "kappa_ac1",
]

MODULES = ("contract_queries", "evidence_queries", "service_queries", "stream_queries")
SMALL += sorted(n for n, f in registry.QUERIES.items() if f.__module__.rpartition(".")[2] in MODULES and n in registry.ORACLE_SQL)


def rows(found):
    names = sorted(found.columns)
    plain = lambda v: f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple("" if pd.isna(v) else plain(v) for v in r) for r in found[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SMALL)
def test_sql_says_the_same(spark, name):
    with duckdb.connect() as db:
        for f in os.listdir(DATA):
            db.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        want = db.sql(entry.oracle_sql()[name]).df()
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(want)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_part(tmp_path):
    """A copy of the repository without those folders still imports and lists its queries."""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    os.makedirs(tmp_path / "quillgraph")
    for name in os.listdir(f"{top}/quillgraph"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{top}/quillgraph/{name}", tmp_path / "quillgraph" / name)
    os.symlink(f"{top}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top10' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
