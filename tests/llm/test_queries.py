"""The registered queries: SQL where it can say the same, whole tables in any case."""

import os

import duckdb
import pandas as pd
import pytest

from quillgraph.llm import queries

DATA = "/root/testdata/sf0.001"


def rows(found):
    names = sorted(found.columns)
    return sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in found[names].astype(object).itertuples(index=False))


def said(folder, sql):
    with duckdb.connect() as db:
        for f in os.listdir(folder):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            db.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{path}'")
        return db.sql(sql).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_says_the_same(spark, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(said(DATA, queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op4_url_filter"}))
def test_sql_says_the_same_of_awkward_documents(spark, docs, tmp_path, name):
    """The fixture's documents, each id once."""
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(said(tmp_path, queries.ORACLE_SQL[name]))


def test_frames_hold_every_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = queries.gif_frames_table(spark, DATA).toPandas()
    assert set(frames["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert frames["error"].isna().all() and (frames["hist_red"].map(sum) == frames["width"] * frames["height"]).all()
    assert (frames.sort_values(["doc_id", "frame_no"]).groupby("doc_id")["start_ms"].first() == 0).all()
