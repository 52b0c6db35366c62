"""The driver's contract: every query has a name, and what SQL can say agrees with it."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sonde.plans import queries, raw_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("window_categorical", "asof_hold", "cramer_yates", "lsh_candidates", "density_clusters", "placed_elsewhere", "hop_ball", "roc_ap", "threshold_search", "segment_recall", "stream_windows", "graph_edges", "weighted_prediction", "subgraph_attach")
RAW = tuple(n for n, f in queries.QUERIES.items() if f.__module__ == raw_queries.__name__)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(queries.QUERIES) > 60


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", SOME + ("similarity_quantiles",) + RAW)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())
