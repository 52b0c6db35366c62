from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonde.functions import ordered


@pytest.mark.parametrize("rows", [3, 10, 1000])
def test_numbers_and_sums_do_not_depend_on_buckets(spark, rows):
    pdf = pd.DataFrame({"k": [(7 * i) % 50 for i in range(60)], "i": range(60), "v": [i % 5 for i in range(60)]})
    df = spark.createDataFrame(pdf)
    got = ordered.running_sum(ordered.number_rows(df, ["k", "i"], "n", rows=rows), ["k", "i"], "v", "s", rows=rows).toPandas().sort_values("n")
    want = pdf.sort_values(["k", "i"]).reset_index(drop=True)
    assert got["i"].tolist() == want["i"].tolist()
    assert got["n"].tolist() == list(range(60))
    assert got["s"].tolist() == want["v"].cumsum().tolist()


def test_descending_sum(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(20)], "s double, v long")
    got = {r["s"]: r["t"] for r in ordered.running_sum(df, ["s"], "v", "t", descending=True, rows=4).collect()}
    assert got == {float(i): 20 - i for i in range(20)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40))
def test_previous_and_last_known_match_pandas(spark, rows):
    pdf = pd.DataFrame([(g, t, i, v) for i, (g, t, v) in enumerate(rows)], columns=["g", "t", "i", "v"])
    df = spark.createDataFrame([tuple(None if pd.isna(x) else int(x) for x in r) for r in pdf.itertuples(index=False)], "g int, t long, i long, v long")
    got = ordered.previous(df, ["t", "i"], {"p": "v"}, ["g"], rows=5)
    got = ordered.last_known(got, ["t", "i"], "v", "known", ["g"], rows=5).toPandas().sort_values("i")
    by = pdf.sort_values(["t", "i"])
    want = by.assign(p=by.groupby("g")["v"].shift(), known=by.groupby("g")["v"].ffill()).sort_values("i")
    for c in ("p", "known"):
        assert got[c].astype("Float64").fillna(-1).tolist() == want[c].astype("Float64").fillna(-1).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert ordered.number_rows(df, ["k"]).count() == 0
    assert ordered.previous(df, ["k"], {"p": "v"}).count() == 0


def test_times_are_ordered_and_text_is_refused(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-01",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"), "s")
    assert [r["_id"] for r in ordered.number_rows(df, ["t"]).orderBy("t").collect()] == [0, 1]
    with pytest.raises(TypeError):
        ordered.number_rows(df, ["s"])
