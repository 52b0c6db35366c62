"""Support of templates counts documents."""

from __future__ import annotations

import re

from corpora import frame

from sonde.functions import staging
from sonde.llm import line_templates


def test_lines_of_one_document_do_not_recur(spark):
    line = lambda x: f"we went to the market for fresh {x}"
    words = ("apples", "pears", "plums", "figs", "dates")
    alone = [(1, "\n".join(map(line, words)), "s")]
    apart = [(10 + k, line(x), "s") for k, x in enumerate(words)]
    dropped = lambda rows: {r["doc_id"]: r["n_dropped"] for r in line_templates.without_templates(frame(spark, rows)).collect()}
    assert dropped(alone) == {1: 0}
    assert dropped(apart) == {10 + k: 1 for k in range(5)}


def test_words_are_spelled_where_the_texts_lie(spark, monkeypatch):
    plans = {}

    def save(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return staging.save(df, tag)

    monkeypatch.setattr(line_templates.scratch, "save", save)
    rows = [(k, f"one two three four {chr(97 + k)}x\none two three four {chr(97 + k)}x\nalone {k}") for k in range(6)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = line_templates.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["n_lines"], r["n_dropped"]) for r in got} == {(3, 3)}
    assert not re.search(r"hashpartitioning\([^)]*(leaf|form)#", plans["spelled"])
