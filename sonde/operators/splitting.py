"""Splits in time that keep runs of labels whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions.contracts import LABEL_PREFIXES, TIME
from sonde.operators.runs import count_runs

PARTS = ("train", "validation", "test")
#: Where validation and test begin in the public datasets.
CUTS = {
    "swat": ("2015-12-28 10:00:00", "2015-12-31 00:29:19"),
    "hai": ("2022-08-17 00:00:01", "2022-08-18 08:00:01"),
    "esa": ("2001-10-01 00:00:00", "2002-04-03 00:00:00"),
}


def with_part(df: DataFrame, valid_start, test_start, time: str = TIME) -> DataFrame:
    """df with `part`; each part starts at its bound."""
    if not str(valid_start) < str(test_start):
        raise ValueError("validation has to begin before test")
    stamp = lambda t: F.lit(t).cast(df.schema[time].dataType)
    name = F.when(F.col(time) < stamp(valid_start), PARTS[0]).when(F.col(time) < stamp(test_start), PARTS[1]).otherwise(PARTS[2])
    return df.withColumn("part", name)


def cut(df: DataFrame, valid_start, test_start, time: str = TIME) -> dict[str, DataFrame]:
    """The three parts; raises if one is empty or a row has no time."""
    parted = with_part(df, valid_start, test_start, time)
    counts = {r["part"]: r["count"] for r in parted.filter(F.col(time).isNotNull()).groupBy("part").count().collect()}
    if len(counts) < 3:
        raise ValueError(f"empty parts: {[p for p in PARTS if p not in counts]}")
    if sum(counts.values()) != df.count():
        raise ValueError("rows without a time are in no part")
    return {p: parted.filter(F.col("part") == p).drop("part") for p in PARTS}


def cut_runs(df: DataFrame, parts: dict[str, DataFrame], time: str = TIME) -> dict[str, tuple[int, int]]:
    """Label columns whose runs a split has cut: (runs in the table, runs in the parts)."""
    out = {}
    for c in (c for c in df.columns if c.startswith(LABEL_PREFIXES)):
        runs = lambda x, c=c: count_runs(x, [time], F.col(c) != 0).first()["runs"]
        whole, pieces = runs(df), sum(runs(p) for p in parts.values())
        if whole != pieces:
            out[c] = (whole, pieces)
    return out


def describe_parts(df: DataFrame, time: str = TIME) -> DataFrame:
    """(part, n_rows, share, first, last, <flag>_positives, <flag>_rate) of a table with `part`."""
    flags = [c for c in df.columns if c.startswith("is_")]
    counts = [x for c in flags for x in (F.sum((F.col(c) != 0).cast("long")).alias(f"{c}_positives"), F.avg((F.col(c) != 0).cast("double")).alias(f"{c}_rate"))]
    total = df.agg(F.count("*").alias("_all"))
    summed = df.groupBy("part").agg(F.count("*").alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"), *counts)
    return summed.join(F.broadcast(total), how="cross").withColumn("share", F.col("n_rows") / F.col("_all")).drop("_all")  # total is one row
