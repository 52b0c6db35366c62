"""Runs of positive rows: counting, bounds and checks across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.ordered import previous, running_sum


def marked_runs(df: DataFrame, order: list[str], positive: Column) -> DataFrame:
    """Positive rows with `run`, the number of their run of neighbouring positive rows."""
    flagged = df.withColumn("_y", F.coalesce(positive.cast("int"), F.lit(0)))
    seen = previous(flagged, order, {"_before": "_y"})
    starts = seen.withColumn("_start", ((F.col("_y") == 1) & (F.coalesce("_before", F.lit(0)) == 0)).cast("long"))
    return running_sum(starts, order, "_start", "run").filter("_y = 1").drop("_y", "_before", "_start")


def count_runs(df: DataFrame, order: list[str], positive: Column) -> DataFrame:
    """One row: how many runs of positive rows there are."""
    flagged = df.withColumn("_y", F.coalesce(positive.cast("int"), F.lit(0)))
    seen = previous(flagged, order, {"_before": "_y"})
    return seen.agg(F.coalesce(F.sum(((F.col("_y") == 1) & (F.coalesce("_before", F.lit(0)) == 0)).cast("long")), F.lit(0)).alias("runs"))


def run_bounds(df: DataFrame, order: list[str], positive: Column) -> DataFrame:
    """(run, first, last, n_rows) over the first column of the order."""
    return marked_runs(df, order, positive).groupBy("run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n_rows"))


def segment_summary(df: DataFrame, order: list[str], positive: Column) -> DataFrame:
    """One row: runs, their least, middle and largest number of rows, and the largest's share."""
    sizes = marked_runs(df, order, positive).groupBy("run").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("segments"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_share"))
