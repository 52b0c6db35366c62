"""Tumbling windows over telemetry and the features taken from them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.contracts import TIME, window_names
from sonde.functions.ordered import previous


def sampling_period(df: DataFrame, time: str = TIME) -> int:
    """The commonest gap between readings in seconds; of equally common ones the smallest."""
    row = gap_counts(df, time).orderBy(F.col("n").desc(), F.col("gap")).first()
    if row is None or row["gap"] <= 0:
        raise ValueError("no positive gap between readings")
    return int(row["gap"])


def gap_counts(df: DataFrame, time: str = TIME) -> DataFrame:
    """(gap, n) of whole seconds between neighbouring readings."""
    seen = previous(df.select(time), [time], {"_before": time}).filter(F.col("_before").isNotNull())
    return seen.groupBy((F.unix_timestamp(time) - F.unix_timestamp("_before")).cast("long").alias("gap")).agg(F.count("*").alias("n"))


def bucket(time: str, seconds: int) -> Column:
    """Seconds since the epoch at which a row's window starts."""
    return (F.floor(F.unix_timestamp(time) / seconds) * seconds).cast("long")


def numeric_windows(df: DataFrame, columns: list[str], seconds: int, label: Column | None = None, time: str = TIME) -> DataFrame:
    """(_w, <c>_mean, <c>_std ..., label, _rows); std over the population, nothing known is 0."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_std")]
    if label is not None:
        parts.append(F.max(label.cast("double")).alias("label"))
    return df.groupBy(bucket(time, seconds).alias("_w")).agg(*parts, F.count("*").alias("_rows"))


def categorical_windows(df: DataFrame, columns: list[str], seconds: int, time: str = TIME) -> DataFrame:
    """(_w, _column, mode, entropy, nunique, maxprop): a row for each window and column.

    Values are counted first, so the second step sees one row for each value of a window.
    Ties of the mode go to the smallest value; entropy is in nats.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
    counts = df.select(bucket(time, seconds).alias("_w"), values.alias("_v")).select("_w", "_v.*").filter("_value IS NOT NULL").groupBy("_w", "_column", "_value").agg(F.count("*").alias("_n"))
    n, total = F.col("_n").cast("double"), F.sum("_n").cast("double")
    return counts.groupBy("_w", "_column").agg(
        F.min(F.struct((-F.col("_n")).alias("_less"), F.col("_value")))["_value"].alias("mode"),
        (F.log(total) - F.sum(n * F.log(n)) / total).alias("entropy"),
        F.count("*").cast("double").alias("nunique"),
        (F.max("_n") / total).alias("maxprop"),
    )


def window(df: DataFrame, columns: list[str], steps: int, label: str, categorical: list[str] | None = None, min_coverage: float = 0.0, period: int | None = None, time: str = TIME) -> tuple[DataFrame, list[str]]:
    """One row for each tumbling window of `steps` readings, and the ordered feature names."""
    if steps < 2:
        raise ValueError("a window needs two readings at least")
    categorical = [c for c in columns if c in set(categorical or ())]
    plain = [c for c in columns if c not in categorical]
    seconds = steps * (period or sampling_period(df, time))
    out = numeric_windows(df, plain, seconds, F.col(label), time)
    if categorical:
        rows = categorical_windows(df, categorical, seconds, time)
        four = ("mode", "entropy", "nunique", "maxprop")
        summary = rows.groupBy("_w").pivot("_column", categorical).agg(*[F.first(s).alias(s) for s in four])
        out = out.join(summary, "_w", "left").fillna(0.0, [f"{c}_{s}" for c in categorical for s in four])
    names = window_names(columns, categorical)
    out = covered(out, steps, min_coverage) if min_coverage else out
    return out.select(F.timestamp_seconds("_w").cast("timestamp_ntz").alias(time), F.col("label").alias(label), "_rows", *names), names


def floor_rows(steps: int, min_coverage: float) -> int:
    return max(1, ceil(min_coverage * steps))


def covered(windows: DataFrame, steps: int, min_coverage: float) -> DataFrame:
    """Windows that hold enough of the readings they should."""
    return windows.filter(F.col("_rows") >= floor_rows(steps, min_coverage))


def packed(windows: DataFrame, names: list[str], keep: list[str], vector: str = "_vec") -> DataFrame:
    """Features as one array, in the order of their names."""
    return windows.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias(vector))


def rate_of_change(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """For each group: readings, changes from one to the next, and their share."""
    rows = df.select(group, *order, F.col(value).alias("_v"))
    seen = previous(rows, order, {"_before": "_v"}, [group])
    changed = F.sum((F.col("_before").isNotNull() & (F.col("_v") != F.col("_before"))).cast("long"))
    return seen.groupBy(group).agg(F.count("*").alias("n_rows"), changed.alias("changes"), (changed / F.count("*")).alias("rate"))
