"""Row-level repair and checks of telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.contracts import TIME, feature_columns
from sonde.functions.ordered import greatest_before, number_rows, previous, running_sum


def between(df: DataFrame, start=None, end=None, time: str = TIME) -> DataFrame:
    """Rows from start on and before end; either bound may be open."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(time) < F.lit(end))
    return df


def drop_empty_rows(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Rows in which any feature has a value."""
    return df.dropna(how="all", subset=features or feature_columns(df.columns))


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """One of each set of rows that agree in all columns, the time included."""
    return df.dropDuplicates()


def to_numbers(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    """Columns as numbers; what is none becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(trim(cast(`{c}` AS string)) AS {kind})") for c in columns})


def clean_label(column: Column) -> Column:
    """A label text without any blanks, as raw files put them anywhere."""
    return F.regexp_replace(column, r"\s+", "")


def only_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """df, if the column holds nothing else; stops at the first other value."""
    odd = df.filter(F.col(column).isNull() | ~F.col(column).isin(allowed)).select(column).limit(1).collect()
    if odd:
        raise ValueError(f"{column} holds {odd[0][0]!r}, expected one of {allowed}")
    return df


def factorise(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """df with codes 0, 1, 2 ... in order of first appearance; null is -1."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.min(F.struct(*order)).alias("_first"))
    coded = number_rows(first.select("_value", "_first.*"), order, name).select("_value", F.col(name).cast("int").alias(name))
    return df.join(coded, F.col(column) == F.col("_value"), "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(-1)))


def order_faults(df: DataFrame, time: str = TIME) -> DataFrame:
    """One row: times that occur more than once, and rows."""
    return df.groupBy(time).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("repeated_times"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n_rows"))


def backward_steps(df: DataFrame, position: str, time: str = TIME) -> DataFrame:
    """Rows, in order of a position, whose time is before that of the row before."""
    return previous(df, [position], {"_before": time}).filter(F.col(time) < F.col("_before")).withColumnRenamed("_before", "previous_time")


def block_profile(df: DataFrame, position: str, flag: Column, time: str = TIME) -> DataFrame:
    """Rows, flagged rows and bounds of each block between backward steps of time."""
    seen = previous(df, [position], {"_before": time})
    step = F.when(F.col(time) < F.col("_before"), 1).otherwise(0).cast("long")
    blocks = running_sum(seen, [position], step, "block")
    return blocks.groupBy("block").agg(F.count("*").alias("n_rows"), F.sum(flag.cast("long")).alias("flagged"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def gaps(df: DataFrame, expected: int, time: str = TIME) -> DataFrame:
    """Times that do not come `expected` seconds after the one before, with the gap."""
    seen = previous(df, [time], {"_before": time}).filter(F.col("_before").isNotNull())
    gap = (F.unix_timestamp(time) - F.unix_timestamp("_before")).cast("long")
    return seen.select(F.col("_before").alias("previous_time"), time, gap.alias("gap")).filter(F.col("gap") != expected)


def check_alignment(values: DataFrame, labels: DataFrame, time: str = TIME) -> DataFrame:
    """Values with the labels of the same times; raises if the times differ in any way."""
    left, right = values.select(time), labels.select(time)
    if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
        raise ValueError("values and labels do not have the same times")
    return values.join(labels, time)


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their place in either order; both must have as many rows."""
    a, b = number_rows(left, left_order, "_place"), number_rows(right, right_order, "_place")
    if left.count() != right.count():
        raise ValueError("both sides need the same number of rows")
    return a.join(b, "_place")


def every_nth(df: DataFrame, order: list[str], n: int, first: int = 0) -> DataFrame:
    """Every n-th row of an order, from the place `first` on."""
    return number_rows(df, order, "_place").filter(F.col("_place") % n == first % n).drop("_place")


def identical_schemas(frames: dict[str, DataFrame]) -> None:
    first = next(iter(frames.values())).columns
    for name, df in frames.items():
        if df.columns != first:
            raise ValueError(f"{name} has other columns: {sorted(set(df.columns) ^ set(first)) or 'in another order'}")


def overlapping_spans(spans: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Pairs of names whose spans overlap, by comparing each start with the largest end before it."""
    seen = greatest_before(spans, [start, name], F.struct(end, name), "_upto")
    return seen.filter(F.col("_upto")[end] >= F.col(start)).select(F.col("_upto")[name].alias("earlier"), F.col(name).alias("later"))
