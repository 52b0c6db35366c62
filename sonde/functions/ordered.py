"""Functions of one global order that no single task has to see whole.

Rows are dealt into ranges of the whole order, cut where a sample says that about ``ROWS``
rows lie between cuts, whatever values the rows have. The ranges are written, so that they
cannot move; windows run within ranges, and a summary with one row for each range carries
totals or last values from one to the next. The summary has rows / ROWS rows, so it is small
at any size, and it is broadcast under that bound. Rows that agree in the whole order are
the only ones that cannot be told apart; they share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sonde.functions import staging

ROWS = 1_000_000
_B = "__bucket"


def bucketed(df: DataFrame, order: list[str], descending: bool = False, rows: int = ROWS) -> DataFrame:
    """df with the number of a range, which ascends with the order; nulls come first."""
    if isinstance(df.schema[order[0]].dataType, T.StringType):
        raise TypeError(f"{order[0]} is neither a number nor a time")
    n = df.count()
    if n <= rows:
        return df.withColumn(_B, F.lit(0))
    dealt = df.repartitionByRange(-(-n // rows), *_keys(order, descending)).withColumn(_B, F.spark_partition_id())
    return staging.save(dealt, "ranges")


def _keys(order: list, descending: bool) -> list[Column]:
    first, *rest = order
    return [F.col(first).desc_nulls_first() if descending else F.col(first).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in rest]]


def _with_summary(buckets: DataFrame, summary: DataFrame, groups: list[str]) -> DataFrame:
    joined = summary if groups else F.broadcast(summary)  # without groups, a row for each bucket
    on = buckets[_B] == joined["__b"]
    for g in groups:
        on = on & buckets[g].eqNullSafe(joined[f"__g_{g}"])
    return buckets.join(joined, on, "left").drop("__b", *[f"__g_{g}" for g in groups])


def running_sum(df: DataFrame, order: list[str], value: Column | str, name: str, descending: bool = False, inclusive: bool = True, rows: int = ROWS) -> DataFrame:
    """df with the sum of `value` over all rows up to each one, or before it."""
    value = F.col(value) if isinstance(value, str) else value
    buckets = bucketed(df.withColumn("__v", value), order, descending, rows)
    totals = buckets.groupBy(F.col(_B).alias("__b")).agg(F.sum("__v").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    summary = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(_B).orderBy(*_keys(order, descending)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum("__v").over(within), F.lit(0))
    return _with_summary(buckets, summary, []).withColumn(name, local + F.col("__off")).drop("__v", "__off", _B)


def number_rows(df: DataFrame, order: list[str], name: str = "_id", start: int = 0, rows: int = ROWS) -> DataFrame:
    """df with dense numbers in the order, from `start` on."""
    counted = running_sum(df, order, F.lit(1).cast("long"), name, inclusive=False, rows=rows)
    return counted.withColumn(name, (F.col(name) + start).cast("long"))


def previous(df: DataFrame, order: list[str], columns: dict[str, str], groups: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """df with {name: column} of the row before each one (within `groups`, if given)."""
    groups = groups or []
    buckets = bucketed(df, order, rows=rows)
    keys = _keys(order, False)
    held = F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(columns.values())])
    last = buckets.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col(_B).alias("__b")).agg(F.max_by(held, F.struct(*order)).alias("__last"))
    summary = last.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*[f"__g_{g}" for g in groups]).orderBy("__b"))).drop("__last")
    within = Window.partitionBy(*groups, _B).orderBy(*keys)
    out = _with_summary(buckets, summary, groups).withColumn("__n", F.row_number().over(within)).withColumn("__lag", F.lag(held).over(within))
    for k, name in enumerate(columns):
        out = out.withColumn(name, F.when(F.col("__n") == 1, F.col(f"__prev.v{k}")).otherwise(F.col(f"__lag.v{k}")))
    return out.drop("__prev", "__n", "__lag", _B)


def greatest_before(df: DataFrame, order: list[str], value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """df with the greatest `value` of all rows before each one; null for the first."""
    buckets = bucketed(df.withColumn("__v", value), order, rows=rows)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    summary = buckets.groupBy(F.col(_B).alias("__b")).agg(F.max("__v").alias("__t")).select("__b", F.max("__t").over(before).alias("__most"))
    within = Window.partitionBy(_B).orderBy(*_keys(order, False)).rowsBetween(Window.unboundedPreceding, -1)
    here = _with_summary(buckets, summary, []).withColumn("__here", F.max("__v").over(within))
    return here.withColumn(name, F.greatest("__here", "__most")).drop("__v", "__here", "__most", _B)


def last_known(df: DataFrame, order: list[str], value: str, name: str, groups: list[str], rows: int = ROWS) -> DataFrame:
    """df with the latest value of `value` that is not null, up to each row, within groups."""
    buckets = bucketed(df, order, rows=rows)
    held = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    last = buckets.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col(_B).alias("__b")).agg(held.alias("__last"))
    before = Window.partitionBy(*[f"__g_{g}" for g in groups]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    summary = last.withColumn("__prev", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    within = Window.partitionBy(*groups, _B).orderBy(*_keys(order, False)).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_summary(buckets, summary, groups)
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("__prev"))).drop("__prev", _B)
