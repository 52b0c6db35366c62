"""Standard scores with statistics of the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP = ("_mode",)


def scalable(names: list[str], skip: tuple[str, ...] = SKIP) -> list[str]:
    return [n for n in names if not n.endswith(skip)]


def window_statistics(train: DataFrame, names: list[str], skip: tuple[str, ...] = SKIP) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of each feature; a deviation of nothing becomes 1."""
    chosen = scalable(names, skip)
    parts = [x for k, n in enumerate(chosen) for x in (F.avg(n).alias(f"m{k}"), F.stddev_samp(n).alias(f"s{k}"))]
    row = train.agg(*parts).first() if parts else {}
    return {n: (float(row[f"m{k}"] or 0.0), float(row[f"s{k}"] or 1.0) or 1.0) for k, n in enumerate(chosen)}


def apply_scaling(df: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: (F.col(n) - F.lit(m)) / F.lit(s) for n, (m, s) in statistics.items()})
