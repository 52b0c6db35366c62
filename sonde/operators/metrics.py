"""Quality of scores against labels, as aggregates.

Rows with equal scores are counted first, so that what is ordered are distinct scores; running
sums over them need no single task. Columns are `y` (0 or 1) and `score`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.ordered import running_sum
from sonde.operators.runs import marked_runs

GRID = (0.50, 0.9999, 400)


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def ranking(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: rows, positives, base_rate, roc_auc and average_precision (null if undefined)."""
    counts = _by_score(df, y, score)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tp = running_sum(counts, ["s"], "pos", "tp", descending=True)
    both = running_sum(tp, ["s"], "neg", "fp", descending=True).join(F.broadcast(totals), how="cross")  # totals is one row
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (F.first("P") * F.first("N"))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("P")
    p, n = F.first("P"), F.first("N")
    return both.agg(
        (p + n).alias("n_rows"), p.alias("positives"), (p / (p + n)).alias("base_rate"),
        F.when((p > 0) & (n > 0), area).alias("roc_auc"), F.when(p > 0, precision).alias("average_precision"),
    )


def at_threshold(df: DataFrame, threshold: Column | float, y: str = "y", score: str = "score") -> DataFrame:
    """One row: tp, fp, fn, tn, flagged, flagged_share, precision, recall and f1; 0 where undefined."""
    said = F.col(score) >= threshold
    truth = F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    row = df.agg(n(said & truth).alias("tp"), n(said & ~truth).alias("fp"), n(~said & truth).alias("fn"), n(~said & ~truth).alias("tn"))
    flagged, total = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return row.select("*", flagged.alias("flagged"), share(flagged, total).alias("flagged_share"), share(F.col("tp"), flagged).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def threshold_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(k, threshold, f1) for thresholds at a grid of quantiles of the score.

    One pass counts how many thresholds of the grid each distinct score reaches; sums from
    the highest down give all confusion counts.
    """
    start, stop, n = GRID
    shares = np.linspace(start, stop, n).tolist()
    grid = df.agg(F.percentile(score, F.array(*[F.lit(q) for q in shares])).alias("t")).first()["t"]  # `n` numbers
    if not grid:
        return df.sparkSession.createDataFrame([], "k int, threshold double, f1 double")
    reach = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("s")))
    counts = _by_score(df, y, score).groupBy(reach.alias("reach")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counts.agg(F.sum("pos").alias("P"))
    steps = df.sparkSession.createDataFrame([(k, t) for k, t in enumerate(grid)], "k int, threshold double")
    reached = F.broadcast(steps).join(counts, F.col("reach") > F.col("k")).groupBy("k", "threshold").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    return reached.join(F.broadcast(totals), how="cross").select("k", "threshold", F.when(F.col("tp") == 0, 0.0).otherwise(f1).alias("f1"))


def best_threshold(df: DataFrame, y: str = "y", score: str = "score") -> float:
    """The threshold of the grid with the best f1, the lowest on ties."""
    row = threshold_curve(df, y, score).orderBy(F.col("f1").desc(), "k").first()
    return float(row["threshold"])


def segment_recall(df: DataFrame, order: list[str], threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """One row: runs of positives, those with a flagged row, and their share (null without runs)."""
    runs = marked_runs(df, order, F.col(y) == 1).groupBy("run").agg(F.max((F.col(score) >= threshold).cast("int")).alias("hit"))
    return runs.agg(F.count("*").alias("segments"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("segments_caught")).withColumn("segment_recall", F.when(F.col("segments") > 0, F.col("segments_caught") / F.col("segments")))


def metrics(df: DataFrame, order: list[str], threshold: float | None = None, y: str = "y", score: str = "score") -> dict[str, float]:
    """All of the above; without a threshold, with the best one of the grid."""
    threshold = best_threshold(df, y, score) if threshold is None else threshold
    out = {**ranking(df, y, score).first().asDict(), "threshold": threshold}
    row = at_threshold(df, threshold, y, score).first().asDict()
    return out | {k: row[k] for k in ("flagged", "flagged_share", "precision", "recall", "f1")} | segment_recall(df, order, threshold, y, score).first().asDict()


def fill_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Missing scores become a little more than the largest one."""
    largest = df.agg((F.max(score) * 1.01).alias("_most"))
    return df.join(F.broadcast(largest), how="cross").withColumn(score, F.coalesce(score, "_most")).drop("_most")  # one row


def rmse(df: DataFrame, truth: str, guess: str, groups: list[str]) -> DataFrame:
    """One row: the pooled RMSE, the mean of the groups' RMSEs, and the pooled MAE."""
    off = F.col(guess) - F.col(truth)
    each = df.groupBy(*groups).agg(F.sum(off * off).alias("sq"), F.sum(F.abs(off)).alias("ab"), F.count("*").alias("n"))
    return each.agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse_pooled"), F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("rmse_macro"), (F.sum("ab") / F.sum("n")).alias("mae"))
