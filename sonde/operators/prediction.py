"""Predictions from the cluster of the most similar labelled object, and refits over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.operators.neighbours import cosine_quantiles, dot, unit


def weighted_targets(placed: DataFrame, state: DataFrame, queries: DataFrame, objects: DataFrame, target: str) -> DataFrame:
    """(_row, prediction): over all members of the cluster a row was placed in, weighted by cosine.

    With unit vectors the weighted sum over members is a product with the members' sum, so a
    cluster needs two sums of vectors and a row two products; no row meets a member.
    """
    of = placed.join(state.select(F.col("_node").alias("_core"), "_cluster"), "_core").select("_row", "_cluster")
    members = state.filter("_cluster <> 0").join(objects.select(F.col("_id").alias("_node"), unit(F.col("_vec")).alias("_u"), F.col(target).cast("double").alias("_t")), "_node")
    terms = members.select("_cluster", "_t", F.posexplode("_u").alias("_k", "_x"))
    sums = terms.groupBy("_cluster", "_k").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_t")).alias("_st"))
    wide = sums.groupBy("_cluster").agg(F.sort_array(F.collect_list(F.struct("_k", "_s", "_st"))).alias("_a"))  # as many as a vector has
    wide = wide.select("_cluster", F.transform("_a", lambda a: a["_s"]).alias("_s"), F.transform("_a", lambda a: a["_st"]).alias("_st"))
    rows = of.join(queries.select("_row", unit(F.col("_vec")).alias("_q")), "_row").join(wide, "_cluster")
    return rows.select("_row", (dot(F.col("_q"), F.col("_st")) / dot(F.col("_q"), F.col("_s"))).alias("prediction"))


def rolling_days(df: DataFrame, day: str, window_size: int) -> DataFrame:
    """df once for each test day whose training window of days before it holds the row, with `test_day`."""
    first, last = df.agg(F.min(day), F.max(day)).first()
    later = F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, window_size)))
    return df.withColumn("test_day", later).filter((F.col("test_day") <= F.lit(last)) & (F.col("test_day") > F.lit(first)))


def similarity_quantiles(objects: DataFrame, shares: list[float]) -> DataFrame:
    """(share, similarity) of the distribution of pairwise similarities, to choose a threshold from."""
    found = cosine_quantiles(objects, shares)
    return objects.sparkSession.createDataFrame([(s, None if v is None else float(v)) for s, v in zip(shares, found, strict=True)], "share double, similarity double")
