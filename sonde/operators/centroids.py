"""K-Means as a one-class detector: distance to the nearest centroid."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(objects: DataFrame, k: int, seed: int = 42, max_iter: int = 50, vector: str = "_vec") -> list[list[float]]:
    """Centroids of rows with an array of features."""
    rows = objects.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return [c.tolist() for c in KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(rows).clusterCenters()]


def distance(vector: Column, centroids: list[list[float]]) -> Column:
    """Euclidean distance to the nearest centroid; evaluated without user functions."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    square = lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.array_min(F.transform(table, square)))


def scored(objects: DataFrame, centroids: list[list[float]], vector: str = "_vec") -> DataFrame:
    return objects.withColumn("score", distance(F.col(vector), centroids))
