"""Writers: tables, shards of clusters, and JSON reports."""

from __future__ import annotations

import heapq
import json
import math
import os
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Writes df to path; a table that is there stays unless overwrite is set. Tells whether it wrote.

    Rows go to a folder beside path first, which takes its place once it is whole: a job that
    fails leaves the old table as it was, and df may read the table that it replaces.
    """
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(where)
    if there and not overwrite:
        return False
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{tag}-{uuid.uuid4().hex}") for tag in ("new", "old"))
    try:
        df.write.parquet(new.toString())
        if there and not files.rename(where, old):
            raise OSError(f"{path} cannot be moved")
        if not files.rename(new, where):
            if there:
                files.rename(old, where)
            raise OSError(f"{path} cannot be written")
    finally:
        files.delete(new, True)
    files.delete(old, True)
    return True


def balanced(counts: Mapping[int, int], replicas: int) -> dict[int, int]:
    """Clusters to replicas: from the largest on, each goes where least has gone (the first of equals)."""
    heap = [(0, k) for k in range(replicas)]
    out = {}
    for n, c in sorted((-n, c) for c, n in counts.items()):
        load, out[c] = heap[0]
        heapq.heapreplace(heap, (load - n, out[c]))
    return out


def replica_table(queries: DataFrame, replicas: int) -> DataFrame:
    """(_cluster, _replica) with loads by the number of queries; a row for each cluster."""
    counts = {r["_cluster"]: r["count"] for r in queries.groupBy("_cluster").count().collect()}
    rows = list(balanced(counts, replicas).items())
    return queries.sparkSession.createDataFrame(rows, "_cluster long, _replica int")


def write_shards(path: str, replicas: int, frames: Mapping[str, DataFrame], assigned: DataFrame) -> dict[str, int]:
    """Writes each frame (with `_cluster`) below path/<name> by replica; returns and checks row counts."""
    out = {}
    for name, df in frames.items():
        seen = Observation(name)
        rows = df.join(assigned, "_cluster").repartition(replicas, "_replica").observe(seen, F.count("*").alias("n"))
        rows.write.mode("overwrite").partitionBy("_replica").parquet(f"{path}/{name}")
        out[name] = seen.get["n"]
        if out[name] != df.join(assigned, "_cluster", "left_semi").count():
            raise RuntimeError(f"{name}: not all rows were written")
    return out


def read_shard(spark, path: str, name: str, replica: int) -> DataFrame:
    """One replica's rows; only its partition is read."""
    return spark.read.parquet(f"{path}/{name}").filter(F.col("_replica") == replica).drop("_replica")


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def replace_file(path: str | Path, text: str) -> Path:
    """A small file on the driver, which appears whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, prefix=f".{path.name}.", delete=False) as f:
        f.write(text)
    os.replace(f.name, path)
    return path


def write_json(values: Mapping, path: str | Path) -> Path:
    """A report; numbers that are not finite become null."""
    return replace_file(path, json.dumps(_plain(values), indent=2, default=str) + "\n")
