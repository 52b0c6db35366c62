"""Running sums over one global order, without a task that sees all rows.

Rows are dealt into ranges of the order and sorted within them; each task sums its own range
while rows stream by. The ranges are written, so that they cannot move, and the totals of
ranges (one row each, as many as partitions) give what comes before each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sonde.functions.shipping import map_batches
from sonde.llm import scratch


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums: {name: value} adds up the long column `value` over all earlier rows.

    `order` has columns that tell all rows apart; null sorts first.
    """
    spark = df.sparkSession
    columns = df.columns
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            before = []
            for name, value in sums.items():
                size = b.column(columns.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
                before.append(pa.array(so_far[name] + np.cumsum(size) - size))
                so_far[name] += int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *before], names=[*columns, "_part", *sums])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = scratch.save(map_batches(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), run, schema), "running")
    totals = summed.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in sums])
    joined = summed.join(F.broadcast(offsets), "_part")  # one row for each partition
    return joined.select(*columns, *[(F.col(n) + F.col(f"_offset_{n}")).cast("long").alias(n) for n in sums])
