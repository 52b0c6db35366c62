"""Tumbling windows over a stream of readings, with late readings up to a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions import staging


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_windows(stream: DataFrame, column: str, seconds: int, label: Column, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """(window_start, n_rows, mean, std, label) of a stream; windows start at multiples of `seconds`."""
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", lateness)
    sums = timed.groupBy(F.window("_ts", f"{seconds} seconds")).agg(F.count("*").alias("n_rows"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.max(label.cast("double")).alias("label"))
    return sums.select(F.unix_timestamp("window.start").alias("window_start"), "n_rows", "mean", "std", "label")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its last result as a table."""
    spark = stream.sparkSession
    path, marks = staging.new_path(spark, "stream"), staging.new_path(spark, "stream-marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
