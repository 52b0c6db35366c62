"""Joins in time: zero-order hold onto a regular grid, and interval labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.ordered import last_known


def grid(bounds: DataFrame, first: str, last: str, seconds: int, time: str = "datetime") -> DataFrame:
    """Every `seconds` seconds from the one at or before `first` up to `last`; bounds has one row."""
    begin = F.floor(F.unix_timestamp(first) / seconds) * seconds
    steps = F.explode(F.sequence(begin.cast("long"), F.unix_timestamp(last).cast("long"), F.lit(seconds).cast("long")))
    return bounds.select(steps.alias("_s")).select(F.timestamp_seconds("_s").cast("timestamp_ntz").alias(time))


def hold(readings: DataFrame, instants: DataFrame, channel: str, time: str, value: str) -> DataFrame:
    """(channel, time, value) at each instant: the latest reading at or before it, else null.

    instants has channel and time. Readings and instants are one stream in which a reading
    precedes an instant of the same time, so each side is dealt out once and nothing is
    compared pair by pair.
    """
    a = readings.select(channel, time, F.lit(0).alias("_kind"), F.col(value).alias(value))
    b = instants.select(channel, time, F.lit(1).alias("_kind"), F.lit(None).cast(readings.schema[value].dataType).alias(value))
    known = last_known(a.unionByName(b), [time, "_kind"], value, "_held", [channel])
    return known.filter("_kind = 1").select(channel, time, F.col("_held").alias(value))


def wide(held: DataFrame, channel: str, time: str, value: str, channels: list[str]) -> DataFrame:
    """One row for each time with a column for each channel."""
    return held.groupBy(time).pivot(channel, channels).agg(F.first(value))


def interval_labels(instants: DataFrame, intervals: DataFrame, channel: str, time: str, start: str, end: str, rank: Column, seconds: int) -> DataFrame:
    """instants with `label`: the highest rank of the intervals of their channel that hold them, else 0.

    Both ends count. Intervals are cut at multiples of `seconds`, so that the join is on
    channel and slot with the exact bounds as a remaining condition.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    parts = intervals.select(F.col(channel).alias("_c"), F.col(start).alias("_from"), F.col(end).alias("_to"), rank.alias("_rank"), F.explode(F.sequence(slot(start), slot(end))).alias("_slot"))
    keyed = instants.withColumn("_slot", slot(time))
    hit = keyed.join(parts, (keyed[channel] == parts["_c"]) & (keyed["_slot"] == parts["_slot"]) & (F.col(time) >= F.col("_from")) & (F.col(time) <= F.col("_to")))
    best = hit.groupBy(channel, time).agg(F.max("_rank").alias("label"))
    return instants.join(best, [channel, time], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def touching(intervals: DataFrame, channels: DataFrame, channel: str, start: str, end: str, first, last) -> DataFrame:
    """Intervals of known channels that reach into the time from first to last."""
    return intervals.filter((F.col(start) <= F.lit(last)) & (F.col(end) >= F.lit(first))).join(channels.select(channel).distinct(), channel, "left_semi")
