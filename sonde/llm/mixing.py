"""Mixing sources to target weights by weighted sampling without replacement.

Sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all
words; a target stops at ``EPOCHS`` times its source's size and the excess is shared again.
With sources sorted by the share at which they reach that stop, those that do are the first
of them, so running sums give all targets at once.

Of each source, whole epochs are taken first. The rest is filled by Efraimidis-Spirakis
sampling: a document's key is -ln(u) / quality with u from a hash of its id, and documents
are taken in ascending order of keys while their running size fits the budget. What then
is missing is closed by the one further document whose size comes nearest to it, if that
brings the sum nearer. The order is one global order over (source, key) that is cut into
ranges, so a source with a third of all rows is no single task.

Edge cases: texts without words have size 0 and are never taken; a null source is a source; null
ids are drawn by the text; repeated rows are documents of their own; further columns have no
influence; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm import scratch
from sonde.llm.running import running_sums
from sonde.llm.textexpr import let, white_words, whole, without

WEIGHTS = (5, 2, 1)
#: All targets together are 3/2 of all sizes; kept as whole numbers for exact sums.
SHARE = (3, 2)
EPOCHS = 2
SYMBOLS = "#*$%&|<>"
LEAST_QUALITY = 0.05


def quality(words: Column, text: Column) -> Column:
    """A document's weight in (0, 1]: its share of distinct words, less for symbols among them."""
    n = F.size(words)
    symbols = F.length(text) - F.length(without(text, SYMBOLS))
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(LEAST_QUALITY), F.size(F.array_distinct(words)) / n / (1 + symbols / n)))


def _measured(rows: DataFrame, seed: int) -> DataFrame:
    """rows (uid, doc_id, source, text) with size and key instead of the text."""
    text = whole("text")
    seen = let(white_words(text), lambda w: F.struct(F.size(w).cast("long").alias("size"), quality(w, text).alias("quality")))
    digest = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text)))
    u = (F.shiftrightunsigned(digest, 11) + 0.5) / float(1 << 53)
    return rows.withColumn("x", seen).select("uid", "doc_id", "source", "x.size", (-F.log(u) / F.col("x.quality")).alias("key"), F.xxhash64("text").alias("tie"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with rank, base (sizes of all earlier sources) and target."""
    rank_order = [F.col("source").isNull(), F.col("source")]
    numbered = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), rank_order, {"rank": "one", "base": "source_size"})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = numbered.withColumn("weight", weight)
    stopping = running_sums(weighed, [F.col("source_size") / F.col("weight"), F.col("rank")], {"stopped": "source_size", "passed": "weight"})
    total = stopping.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    up, down = SHARE
    # what is left for this source and those after it, and whether its part of that passes the stop
    left = up * F.col("all_size") - down * EPOCHS * F.col("stopped")
    stops = left * F.col("weight") >= down * EPOCHS * F.col("source_size") * (F.col("all_weight") - F.col("passed"))
    marked = stopping.join(F.broadcast(total), how="cross").withColumn("stops", stops)  # total is one row
    held = marked.agg(F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(F.col("stops"), F.col("weight"))), F.lit(0)).alias("held_weight"))
    share = (up * F.col("all_size") - down * EPOCHS * F.col("held")) / down * F.col("weight") / (F.col("all_weight") - F.col("held_weight"))
    target = F.when(F.col("stops"), (EPOCHS * F.col("source_size")).cast("double")).otherwise(share.cast("double"))
    return marked.join(F.broadcast(held), how="cross").select("source", "source_size", "rank", "base", target.alias("target"))


def mix(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows (uid, doc_id, source, text) as (uid, doc_id, size, source_size, target, times, taken)."""
    slim = scratch.save(_measured(rows, seed), "measured")
    aims = scratch.save(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    joined = slim.join(aims, slim["source"].eqNullSafe(aims["source"])).select("uid", "doc_id", "size", "key", "tie", "rank", "base", "source_size", "target")
    placed = running_sums(joined, ["rank", "key", "tie", "uid"], {"before": "size"})
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    split = placed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    split = split.withColumn("upto", F.col("before") - F.col("base") + F.col("size"))
    chosen = split.withColumn("drawn", F.col("upto") <= F.col("rest"))
    gaps = chosen.groupBy("rank").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("drawn"), F.col("upto"))), F.lit(0))).alias("gap"))
    missing = F.abs(F.col("gap") - F.col("size"))
    near = chosen.filter("NOT drawn").join(gaps, "rank").filter(missing < F.col("gap"))
    closing = near.groupBy("rank").agg(F.min(F.struct(missing.alias("off"), "key", "tie", "uid")).alias("m")).select(F.col("m.uid").alias("uid"), F.lit(True).alias("closes"))
    once_more = F.when(F.col("drawn") | F.coalesce("closes", F.lit(False)), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("epochs") + once_more).otherwise(0)  # nothing of a text without words is ever missing
    return chosen.join(closing, "uid", "left").select("uid", "doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix takes it, with their own columns."""
    rows = scratch.by_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    plan = mix(rows.select("uid", F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{source}`").alias("source"), F.col(f"row.`{text}`").alias("text")), seed)
    repeats = plan.filter("times > 0").select("uid", "times")
    return rows.join(repeats, "uid").withColumn("_time", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "text")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")
