"""Column profiles and the choices drawn from them: pruning and imputation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.ordered import running_sum


def _long(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """(column, value), a row for each cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("x")).select("x.*")


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), in one pass."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias("null_share")) for c in columns]).alias("a"))
    return row.select(F.explode("a").alias("x")).select("x.*")


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, levels): distinct values without null; counted by value first."""
    seen = _long(df, columns).filter("value IS NOT NULL").groupBy("column", "value").count().groupBy("column").agg(F.count("*").alias("levels"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(seen, "column", "left").select("column", F.coalesce("levels", F.lit(0)).cast("long").alias("levels"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): exact medians."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.median(c).alias("value")) for c in columns]).alias("a"))
    return row.select(F.explode("a").alias("x")).select("x.*")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the commonest value as text, the smallest on ties."""
    counts = _long(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("m")).select("column", "m.value", (-F.col("m.less")).alias("n"))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns over the rows that have both, r without its sign."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(both(a, b)).alias("r")) for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("x")).select("x.*")


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """One row over (a, b, r): pairs, shares with r above 0.8 and 0.5, and the middle r."""
    above = lambda limit: F.avg((F.col("r") > limit).cast("double"))
    return pairs.agg(F.count("*").alias("pairs"), above(0.8).alias("above_80"), above(0.5).alias("above_50"), F.median("r").alias("middle"))


def entropies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, entropy) over the levels, as a share of the largest possible; 0 with one level."""
    counts = _long(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    nats = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return counts.groupBy("column").agg(F.when(F.count("*") < 2, 0.0).otherwise(nats / F.log(F.count("*").cast("double"))).alias("entropy"))


def cramer_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, v): Cramér's V of all pairs, with Yates' correction for two by two levels.

    Cells are counted once for all pairs. A pair with less than two levels on a side has 0;
    rows with a null in a pair count for the size but not for the cells.
    """
    pairs = list(combinations(columns, 2))
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs]))
    counts = df.select(cell.alias("c")).select("c.*").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("n"))
    sizes = counts.groupBy("a", "b").agg(F.sum("n").alias("size"))
    full = counts.filter("x IS NOT NULL AND y IS NOT NULL")
    rows = full.groupBy("a", "b", "x").agg(F.sum("n").alias("rx"))
    cols = full.groupBy("a", "b", "y").agg(F.sum("n").alias("cy"))
    shape = rows.groupBy("a", "b").agg(F.count("*").alias("nr"), F.sum("rx").alias("total")).join(cols.groupBy("a", "b").agg(F.count("*").alias("nc")), ["a", "b"])
    # cells without rows matter too: their expectation counts in full
    lattice = rows.join(cols, ["a", "b"]).join(shape, ["a", "b"]).join(full, ["a", "b", "x", "y"], "left")
    expected = F.col("rx") * F.col("cy") / F.col("total")
    off = F.abs(F.coalesce("n", F.lit(0.0)) - expected)
    off = F.when((F.col("nr") == 2) & (F.col("nc") == 2), off - F.least(F.lit(0.5), off)).otherwise(off)
    chi = lattice.groupBy("a", "b", "nr", "nc").agg(F.sum(off * off / expected).alias("chi"))
    v = F.sqrt(F.col("chi") / (F.col("size") * (F.least("nr", "nc") - 1)))
    measured = chi.join(sizes, ["a", "b"]).select("a", "b", F.when(F.least("nr", "nc") < 2, 0.0).otherwise(v).alias("v"))
    names = df.sparkSession.createDataFrame(pairs, "a string, b string")
    return names.join(measured, ["a", "b"], "left").select("a", "b", F.coalesce("v", F.lit(0.0)).alias("v"))


def prune(columns: list[str], strength: dict[str, float], tied: dict[tuple[str, str], float], limit: float) -> tuple[list[str], dict[str, str]]:
    """Columns that stay, in their order, and for each dropped one the kept one it repeats.

    Columns are visited by descending strength (earlier ones first on ties); one goes if it is
    tied above the limit to any that already stays.
    """
    kept: list[str] = []
    gone: dict[str, str] = {}
    for c in sorted(columns, key=lambda c: (-strength.get(c, 0.0), columns.index(c))):
        hit = next((k for k in kept if (tied.get((c, k)) or tied.get((k, c)) or 0.0) > limit), None)
        if hit is None:
            kept.append(c)
        else:
            gone[c] = hit
    return [c for c in columns if c in kept], gone


def prune_pearson(df: DataFrame, columns: list[str], limit: float = 0.99) -> tuple[list[str], dict[str, str]]:
    strength = {r["column"]: float(r["levels"]) for r in levels(df, columns).collect()}
    return prune(columns, strength, {(r["a"], r["b"]): r["r"] for r in pearson_pairs(df, columns).collect()}, limit)


def prune_cramer(df: DataFrame, columns: list[str], limit: float = 0.99) -> tuple[list[str], dict[str, str]]:
    strength = {r["column"]: r["entropy"] for r in entropies(df, columns).collect()}
    return prune(columns, strength, {(r["a"], r["b"]): r["v"] for r in cramer_pairs(df, columns).collect()}, limit)


def sparse_columns(df: DataFrame, columns: list[str], null_max: float = 0.30) -> list[str]:
    """Columns of which null_max or more is missing."""
    return [r["column"] for r in null_share(df, columns).filter(F.col("null_share") >= null_max).collect()]


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [r["column"] for r in levels(df, columns).filter("levels <= 1").collect()]


def constants_by(df: DataFrame, columns: list[str], part: str) -> DataFrame:
    """(part, column) of the columns that have at most one value in a part, such as a file."""
    cells = df.select(part, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(part, "x.*")
    values = cells.groupBy(part, "column", "value").count()
    return values.groupBy(part, "column").agg(F.count("value").alias("levels")).filter("levels <= 1").select(part, "column")


def fill_values(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, float]:
    """What stands in for a missing value: the median, or the mode of a categorical column."""
    found = {r["column"]: r["value"] for r in medians(train, numeric).collect()} if numeric else {}
    if categorical:
        found |= {r["column"]: float(r["value"]) for r in modes(train, categorical).collect()}
    return {c: v for c, v in found.items() if v is not None}


def imputed(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def final_check(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Repeated rows, constant columns and nulls that are left."""
    total, distinct = df.count(), df.distinct().count()
    nulls = {r["column"]: r["null_share"] for r in null_share(df, columns).filter("null_share > 0").collect()}
    return {"rows": total, "repeated_rows": total - distinct, "constant": constant_columns(df, columns), "null_share": nulls}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, median, max)."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.median(c).alias("median"), F.max(F.col(c).cast("double")).alias("max"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def state_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, levels, state, n, share): the dominant state of each actuator."""
    counts = modes(df, columns).withColumnRenamed("value", "state")
    return levels(df, columns).join(counts, "column", "left").join(df.agg(F.count("*").alias("_all")), how="cross").select("column", "levels", "state", "n", (F.col("n") / F.col("_all")).alias("share"))


def flagged_share(df: DataFrame, flag: Column, by: Column, name: str) -> DataFrame:
    """(name, n_rows, flagged, share) for each value of `by`, such as days or months."""
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n_rows"), F.sum(flag.cast("long")).alias("flagged"), F.avg(flag.cast("double")).alias("share"))


def subsystem_rollup(channels: DataFrame) -> DataFrame:
    """(subsystem, channels, targets, categorical) from (Channel, Subsystem, Target, Categorical)."""
    yes = lambda c: F.count(F.when(F.col(c) == "YES", 1))
    return channels.groupBy(F.col("Subsystem").alias("subsystem")).agg(F.count("*").alias("channels"), yes("Target").alias("targets"), yes("Categorical").alias("categorical"))


def leading_ladder(readings: DataFrame, channel: str, time: str) -> DataFrame:
    """(first, channels, present): how many channels begin at a time, and how many have by then."""
    begins = readings.groupBy(channel).agg(F.min(time).alias("first")).groupBy("first").agg(F.count("*").alias("channels"))
    return running_sum(begins, ["first"], "channels", "present")


def over_runs(runs: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Runs of an experiment, such as one for each seed: their number, mean and deviation."""
    return runs.groupBy(*groups).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
