"""From raw recordings to pruned, imputed parts: ingest, split and process.

Each step reads tables and writes tables; what runs on the driver are lists of column names
and a few numbers about each column.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions.contracts import LABEL_PREFIXES, TIME, feature_columns
from sonde.operators import alignment, cleaning, profile, splitting
from sonde.sources import readers, writers

#: Fixed value: before this time some channels of the public ESA recordings have no reading.
ESA_START = "2000-02-28 06:22:30"


class Preprocessor:
    """Makes one labelled table in order of time. Subclasses say how values and labels are read."""

    def __init__(self, spark: SparkSession, source: str, out_dir: str, name: str, start=None, end=None):
        self.spark, self.source, self.out_dir, self.name, self.start, self.end = spark, source.rstrip("/"), out_dir.rstrip("/"), name, start, end

    def load_values(self) -> DataFrame:
        raise NotImplementedError

    def load_labels(self, values: DataFrame) -> DataFrame | None:
        """(datetime, labels) for the times of values; None if values has them."""
        return None

    def table(self) -> DataFrame:
        values = cleaning.between(self.load_values(), self.start, self.end)
        values = cleaning.drop_empty_rows(cleaning.drop_repeated_rows(values))
        labels = self.load_labels(values)
        return values if labels is None else cleaning.check_alignment(values, labels)

    def run(self, overwrite: bool = False) -> str:
        path = f"{self.out_dir}/full_{self.name}.parquet"
        writers.write_table(self.table().repartitionByRange(TIME).sortWithinPartitions(TIME), path, overwrite)
        return path


class SwatPreprocessor(Preprocessor):
    """One or more files of a plant's instruments with a text label in each row."""

    def load_values(self) -> DataFrame:
        return readers.read_labelled_csv(self.spark, self.source)


class HaiPreprocessor(Preprocessor):
    """Recordings in several files of the same columns; the labels of one stand in a side file."""

    def __init__(self, spark, source, out_dir, name, recordings: list[str], labelled: str, labels: str, **more):
        super().__init__(spark, source, out_dir, name, **more)
        self.recordings, self.labelled, self.labels = recordings, labelled, labels

    def load_values(self) -> DataFrame:
        plain = readers.read_recordings(self.spark, [f"{self.source}/{r}" for r in self.recordings]).withColumn("is_attack", F.lit(0).cast("byte"))
        attacked = readers.with_side_labels(self.spark, f"{self.source}/{self.labelled}", f"{self.source}/{self.labels}")
        cleaning.identical_schemas({"recordings": plain, "labelled": attacked})
        spans = None
        for k, df in enumerate((plain, attacked)):
            span = df.agg(F.lit(k).alias("part"), F.min(TIME).alias("first"), F.max(TIME).alias("last"))
            spans = span if spans is None else spans.unionByName(span)
        if cleaning.overlapping_spans(spans, "part", "first", "last").collect():
            raise ValueError("the recordings overlap in time")
        return plain.unionByName(attacked)


class EsaPreprocessor(Preprocessor):
    """Irregular channels held onto a regular grid, with labels from annotated intervals."""

    def __init__(self, spark, source, out_dir, name, seconds: int = 18, channels: list[str] | None = None, target_only: bool = False, **more):
        super().__init__(spark, source, out_dir, name, **more)
        self.seconds, self.channels, self.target_only = seconds, channels, target_only

    def _channels(self) -> DataFrame:
        known = readers.target_channels(self.spark, f"{self.source}/channels.csv", self.target_only)
        return known if self.channels is None else known.filter(F.col("channel").isin(self.channels))

    def _numbers(self, readings: DataFrame) -> DataFrame:
        """Values as numbers; a channel of texts gets codes in order of first appearance."""
        number = F.expr("try_cast(value AS double)")
        texts = readings.filter(F.col("value").isNotNull() & number.isNull()).select("channel").distinct()
        plain = readings.join(texts, "channel", "left_anti").select("channel", "ts", number.alias("value"))
        named = readings.join(texts, "channel", "left_semi")
        first = named.filter("value IS NOT NULL").groupBy("channel", "value").agg(F.min("ts").alias("first"))
        from pyspark.sql.window import Window

        codes = first.select("channel", "value", (F.row_number().over(Window.partitionBy("channel").orderBy("first", "value")) - 1).cast("double").alias("code"))
        coded = named.join(codes, ["channel", "value"], "left").select("channel", "ts", F.coalesce("code", F.lit(-1.0)).alias("value"))
        return plain.unionByName(coded)

    def table(self) -> DataFrame:
        wanted = self._channels()
        readings = readers.read_channels(self.spark, f"{self.source}/channels", wanted)
        missing = readers.missing_channels(readings, wanted)
        if missing:
            raise ValueError(f"no readings of {missing}")
        names = [r[0] for r in wanted.select("channel").distinct().orderBy("channel").collect()]
        bounds = readings.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        times = cleaning.between(alignment.grid(bounds, "first", "last", self.seconds), self.start, self.end)
        instants = times.withColumnRenamed(TIME, "ts").join(F.broadcast(wanted.select("channel").distinct()), how="cross")  # a row for each channel
        held = alignment.hold(self._numbers(readings), instants, "channel", "ts", "value")
        values = alignment.wide(held, "channel", "ts", "value", names)
        spans = readers.read_annotations(self.spark, f"{self.source}/labels.csv", f"{self.source}/anomaly_types.csv").withColumnRenamed("Channel", "channel")
        rank = F.when(F.col("Category") == "Anomaly", 1).otherwise(F.when(F.col("Category") == "Rare Event", 2).otherwise(0))
        order = F.when(rank == 1, 2).otherwise(F.when(rank == 2, 1).otherwise(0))  # an anomaly covers a rare event
        ends = times.agg(F.min(TIME).cast("string"), F.max(TIME).cast("string")).first()
        spans = alignment.touching(spans, wanted, "channel", "StartTime", "EndTime", *[F.lit(t).cast("timestamp_ntz") for t in ends])
        labels = alignment.interval_labels(instants, spans, "channel", "ts", "StartTime", "EndTime", order, 3600)
        kind = F.when(F.col("label") == 2, 1).when(F.col("label") == 1, 2).otherwise(0).cast("byte")
        named = labels.select("channel", "ts", kind.alias("label"))
        wide = named.groupBy("ts").pivot("channel", names).agg(F.first("label"))
        out = values.select("ts", *[F.col(n).cast("float").alias(n) for n in names]).join(wide.toDF("ts", *[f"label_{n}" for n in names]), "ts")
        any_of = lambda k: F.greatest(*[(F.col(f"label_{n}") == k).cast("byte") for n in names], F.lit(0).cast("byte"))
        return out.withColumns({"is_anomaly": any_of(1), "is_rare_event": any_of(2)}).withColumnRenamed("ts", TIME)


class Splitter:
    """Cuts a table into three parts in time and checks that no run of labels is torn."""

    def __init__(self, spark: SparkSession, source: str, out_dir: str, valid_start, test_start, name: str, first=None):
        if not str(valid_start) < str(test_start):
            raise ValueError("validation has to begin before test")
        self.spark, self.source, self.out_dir, self.name = spark, source, out_dir.rstrip("/"), name
        self.valid_start, self.test_start, self.first = valid_start, test_start, first

    def load(self) -> DataFrame:
        df = self.spark.read.parquet(self.source)
        return df if self.first is None else df.filter(F.col(TIME) >= F.lit(self.first).cast(df.schema[TIME].dataType))

    def check_order(self, df: DataFrame) -> None:
        repeated = cleaning.order_faults(df).first()["repeated_times"]
        if repeated:
            raise ValueError(f"{repeated} times occur more than once")

    def run(self, overwrite: bool = False) -> dict[str, str]:
        df = self.load()
        self.check_order(df)
        parts = splitting.cut(df, self.valid_start, self.test_start)
        torn = splitting.cut_runs(df, parts)
        if torn:
            raise ValueError(f"runs of labels are cut: {torn}")
        paths = {p: f"{self.out_dir}/{self.name}_{p}.parquet" for p in splitting.PARTS}
        for p, path in paths.items():
            writers.write_table(parts[p].repartitionByRange(TIME).sortWithinPartitions(TIME), path, overwrite)
        return paths

    def describe(self) -> DataFrame:
        return splitting.describe_parts(splitting.with_part(self.load(), self.valid_start, self.test_start))


class Processor:
    """Drops sparse, constant and repeated columns and fills what is missing, as the training part says."""

    def __init__(self, spark: SparkSession, split_dir: str, out_dir: str, name: str, categorical: list[str], null_max: float = 0.30, pearson_max: float = 0.99, cramer_max: float = 0.99):
        self.spark, self.split_dir, self.out_dir, self.name, self.categorical = spark, split_dir.rstrip("/"), out_dir.rstrip("/"), name, categorical
        self.null_max, self.pearson_max, self.cramer_max = null_max, pearson_max, cramer_max
        self.columns: list[str] = []
        self.fill: dict[str, float] = {}
        self.dropped: dict[str, object] = {}

    def prepare_train(self, df: DataFrame) -> DataFrame:
        return df

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def load(self) -> dict[str, DataFrame]:
        return {p: self.spark.read.parquet(f"{self.split_dir}/{self.name}_{p}.parquet") for p in splitting.PARTS}

    def fit(self, train: DataFrame) -> Processor:
        features = feature_columns(train.columns)
        if not self.categorical:
            raise ValueError("the categorical columns have to be declared")
        categorical = [c for c in features if c in set(self.categorical)]
        sparse = set(profile.sparse_columns(train, features, self.null_max))
        left = [c for c in features if c not in sparse]
        constant = set(profile.constant_columns(train, left))
        left = [c for c in left if c not in constant]
        numeric, levels = [c for c in left if c not in categorical], [c for c in left if c in categorical]
        kept_numeric, same_numeric = profile.prune_pearson(train, numeric, self.pearson_max) if len(numeric) > 1 else (numeric, {})
        kept_levels, same_levels = profile.prune_cramer(train, levels, self.cramer_max) if len(levels) > 1 else (levels, {})
        kept = set(kept_numeric) | set(kept_levels)
        self.columns = [c for c in left if c in kept]
        self.fill = profile.fill_values(train, kept_numeric, kept_levels)
        self.dropped = {"sparse": sorted(sparse), "constant": sorted(constant), "repeats": same_numeric | same_levels}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        labels = [c for c in df.columns if c.startswith(LABEL_PREFIXES)]
        return profile.imputed(df.select(TIME, *self.columns, *labels), self.fill)

    def check(self, df: DataFrame) -> dict[str, object]:
        return profile.final_check(df, self.columns)

    def run(self, overwrite: bool = False) -> dict[str, str]:
        parts = {p: self.prepare(df) for p, df in self.load().items()}
        parts["train"] = self.prepare_train(parts["train"])
        self.fit(parts["train"])
        paths = {}
        for p, df in parts.items():
            paths[p] = f"{self.out_dir}/{self.name}_{p}.parquet"
            writers.write_table(self.transform(df), paths[p], overwrite)
        writers.write_json({"columns": self.columns, "fill": self.fill, "dropped": self.dropped, "checks": {p: self.check(self.spark.read.parquet(x)) for p, x in paths.items()}}, Path(self.out_dir.removeprefix("file://")) / f"{self.name}_process.json")
        return paths


class EsaProcessor(Processor):
    """One label, anomaly or rare event; training rows with it go."""

    def __init__(self, *args, rare_counts_as_positive: bool = True, **more):
        super().__init__(*args, **more)
        self.rare_counts_as_positive = rare_counts_as_positive

    def prepare(self, df: DataFrame) -> DataFrame:
        label = F.greatest("is_anomaly", "is_rare_event") if self.rare_counts_as_positive else F.col("is_anomaly")
        return df.withColumn("is_anomaly", label).drop("is_rare_event", *[c for c in df.columns if c.startswith("label_")])

    def prepare_train(self, df: DataFrame) -> DataFrame:
        return df.filter("is_anomaly = 0")
