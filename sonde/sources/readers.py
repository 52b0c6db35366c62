"""Readers of raw telemetry, annotations and splits, as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonde.functions.contracts import TIME
from sonde.functions.ordered import number_rows
from sonde.operators.cleaning import clean_label, identical_schemas, only_values, to_numbers

SWAT_TIME, SWAT_LABEL, SWAT_FORMAT = "Timestamp", "Normal/Attack", "d/M/yyyy h:mm:ss a"
SWAT_LABELS = ["Normal", "Attack"]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns, with blanks around its names removed."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.strip() for c in df.columns])


def read_labelled_csv(spark: SparkSession, path: str, time: str = SWAT_TIME, label: str = SWAT_LABEL, pattern: str = SWAT_FORMAT) -> DataFrame:
    """datetime, float instruments and is_attack, from a file with padded names and values."""
    df = read_csv(spark, path)
    cleaned = only_values(df.withColumn(label, clean_label(F.col(label))), label, SWAT_LABELS)
    instruments = [c for c in df.columns if c not in (time, label)]
    numbers = to_numbers(cleaned, instruments)
    return numbers.select(F.try_to_timestamp(F.trim(time), F.lit(pattern)).cast("timestamp_ntz").alias(TIME), *instruments, (F.col(label) == SWAT_LABELS[1]).cast("byte").alias("is_attack"))


def read_with_lines(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with `_line`, the number of each record in the file.

    Records are numbered within the pieces a file is read in; pieces are counted in order.
    """
    df = spark.read.csv(path, header=True)
    names = [c.strip() for c in df.columns]
    placed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq"))
    counts = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"))  # a row for each piece
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_seq"))
    return placed.join(F.broadcast(before), ["_file", "_start"]).withColumn("_line", (F.col("_before") + within - 1).cast("long")).drop("_file", "_start", "_seq", "_before")


def read_recordings(spark: SparkSession, paths: list[str], time: str = "timestamp") -> DataFrame:
    """datetime and float columns of files that must have the same columns in the same order."""
    frames = {p: read_csv(spark, p) for p in paths}
    identical_schemas(frames)
    out = None
    for df in frames.values():
        tags = [c for c in df.columns if c != time]
        part = to_numbers(df, tags).select(F.expr(f"try_cast(trim(`{time}`) AS timestamp_ntz)").alias(TIME), *tags)
        out = part if out is None else out.unionByName(part)
    return out


def with_side_labels(spark: SparkSession, values_path: str, labels_path: str, label: str = "label", name: str = "is_attack", time: str = "timestamp") -> DataFrame:
    """A recording whose labels stand in a second file, line by line."""
    values, labels = read_with_lines(spark, values_path), read_with_lines(spark, labels_path)
    if values.count() != labels.count():
        raise ValueError("the label file has another number of rows")
    tags = [c for c in values.columns if c not in (time, "_line")]
    side = labels.select("_line", F.expr(f"try_cast(trim(`{label}`) AS int)").cast("byte").alias(name))
    return to_numbers(values, tags).join(side, "_line").select(F.expr(f"try_cast(trim(`{time}`) AS timestamp_ntz)").alias(TIME), *tags, name)


def read_channels(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(channel, ts, value) of irregular series in Parquet or CSV; wanted: channels to keep."""
    df = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.csv(path, header=True, schema="channel string, ts timestamp_ntz, value string")
    return df if wanted is None else df.join(wanted.select("channel").distinct(), "channel", "left_semi")


def missing_channels(readings: DataFrame, wanted: DataFrame) -> list[str]:
    return [r[0] for r in wanted.select("channel").distinct().join(readings.select("channel").distinct(), "channel", "left_anti").orderBy("channel").collect()]


def read_annotations(spark: SparkSession, labels_path: str, types_path: str) -> DataFrame:
    """(ID, Channel, StartTime, EndTime, Category); times lose their zone."""
    stamp = lambda c: F.to_timestamp(c).cast("timestamp_ntz").alias(c)
    labels = read_csv(spark, labels_path).select("ID", "Channel", stamp("StartTime"), stamp("EndTime"))
    return labels.join(read_csv(spark, types_path).select("ID", "Category"), "ID", "left")


def target_channels(spark: SparkSession, path: str, target_only: bool = False) -> DataFrame:
    df = read_csv(spark, path)
    rows = df.filter(F.col("Target") == "YES") if target_only else df
    return rows.withColumn("channel", F.col("Channel"))


def read_copy_block(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The tab-separated rows of one table's COPY block in a database dump, as text columns."""
    lines = number_rows(spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id()), ["_seq"], "_line")
    opens = F.col("value").rlike(rf"^COPY (\w+\.)?{table} \(")
    head = lines.filter(opens).orderBy("_line").first()
    if head is None:
        raise ValueError(f"no COPY block of {table}")
    columns = [c.strip().strip('"') for c in head["value"].split("(", 1)[1].split(")", 1)[0].split(",")]
    end = lines.filter((F.col("_line") > head["_line"]) & (F.col("value") == "\\.")).agg(F.min("_line")).first()[0]
    cells = F.split("value", "\t")
    rows = lines.filter((F.col("_line") > head["_line"]) & (F.col("_line") < (end if end is not None else 1 << 62)))
    return rows.select(*[F.when(cells[k] != "\\N", cells[k]).alias(c) for k, c in enumerate(columns)])


def _listed(folder: str, pattern: str) -> list[str]:
    """Paths in a folder that match a pattern, wherever Spark can read the folder."""
    spark = SparkSession.getActiveSession()
    if spark is None or "://" not in folder:
        return sorted(str(p) for p in Path(folder).glob(pattern))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(f.getPath().toString() for f in found or ())


def discover(folder: str | Path) -> tuple[str, dict[str, str]]:
    """The dataset's name and the files of its parts, from <name>_<part>.parquet."""
    files, stems = {}, set()
    for part in ("train", "validation", "test"):
        found = _listed(str(folder), f"*_{part}.parquet")
        if len(found) != 1:
            raise ValueError(f"{folder} has {len(found)} files for {part}")
        files[part] = found[0]
        stems.add(found[0].rstrip("/").rsplit("/", 1)[-1].removesuffix(f"_{part}.parquet"))
    if len(stems) != 1:
        raise ValueError(f"the parts belong to several datasets: {sorted(stems)}")
    return stems.pop(), files
