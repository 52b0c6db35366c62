"""Tables written between steps, in the folder that all executors share.

A step that is read more than once, or that ends a round of a loop, is written as Parquet
below ``spark.checkpoint.dir``: lineage ends there and a lost executor loses nothing. Only a
session on one machine may lack that setting; it gets a temporary folder, removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []
atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _LOCAL])


def root(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sonde-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{root(spark)}/sonde/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


class Steps:
    """Removes what a step wrote for itself, once the next one begins with other files.

    Steps run one after another, each on what the one before returned and was written
    elsewhere. A step's folders stay as long as the next one's input reads any of them.
    """

    def __init__(self):
        self.made: list[str] = []

    def run(self, step, spark: SparkSession, rows: DataFrame, *more) -> DataFrame:
        read = rows.inputFiles() if self.made else []
        kept = []
        for path in self.made:
            if any(path.removeprefix("file://") in name for name in read):
                kept.append(path)
            else:
                remove(spark, path)
        before = len(_MADE)
        try:
            return step(spark, rows, *more)
        finally:
            self.made = kept + _MADE[before:]


#: Bytes of a row group whose rows are long arrays: readers hold 4096 rows at once, but of one group.
LONG_ROWS = 8 << 20


def save(df: DataFrame, tag: str, *by: str, group: int | None = None) -> DataFrame:
    """Writes df to a new folder, in folders by the columns `by` and row groups of `group` bytes, and returns what reads it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.partitionBy(*by).options(**{"parquet.block.size": group} if group else {}).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(saved: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    remove(saved.sparkSession, saved._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def by_uid(rows: DataFrame) -> DataFrame:
    """rows in files by the column `uid`, so that later joins on it deal only the other side out."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "rows")
    name = f"sonde_rows_{uuid.uuid4().hex}"
    rows.repartition(parts, "uid").write.bucketBy(parts, "uid").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalogue; the files stay
    return out
