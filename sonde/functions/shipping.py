"""Python functions over Arrow batches that executors can load from any folder."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Rows that may be whole documents go to Python in batches of this many, unless the application says otherwise.
BATCH_ROWS, _BATCH_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="package-")
    target = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, a long that they are sorted by; one value's rows are held at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            if held and held[0].column(0)[0].as_py() != keys[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Hands memory that is no longer used back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
