"""What the corpus operators share: session settings, written intermediate tables, words."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight import session

#: White space as every operator here means it: space, tab, line feed to carriage return.
SPACE = r"[\x20\x09-\x0D]"

# Texts may be very long: Arrow batches are bounded by rows and by bytes.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def _ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application; they may not have it installed.

    Spark serves the archive from the driver, so its folder stays until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(session.__file__).parent
    folder = _SHIPPED[context.applicationId] = tempfile.TemporaryDirectory()
    archive = Path(folder.name).resolve() / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on and ship the package; safe on a live session."""
    session.tune(spark)
    _ship(spark)
    for key, value in ARROW.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The lineage ends at the files, so a lost executor re-reads them, and later
    jobs do not repeat the work.
    """
    path = session.run_dir(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    """Partitions to deal work out to when its size is not known."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def gather(first: np.ndarray, length: np.ndarray, data: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``data[first[i]:first[i] + length[i]]`` for each i of ``index``, joined; and where each one ends."""
    if not len(index):
        return data[:0], np.zeros(0, np.int64)
    n = length[index]
    ends = np.cumsum(n)
    return data[np.repeat(first[index] - (ends - n), n) + np.arange(ends[-1])], ends
