"""Gives executors the package."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes that go to a Python worker at once; a session that sets fewer keeps its own.
BATCH_BYTES, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Local mode, one machine, can do with a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lorekeep-")


def in_copy(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A copy of the session with other settings."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in settings.items():
        own.conf.set(name, value)
    return own


def in_small_batches(df: DataFrame) -> DataFrame:
    """df in a copy of its session where a Python worker gets few bytes at once; the session itself is left as it is."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) <= MOST_BATCH_BYTES:
        return df
    own = in_copy(spark, {BATCH_BYTES: str(MOST_BATCH_BYTES)})
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's Python files, once: executors may not have it installed."""
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="lorekeep-")) / "lorekeep.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "lorekeep").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
