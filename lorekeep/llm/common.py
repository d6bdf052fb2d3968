"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import MOST_BATCH_BYTES, in_small_batches, ship  # noqa: F401  operators import them from here


def whole_id(column: str, name: str = "doc_id") -> list[Column]:
    """An id as two columns without nulls, since pandas would turn integers beside nulls into floats: 0 for null, and whether it is null."""
    return [F.coalesce(F.col(column), F.lit(0)).cast("long").alias(name), F.col(column).isNull().alias("unnamed")]


def restored(name: str = "doc_id") -> Column:
    return F.when(~F.col("unnamed"), F.col(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return in_small_batches(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text whose letters A-Z are made lower case, in UTF-8."""
    return raw_text(text).split()  # bytes know no other white space, and no other letters


def raw_text(text: str | None, lower: bool = True) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


_remembered: dict[str, Callable[[], object]] = {}


def working(operator: str, forget: Callable[[], object] | None = None) -> None:
    """Called in a worker, which may serve one operator after another: what others remembered there is dropped.

    forget: drops what this one remembers, once another one works.
    """
    others = [o for o in _remembered if o != operator]
    for other in others:
        _remembered.pop(other)()
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where there is a C library that can, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
    if forget:
        _remembered[operator] = forget


class WordHashes:
    """64-bit hashes of words; a worker remembers those of ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, found: list[bytes]) -> list[int]:
        ids = list(map(self.known.get, found))
        if None in ids:
            if len(self.known) > self.most:
                self.known.clear()
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self.known[found[i]] = xxhash.xxh3_64_intdigest(found[i])
        return ids


def packed(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpacked(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """An ascending array of 64-bit integers by its differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def fold(column: str, n: int) -> Column:
    """crc32 of the decimal form of an id, modulo n."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where a session has none, a temporary folder is set in local mode (tests), where there is one machine; a cluster needs a
    folder that all of it shares.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, let_go: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors.

    let_go: afterwards the shuffle files of what led to it are dropped.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    if let_go:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table that is no longer needed."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Spark's cleaner drops shuffle files once nothing refers to them; ask for that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
