"""Incremental ingest as a stream: new entry files become chunk rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.chunker import chunk_entries
from lorekeep.schema import Chunking
from lorekeep.sources.entries import parse_entries


def entry_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Parsed entries of the files that arrive in a folder, with ``error`` for unreadable ones."""
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(name.alias("file"), F.col("content").cast("string").alias("content")).where(~F.col("file").startswith("."))
    return parse_entries(named)


def ingest_stream(spark: SparkSession, folder: str, out: str, rule: Chunking = Chunking(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """Writes chunks of arriving entries to Parquet under out; a checkpoint there makes it exactly once."""
    chunks = chunk_entries(entry_stream(spark, folder).where("error is null"), rule).where("text <> ''")
    writer = chunks.writeStream.format("parquet").option("path", f"{out}/chunks").option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def span_rates(spans: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """spans(ts, name, elapsed_ms) -> per window and name: count, mean and longest time; later rows than ``late`` are dropped."""
    return (
        spans.withWatermark("ts", late).groupBy(F.window("ts", window), "name")
        .agg(F.count("*").alias("n"), F.avg("elapsed_ms").alias("mean_ms"), F.max("elapsed_ms").alias("max_ms"))
    )
