"""Near-duplicates of new content among chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.vectors import cosine


def similar(vectors: DataFrame, query: Column, threshold: float) -> DataFrame:
    """vectors(chunk_id, entry_id, embedding) with ``sim`` at or above the threshold."""
    return vectors.withColumn("sim", cosine(F.col("embedding"), query)).where(F.round("sim", 9) >= threshold)


def best_match(vectors: DataFrame, query: Column, threshold: float) -> DataFrame:
    """At most one row: the nearest chunk; of equal ones that with the smaller id."""
    return similar(vectors, query, threshold).orderBy(F.round("sim", 9).desc(), "chunk_id").limit(1)
