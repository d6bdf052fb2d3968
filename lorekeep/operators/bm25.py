"""Keyword index tables and BM25 ranking. The index is three tables (postings, lengths, statistics)
that queries filter by term, so a scan of postings reads the terms asked for and little else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import search_terms

K1, B = 1.2, 0.75


def postings(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, text) -> chunk_id, term, tf."""
    return chunks.select("chunk_id", F.explode(search_terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(search_terms(F.col("text"))).cast("long").alias("dl"))


def statistics(lengths_: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths_.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def score(postings_: DataFrame, lengths_: DataFrame, terms: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id, bm25 of the chunks that have any of the terms.

    allowed(chunk_id): only these are returned; the statistics stay those of the whole index.
    """
    hits = postings_.where(F.col("term").isin(*set(terms)) if terms else F.lit(False))
    if allowed is not None:
        asked = hits.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    else:
        asked = hits
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per term asked
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        asked.join(F.broadcast(df), "term").join(lengths_, "chunk_id").crossJoin(F.broadcast(statistics(lengths_)))
        .groupBy("chunk_id").agg(F.sum(idf * tf).alias("bm25"))
    )


def without_entries(table: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """Index rows but those of entry_ids(entry_id)."""
    return table.join(entry_ids.select("entry_id"), "entry_id", "left_anti")
