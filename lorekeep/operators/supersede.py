"""Which entries are superseded by others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(entries: DataFrame) -> DataFrame:
    """entries -> src, dst, src_created: src supersedes dst."""
    return entries.select(F.col("id").alias("src"), F.explode("supersedes").alias("dst"), F.col("created_at").alias("src_created")).distinct()


def mutual_winners(entries: DataFrame) -> DataFrame:
    """id of entries that supersede each other with one that is not later; an entry may name itself."""
    e = edges(entries)
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("src_created").alias("dst_created"))
    return e.join(back, ["src", "dst"]).where("src_created >= dst_created").select(F.col("src").alias("id")).distinct()


def superseded_ids(entries: DataFrame) -> DataFrame:
    """id of all that any entry supersedes, but for the winners of mutual pairs; missing ids stay."""
    named = edges(entries).select(F.col("dst").alias("id")).distinct()
    return named.join(mutual_winners(entries), "id", "left_anti")


def visible(entries: DataFrame) -> DataFrame:
    """Entries that none supersedes, cycles not resolved."""
    return entries.join(edges(entries).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def dangling(entries: DataFrame) -> DataFrame:
    """Superseded ids that no entry has."""
    return edges(entries).select(F.col("dst").alias("id")).distinct().join(entries.select("id"), "id", "left_anti")


def missing_targets(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted(id) that known(id) has not."""
    return wanted.select("id").distinct().join(known.select("id"), "id", "left_anti")


def duplicate_ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
