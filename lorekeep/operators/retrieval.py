"""Ranking, fusion and cut-offs of search results.

Scores are ordered after rounding to nine digits, ties by id, so results do not depend on the order
of a floating-point sum. Ranks come from top-k plans (no global sort exchange)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.text import estimated_tokens, word_count

DIGITS = 9
HIGH, MEDIUM, HIGH_COUNT = 0.5, 0.2, 3
#: What a search says about its result.
COLD = "the index is empty: run ingest"
BELOW_MINIMUM = "every match scored below min_score"
STALE = "entries have changed since they were indexed"
UNSURE = "only weak matches were found"


def by_score(score: str) -> list[Column]:
    return [F.round(F.col(score), DIGITS).desc()]


def top_k(df: DataFrame, score: str, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best with ``rn`` from 1."""
    best = df.orderBy(*by_score(score), key).limit(k)
    return best.withColumn("rn", F.row_number().over(Window.orderBy(*by_score(score), key)))


def oversampled(limit: int, has_kind: bool, candidates: int) -> int:
    return max(limit * 3 if has_kind else limit, candidates)


def fuse(lists: list[DataFrame], k: int = 30) -> DataFrame:
    """Ranked lists (chunk_id, rn) -> chunk_id, rrf."""
    every = lists[0].select("chunk_id", "rn")
    for more in lists[1:]:
        every = every.unionByName(more.select("chunk_id", "rn"))
    return every.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rn"))).alias("rrf"))


def best_per_entry(df: DataFrame, score: str = "score") -> DataFrame:
    """The best chunk of each entry; of equal ones that with the smaller rank ``rn``."""
    w = Window.partitionBy("entry_id").orderBy(F.round(score, DIGITS).desc(), "rn")
    return df.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def within_budget(df: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Rows in order of ``rn`` until the estimated tokens pass the budget; the first stays anyway."""
    total = F.sum(estimated_tokens(word_count(F.col(text)))).over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.orderBy("rn"))
    return df.withColumn("tokens_so_far", total).withColumn("place", first).where((F.col("place") == 1) | (F.col("tokens_so_far") <= budget)).drop("place")


def confidence(top: Column, count: Column) -> Column:
    return (
        F.when((count >= HIGH_COUNT) & (top >= HIGH), "high")
        .when((count > 0) & (top >= MEDIUM), "medium").when(count > 0, "low").otherwise("none")
    )


def suggestion(n: Column, sure: Column, stale: Column | None = None, below: Column | None = None, cold: Column | None = None) -> Column:
    """What to say of n results with such a confidence; null: nothing. below: whether a minimum score took all."""
    no = F.lit(False)
    return (
        F.when(no if cold is None else cold, COLD).when((n == 0) & (no if below is None else below), BELOW_MINIMUM)
        .when(no if stale is None else stale, STALE).when(sure == "low", UNSURE)
    )


def quality(results: DataFrame, score: str = "score", stale: bool = False, before_minimum: int = 0, cold: bool = False) -> DataFrame:
    """One row: n, confidence, suggestion. before_minimum: rows that a minimum score was applied to."""
    said = results.agg(F.max(score).alias("top"), F.count("*").alias("n")).withColumn("confidence", confidence(F.col("top"), F.col("n")))
    what = suggestion(F.col("n"), F.col("confidence"), F.lit(stale), F.lit(before_minimum > 0), F.lit(cold))
    return said.select("n", "confidence", what.alias("suggestion"))
