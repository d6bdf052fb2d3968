"""A corpus pipeline: quality filter, toxicity filter, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.bpe import vocabulary_path
from lorekeep.llm.common import read, written
from lorekeep.llm.jaccard import near_classes
from lorekeep.llm.packing import pack_pieces, token_pieces
from lorekeep.llm.quality import CUT as GOOD
from lorekeep.llm.quality import quality
from lorekeep.llm.toxicity import CUT as TOXIC
from lorekeep.llm.toxicity import toxicity


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like any other; repeated and tied rows are decided alike; an empty table stays empty;
    all columns of docs, and no others, are returned.
    """
    score = unused(docs, "quality_score")
    return quality(docs, read(spark, sf_dir, "labels"), score).where(F.col(score) >= GOOD).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic.

    Null and empty texts are scored like any other; repeated and tied rows are decided alike; an empty table stays empty;
    all columns of docs, and no others, are returned.
    """
    score = unused(docs, "toxic_score")
    return toxicity(docs, read(spark, sf_dir, "labels"), score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id (of its texts that with the least digest).

    Rows that share an id but not the text are documents of their own; of rows that share both, one stays, whatever their other
    columns hold (of any type). Null and blank texts are near to nothing. Rows without an id stay. An empty table stays empty.
    """
    row, digest = unused(docs, "row_id"), unused(docs, "digest")
    docs_ = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = written(docs_.where("doc_id is not null").groupBy("doc_id", F.col(digest).alias("digest")).agg(F.count("*").alias("times")), "keys")
    # the least text of an id keeps the id, the others are named by hashes
    several = keys.groupBy("doc_id").agg(F.min("digest").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("doc_id", "least")
    other = keys.join(written(several, "several", let_go=False), "doc_id").where("digest <> least").select("doc_id", "digest")
    other = written(other.withColumn("its_row", F.xxhash64("doc_id", "digest")), "other", let_go=False)
    named = other.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), "its_row")
    known = docs_.join(named, (F.col("doc_id") == F.col("its_id")) & (F.col(digest) == F.col("its_digest")), "left")
    known = known.withColumn(row, F.coalesce("its_row", "doc_id")).drop("its_id", "its_digest", "its_row")
    classes = near_classes(known.where("doc_id is not null").select(F.col(row).alias("doc_id"), "text")).distinct()
    classes = classes.select(F.col("doc_id").alias("its_row"), F.col("component_id").alias("class")).join(other, "its_row", "left")
    classes = written(classes.withColumn("order", F.struct(F.coalesce("doc_id", "its_row").alias("id"), F.coalesce("digest", F.lit("")).alias("digest"))), "classes")
    first = classes.groupBy("class").agg(F.min_by("its_row", "order").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = written(classes.join(first, "class").where("its_row <> first").select("its_row"), "gone", let_go=False)
    # rows that share id and text: their texts alone are shuffled
    twice = written(keys.where("times > 1").join(named, (F.col("doc_id") == F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left").select(F.coalesce("its_row", "doc_id").alias("its_row")), "twice", let_go=False)
    same_row = F.col(row) == F.col("its_row")
    kept = known.join(gone, same_row, "left_anti")
    # rows without an id are in no class of others: null equals nothing, so they stay
    once = kept.join(twice, same_row, "left_anti").unionByName(kept.join(twice, same_row, "left_semi").dropDuplicates([row]))
    return once.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents are packed into, by piece.

    A null text is an empty one; rows that repeat are packed each; an empty table gives no rows.
    """
    return pack_pieces(written(token_pieces(docs, vocabulary_path()), "pieces"))


STAGES = [("quality", quality_filter), ("toxicity", toxicity_filter), ("near duplicates", near_duplicates), ("packing", packing)]

#: The classifiers can't be written in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
