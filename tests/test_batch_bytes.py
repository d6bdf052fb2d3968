"""Python workers get few bytes at once, whatever the session's limit."""

from pyspark.sql import functions as F

from lorekeep.operators import evalset, postings
from lorekeep.session import BATCH_BYTES, MOST_BATCH_BYTES


def test_index_is_grouped_by_few_bytes(spark):
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), (i % 50).cast("string"))), " ")
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc"), F.lit(20_000).cast("long").alias("dl"), many.alias("text"))
    found = postings.blocks(docs).where("term = 'w7'").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum(F.aggregate("postings", F.lit(0), lambda s, p: s + p["tf"])).alias("tf")).first()
    assert found["blocks"] >= 3 and (found["n"], found["tf"]) == (200, 200 * 400)  # some 30 MB in one partition


def test_contexts_are_sought_in_few_bytes(spark):
    bodies = spark.createDataFrame([(str(i), f"{i} and the words of this passage that is sought {i}") for i in range(300)], "id string, body string")
    contexts = spark.createDataFrame([(1, "and the  words of this passage that is sought 7"), (2, "8 and the words of this passage that is sought 8")], "context_id long, context string")
    found = evalset.match_contexts(contexts, bodies)
    limit = found.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    assert limit(found.sparkSession.conf.get(BATCH_BYTES)) <= MOST_BATCH_BYTES
    assert limit(spark.conf.get(BATCH_BYTES)) > MOST_BATCH_BYTES
    texts = {str(i): f"{i} and the words of this passage that is sought {i}" for i in range(300)}
    want = {1: ("normalized", "and the words of this passage that is sought 7"), 2: ("exact", "8 and the words of this passage that is sought 8")}
    rows = {r["context_id"]: (r["method"], r["ids"]) for r in found.collect()}
    assert rows == {c: (m, sorted(i for i, x in texts.items() if sought in x)) for c, (m, sought) in want.items()}
