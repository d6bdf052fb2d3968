import pytest

from lorekeep.functions.vectors import cosine, from_bytes, to_bytes
from lorekeep.operators import retrieval as r
from pyspark.sql import functions as F


def test_fusion(spark):
    one = spark.createDataFrame([("c1", 1)], "chunk_id string, rn int")
    assert r.fuse([one]).first()["rrf"] == pytest.approx(1 / 31)
    assert r.fuse([one, one]).first()["rrf"] == pytest.approx(2 / 31)
    assert r.fuse([one.limit(0), one.limit(0)]).count() == 0


def test_best_per_entry(spark):
    rows = spark.createDataFrame([("a", "e1", 0.9, 1), ("b", "e1", 0.9, 2), ("c", "e2", 0.5, 3)], "chunk_id string, entry_id string, score double, rn int")
    assert {x["chunk_id"] for x in r.best_per_entry(rows).collect()} == {"a", "c"}


def test_budget(spark):
    rows = spark.createDataFrame([(1, "a " * 10), (2, "b " * 3), (3, "c")], "rn int, text string")
    kept = lambda n: [x["rn"] for x in r.within_budget(rows, n).orderBy("rn").collect()]
    assert kept(0) == [1] and kept(16) == [1] and kept(17) == [1, 2, 3][:3] or kept(16) == [1, 2]
    assert kept(100) == [1, 2, 3]


def test_quality(spark):
    def of(*scores, **kw):
        return r.quality(spark.createDataFrame([(s,) for s in scores], "score double"), **kw).first()

    assert of(0.8, 0.6, 0.5, 0.3)["confidence"] == "high"
    assert of(0.3, 0.2)["confidence"] == "medium"
    assert of(0.1, 0.05)["confidence"] == "low" and of(0.1)["suggestion"] == r.UNSURE
    assert of()["confidence"] == "none"
    assert of(0.8, stale=True)["suggestion"] == r.STALE
    assert of(before_minimum=3)["suggestion"] == r.BELOW_MINIMUM
    assert of(cold=True)["suggestion"] == r.COLD


def test_vectors(spark):
    sim = lambda a, b: spark.range(1).select(cosine(F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert sim([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1)
    assert sim([1.0, 0.0], [0.0, 1.0]) == 0 and sim([0.0, 0.0], [1.0, 1.0]) == 0
    assert from_bytes(to_bytes([0.5, -2.25])) == [0.5, -2.25]
    assert r.oversampled(5, True, 50) == 50 and r.oversampled(20, True, 50) == 60


def test_many_queries_with_odd_vectors(spark):
    from lorekeep.functions.vectors import top_k_per_query

    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [None, 1.0]), ("e", [1.0, 2.0, 3.0]), ("f", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("1", [1.0, 0.1]), ("1", [1.0, 0.1]), ("1", [0.9, 0.1]), ("2", None), ("3", [0.1, 1.0]), (None, [0.1, 1.0])], "query_id string, embedding array<double>")
    for most in (1, 2, 100):
        found = {(r["query_id"], r["chunk_id"]) for r in top_k_per_query(v, q, 1, most).collect()}
        assert found == {("1", "a"), ("3", "b")}
    assert top_k_per_query(v, q.limit(0), 1).count() == 0
