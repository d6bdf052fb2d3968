"""Ids at the ends of a long's range beside missing ones, and sessions with settings of their own."""

import hashlib

import pytest
from pyspark.sql import functions as F

common = pytest.importorskip("lorekeep.llm.common")
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
TEXT = "one two three four five six seven eight nine ten"
ROWS = [(LEAST, TEXT), (None, TEXT), (0, TEXT), (MOST, "other words"), (None, None), (5, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, unnamed int").repartition(2)


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


WANT = sorted(str(i) for i, _ in ROWS)


def test_bpe_and_packing(docs):
    from lorekeep.llm import bpe, packing

    encoded = bpe.encode(docs, bpe.vocabulary_path(), decoded=True)
    assert ids(encoded) == WANT == ids(bpe.decode(encoded, bpe.vocabulary_path()))
    pieces = common.written(packing.token_pieces(docs, bpe.vocabulary_path()), "pieces")
    assert ids(pieces) == WANT == ids(packing.pack_pieces(pieces))


def test_language_model(docs):
    from lorekeep.llm import ppm

    assert ids(ppm.language_model_scores(docs, F.lit(True))) == WANT


def test_jaccard(docs):
    from lorekeep.llm import jaccard

    found = sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in jaccard.near_classes(docs).collect())
    assert found == sorted([(str(LEAST), str(LEAST), 6), ("None", "None", 6), ("0", str(LEAST), 6), (str(MOST), str(MOST), 1), ("None", "None", 0), ("5", "5", 0)])


def test_warc(spark, tmp_path):
    from lorekeep.llm import warc

    pages = spark.createDataFrame([(LEAST, "http://a.b/", "x" * 200), (5, "http://a.b/", "x" * 200), (MOST, "http://a.b/", "y" * 200), (-3, "http://a.b/", None)], "page_id long, url string, html string")
    warc.write_archives(pages.withColumn("at", F.lit(0)), f"file://{tmp_path}/a")
    rows = warc.capture_index(spark, f"file://{tmp_path}/a").collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in rows} == {LEAST: ("response", None), 5: ("revisit", LEAST), MOST: ("response", None), -3: ("response", None)}
    assert [r.page_id for r in rows] == [LEAST, -3, 5, MOST]
    assert rows[0].payload_digest == hashlib.sha256(b"x" * 200).hexdigest()


@pytest.mark.parametrize("limit", ["64m", "100000", "1g", "268435456b"])
def test_a_session_keeps_its_limit(spark, limit):
    from lorekeep.llm import registry

    was = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, limit)
    try:
        for name in ("op11_sum_of_squares", "op9_bpe_pair_index", "op10_quality_bradley_terry"):
            found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert found.count() > 0 and spark.conf.get(LIMIT) == limit
        inner = common.read(spark, "/root/testdata/sf0.001", "documents").sparkSession.conf.get(LIMIT)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(inner) == min(common.MOST_BATCH_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit))
    finally:
        spark.conf.set(LIMIT, was)


def test_programme_cut_short(monkeypatch):
    import numpy as np

    from lorekeep.llm import packing

    lengths = np.random.default_rng(1).integers(210, 600, 500)
    monkeypatch.setattr(packing, "STEPS", 0)
    sequence, offset = packing.pack(lengths)
    assert np.bincount(sequence, lengths).max() <= 1024 and (np.sort(offset[sequence == 0]) >= 0).all()
