import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from lorekeep.llm.jaccard import near_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 1), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_002, "", "de", "t", 0)], docs.schema)
    now = docs.unionByName(odd)
    want = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, SF)
        assert now.columns == want, name
        assert 0 < now.count() < before.count()
        assert now.exceptAll(before).count() == 0
        now = spark.createDataFrame(now.collect(), docs.schema)
    left = near_classes(now.where("doc_id is not null"))
    assert left.where("doc_id <> component_id").count() == 0
    packed = pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.where("piece = 0").count() == now.count()


def test_run_and_empty(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
