import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_ids_with_several_texts(spark):
    docs = [(5, text("a")), (5, text("b")), (5, text("b")), (5, text("c")), (9, text("b") + " more"), (3, text("c") + " more"), (None, text("a")), (7, text("d")), (6, text("d"))]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    found = pipeline.near_duplicates(spark, df, SF)
    assert found.columns == df.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    assert rows == sorted([(5, text("a")), (5, text("b")), (3, text("c") + " more"), (None, text("a")), (6, text("d"))], key=str)
