"""Each stage of the pipeline against a brute-force version of it, and run() against all of them in a row."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_of_classes(docs):
    """Rows (id, text) -> the ids that stay, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(range(len(sets)), key=lambda k: sets[k][0])
    for a, x in enumerate(order):
        for y in order[:a]:
            p, q = sets[x][1], sets[y][1]
            if p and q and 100 * len(p & q) >= 80 * len(p | q):
                u, v = sorted((root(x), root(y)), key=lambda k: sets[k][0])
                label[v] = u
    return {sets[k][0] for k in range(len(sets)) if root(k) == k}


def test_run(spark):
    from lorekeep.llm import quality, toxicity
    from tokenizers import Tokenizer
    from lorekeep.llm.bpe import vocabulary_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ranking = quality.train(docs, labels)
    import numpy as np

    rows = [(i, t) for i, t in rows if ranking.score(np.array([quality.features(t)]))[0] >= quality.CUT]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    bag = toxicity.train(left, labels)
    rows = [(i, t) for i, t in rows if bag.score(t) < toxicity.CUT]
    stay = least_of_classes(rows)
    rows = [(i, t) for i, t in rows if i in stay]
    library = Tokenizer.from_file(vocabulary_path())
    want = {}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        lengths = ([n % 1024] if n % 1024 else []) + [1024] * (n // 1024)
        want.update({(i, k): length for k, length in enumerate(lengths)})
    out = pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["length"] for r in out} == want and len(out) == len(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 1024


def test_extra_columns_of_any_type(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 0.5), (1, text, 0.7), (2, text + " more", 0.1), (3, None, 0.2), (None, text, 0.3), (4, "", 0.4), (5, " ", 0.4)], "doc_id long, text string, quality_score double")
    docs = docs.withColumn("extra", F.create_map(F.lit("a"), F.col("quality_score"))).withColumns({"toxic_score": F.lit("x"), "row_id": F.lit(1), "digest": F.lit("d")})
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((str(r["doc_id"]) for r in rows)) == sorted(["1", "3", "None", "4", "5"])
    assert all(r["extra"] == {"a": r["quality_score"]} for r in rows)
    for stage in (pipeline.quality_filter, pipeline.toxicity_filter):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and all(r["toxic_score"] == "x" for r in kept.collect())
