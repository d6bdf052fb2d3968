import numpy as np
import pytest
from pyspark.sql import functions as F

quality = pytest.importorskip("lorekeep.llm.quality")
toxicity = pytest.importorskip("lorekeep.llm.toxicity")
SF = "/root/testdata/sf0.01"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "e", "s", 7.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score double")


def held_out(spark, query, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    return np.array([(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels])


def test_quality_held_out(spark):
    found = held_out(spark, quality.op10_quality_bradley_terry, "quality")
    assert (found[:, 0] == found[:, 1]).mean() > 0.97


def test_toxicity_held_out():
    """On the 2,600 labelled rows of sf0.1; the order of held-out documents, as so few rows settle no threshold."""
    import zlib

    import pandas as pd

    folder = SF.replace("0.01", "0.1")
    rows = pd.read_parquet(f"{folder}/documents.parquet").merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    model = toxicity.fit(map(toxicity.bag_of, rows.text[~out]), rows.toxic[~out].to_numpy())
    y = rows.toxic[out].to_numpy()
    score = np.array([model.score(t) for t in rows.text[out]])
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.85
    english = out & (rows.lang == "en").to_numpy() & (rows.toxic == 1).to_numpy()
    assert np.mean([model.score(t) >= toxicity.CUT for t in rows.text[english]]) > 0.8


def test_pairs_order_the_kinds():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (200, 3)), rng.normal(1, 1, (200, 3))]
    y = np.r_[np.zeros(200), np.ones(200)]
    model = quality.fit(x, y, pairs=20_000)
    s = model.strength(x)
    wins = (s[200:, None] > s[None, :200]).mean()
    assert wins > 0.85
    assert ((model.score(x) >= quality.CUT) == (s >= model.threshold)).all()
    assert quality.fit(x[:0], y[:0]).score(x[:1, :].repeat(13, 1)[:, :13])[0] == 0.5


def test_edge_texts(spark):
    texts = ["", None, " \n\t ", "word " * 30_000, "é" * 1000, "the same", "the same"]
    docs = rows_of(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, 1, 1), (3, None, None), (4, 5, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for scored, name in ((quality.quality(docs, labels), "quality_score"), (toxicity.toxicity(docs, labels), "toxic_score")):
            out = scored.collect()
            assert len(out) == len(texts) and set(docs.columns) < set(scored.columns)
            assert out[5][name] == out[6][name] and all(0 <= r[name] <= 1 for r in out)
    assert quality.quality(docs.limit(0), none).count() == 0 and toxicity.toxicity(docs.limit(0), none).count() == 0
    assert len(quality.features(None)) == len(quality.FEATURES) == len(quality.features("A a."))


def test_unseen_misspelling():
    clean = [f"calm words number {i} about rivers and trees" for i in range(60)]
    bad = [f"you total blockhead number {i} about rivers" for i in range(60)]
    model = toxicity.fit(map(toxicity.bag_of, clean + bad), np.r_[np.zeros(60), np.ones(60)])
    assert model.score("you total blockheadd about rivers") > 0.7 > model.score("calm words about trees")
    assert model.score(None) == model.score("")


def test_named_scores_and_repeated_ids(spark):
    """A column that has the score's usual name stays under another; ids that repeat are learned from once."""
    docs = [(i % 40, f"{'Calm words about rivers' if i % 2 else 'YOU BAD BAD !!! $$$ thing'} {i}") for i in range(400)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, quality_score int").withColumn("toxic_score", F.lit("own"))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(quality.quality(df, labels, "good"), labels, "bad").collect()
    assert len(out) == 400 and all(r["quality_score"] == 7 and r["toxic_score"] == "own" and 0 <= r["good"] <= 1 and 0 <= r["bad"] <= 1 for r in out)


def test_nothing_learned_scores_zero(spark):
    docs = rows_of(spark, ["some text", "", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic_score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0, 0.0]
    assert [r["quality_score"] for r in quality.quality(docs, none).collect()] == [0.5, 0.5, 0.5]


def test_long_texts_are_learned_from(spark):
    """The only toxic documents are long; their words still get a score."""
    filler = "calm rivers and trees " * 5_000
    docs = [(i, filler + "blockhead fool " * 30_000 if i % 2 else filler) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.score("blockhead fool") > 0.7 > model.score("calm rivers")


def test_ranking_against_gradient_descent():
    """Newton's weights are those of plain gradient descent on the same pairs."""
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (60, 3)), rng.normal(0.7, 1, (60, 3))]
    y = np.r_[np.zeros(60), np.ones(60)]
    model = quality.fit(x, y, pairs=4_000, ridge=1e-2, seed=3)
    draw = np.random.default_rng(3)
    z = model.standard(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[draw.choice(good, 4_000)] - z[draw.choice(bad, 4_000)]
    w = np.zeros(3)
    for _ in range(4_000):
        p = 1 / (1 + np.exp(d @ w))
        w += 0.3 * ((p @ d) / len(d) - 1e-2 * w)
    assert np.allclose(w, model.weights, atol=1e-4)


def test_bag_gradient():
    """The trained bag beats chance by its loss; averaging before the linear layer equals averaging numbers after it."""
    texts = ["good calm day", "calm calm trees", "bad fool", "fool fool bad day"] * 10
    y = np.array([0, 0, 1, 1] * 10)
    model = toxicity.fit(map(toxicity.bag_of, texts), y)
    s = np.array([model.score(t) for t in texts])
    assert -np.mean(np.log(np.where(y == 1, s, 1 - s))) < 0.2
    found = toxicity.tokens(texts[3])
    assert np.isclose(model.logit(texts[3]), np.mean([model.value[toxicity.subwords(w)].mean() for w in found]) + model.bias)
