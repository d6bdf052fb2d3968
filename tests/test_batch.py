"""Batches of writes against writing one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators.batch import resolve

WRITE = "seq long, id string, supersedes array<string>, embedding array<double>"
CHUNK = "seq long, chunk_id string, entry_id string, embedding array<double>"


def one_by_one(writes, chunks, live, threshold):
    """writes: (seq, id, supersedes, vector); chunks and live: (chunk_id, entry_id, vector)."""
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    of = {}
    for c, e, v in chunks:
        of.setdefault(e, []).append((c, e, unit(v)))
    known = [(c, e, unit(v)) for c, e, v in live]
    there, dead, out = {e for _, e, _ in live}, set(), {}
    for seq, name, targets, v in sorted(writes, key=lambda w: w[0]):
        targets, sim = list(targets or []), None
        if not targets and v is not None and known:
            near = np.round(np.array([k[2] for k in known]) @ unit(v), 9)
            best = min(((-s, c, e) for s, (c, e, _) in zip(near, known) if s >= threshold and e not in dead), default=None)
            if best:
                targets, sim = [best[2]], -best[0]
        dead |= {t for t in targets if t in there}
        known += of.get(name, [])
        there.add(name)
        out[seq] = (name, targets, sim)
    return out


def check(spark, folder, writes, chunks, live, threshold=0.85, **more):
    at = {w[1]: w[0] for w in writes}
    w = spark.createDataFrame(writes, WRITE)
    c = spark.createDataFrame([(at[e], c, e, v) for c, e, v in chunks], CHUNK)
    v = spark.createDataFrame(live, "chunk_id string, entry_id string, embedding array<double>")
    rows = resolve(w, c, v, threshold, str(folder), **more).collect()
    found = {r["seq"]: (r["id"], r["supersedes"], r["similarity"]) for r in rows}
    assert len(rows) == len(writes)
    want = one_by_one(writes, chunks, live, threshold)
    assert {k: x[:2] for k, x in found.items()} == {k: x[:2] for k, x in want.items()}
    for k, (_, _, sim) in want.items():
        assert sim == (pytest.approx(found[k][2], abs=2e-9) if sim is not None else found[k][2])
    return want


@pytest.mark.parametrize("seed,block,depth", [(0, 16, 3), (1, 25, 2), (2, 64, 32)])
def test_equals_writing_one_by_one(spark, tmp_path, seed, block, depth):
    """Dense groups, several chunks an entry, targets in the index, the batch, later in it and nowhere; lists that run out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    vector = lambda: (centres[rng.integers(6)] + rng.choice([0, 0.2, 0.5]) * rng.normal(size=8)).tolist()
    live = [(f"i{e:03}:{c}", f"i{e:03}", vector()) for e in range(25) for c in range(rng.integers(1, 3))]
    writes, chunks = [], []
    for n in range(60):
        name = f"w{n:03}"
        targets = [] if rng.random() < 0.85 else [str(rng.choice([f"i{rng.integers(25):03}", f"w{rng.integers(60):03}", "ghost"]))]
        v = vector()
        writes.append((n * 3, name, targets, v))
        chunks += [(f"{name}:{c}", name, v if c == 0 else vector()) for c in range(rng.integers(1, 4))]
    want = check(spark, tmp_path, writes, chunks, live, block=block, depth=depth)
    assert sum(s is not None for _, _, s in want.values()) > 25


def test_copies_and_odd_rows(spark, tmp_path):
    """Copies queue up behind each other; no vector, a zero vector, an odd length, null targets, entries without a chunk."""
    same, other = [1.0, 2.0], [2.0, -1.0]
    live = [(f"i{n}:0", f"i{n}", same) for n in range(5)] + [("n:0", "n", None), ("o:0", "o", [1.0])]
    writes = [(n, f"w{n:02}", None if n % 2 else [], same) for n in range(20)]
    writes += [(30, "x", [], None), (31, "y", [], [0.0, 0.0]), (32, "z", [], other), (33, "z2", [], other)]
    chunks = [(f"{w[1]}:0", w[1], w[3]) for w in writes if w[3] is not None]
    w = spark.createDataFrame(writes, WRITE)
    c = spark.createDataFrame([(x[0], f"{x[1]}:0", x[1], x[3]) for x in writes if x[3] is not None], CHUNK)
    v = spark.createDataFrame(live, "chunk_id string, entry_id string, embedding array<double>")
    found = {r["seq"]: r["supersedes"] for r in resolve(w, c, v, 0.85, str(tmp_path), block=8, depth=2).collect()}
    want = one_by_one(writes, chunks, live[:5], 0.85)
    assert found == {k: x[1] for k, x in want.items()}
    assert found[5] == ["w00"] and found[30] == [] and found[31] == [] and found[33] == ["z"]


def test_nothing_to_do(spark, tmp_path):
    none = spark.createDataFrame([], WRITE), spark.createDataFrame([], CHUNK), spark.createDataFrame([], "chunk_id string, entry_id string, embedding array<double>")
    assert resolve(*none, 0.85, str(tmp_path / "a")).count() == 0
    w = spark.createDataFrame([(1, "a", [], [1.0]), (2, "b", [], [1.0]), (3, "c", ["a"], None)], WRITE)
    c = spark.createDataFrame([(1, "a:0", "a", [1.0]), (2, "b:0", "b", [1.0])], CHUNK)
    assert sorted((r["id"], r["supersedes"]) for r in resolve(w, c, none[2], 0.85, str(tmp_path / "b")).collect()) == [("a", []), ("b", ["a"]), ("c", ["a"])]
    w = spark.createDataFrame([(1, "a", ["q"], None)], WRITE)
    assert resolve(w, none[1], none[2], 0.85, str(tmp_path / "c")).first()["supersedes"] == ["q"]


def test_few_blocks_of_one_table(spark, tmp_path):
    """Writes, chunks and index from one table, as p3_write_batch has them; thousands of writes are one block, whose size changes nothing."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8))
    rows = [(i, str(i), f"{i}:0", (centres[rng.integers(40)] + 0.3 * rng.normal(size=8)).tolist()) for i in range(5000)]
    spark.createDataFrame(rows, "seq long, id string, chunk_id string, embedding array<double>").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t").withColumn("supersedes", F.when(F.col("seq") % 11 == 5, F.array((F.col("seq") - 4).cast("string"))))
    new, old = t.where("seq % 5 <> 0"), t.where("seq % 5 = 0").withColumnRenamed("id", "entry_id")
    run = lambda name, **more: resolve(new, new.withColumnRenamed("id", "entry_id"), old, 0.9, f"{tmp_path}/{name}", **more)
    whole = {r["seq"]: r["supersedes"] for r in run("a").collect()}
    assert len(list((tmp_path / "a").glob("settled-*"))) == 1
    assert whole == {r["seq"]: r["supersedes"] for r in run("b", block=1500).collect()}
    assert len(whole) == 4000 and sum(len(x) for x in whole.values()) > 3000
