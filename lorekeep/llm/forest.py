"""Near-duplicate embeddings by a forest of random-projection trees.

In every tree a node's vectors are projected on a random direction and parted at the median; those
within MARGIN of it go to both sides (spill), so that a close pair is rarely parted. Splitting goes
on until a node is small, or so dense that the margin would send most of it to both sides. Nodes of
more than GROUP vectors are split level by level as distributed tables; smaller ones by recursion in
one task each, which only reports the leaves of each vector. Then the vectors of such a node come
together once more with the leaves that they are in, and each leaf verifies its pairs by cosine in
double precision. A pair that several leaves hold is counted in the one with the smallest key; what
leaves a leaf is one row per linked vector (its links, and the smallest vector of its part), never a
pair. A node that is dense and yet larger than GROUP is compared chunk by chunk.

Vectors are compared only when labels are equal and not null. Equal vectors of a label are one
vector with a weight. Defined results: vectors that are null, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of other lengths are not compared;
vectors at equal distances are told apart by their smallest ids; repeated vec_ids count as rows
each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, read, working, written
from .components import components, roots

TREES = 6
COSINE = 0.93
#: Nodes of so many vectors or fewer are leaves.
LEAF = 512
#: Vectors that one task takes; larger nodes are split as distributed tables.
GROUP = 8_192
#: Half of the width of the strip around a split that goes to both sides, for unit vectors.
MARGIN = 0.03
#: A node is dense if a side would get more than this share of it.
DENSE = 0.8
_ROWS = 512


def usable(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray | None:
    """Lists of one length as the rows of a matrix, without objects in between; None if their lengths differ."""
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0]).astype(np.float64)
    return None


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the projection of each vector on the direction of its node."""
    working("forest")
    for batch in batches:
        tree, node, lists = (batch.column(c) for c in ("tree", "node", "v"))
        whole = _matrix(lists)
        p = np.zeros(batch.num_rows)
        for (t, n), at in pd.DataFrame({"t": tree.to_numpy(), "n": node.to_numpy()}).groupby(["t", "n"]).indices.items():
            x = whole[at] if whole is not None else np.array(lists.take(pa.array(at)).to_pylist(), np.float64)  # of a node's, lengths are equal
            p[at] = x @ _direction(t, n, x.shape[1]) / np.linalg.norm(x, axis=1)
        yield batch.append_column("p", pa.array(p))


def _direction(tree: int, node: int, size: int) -> np.ndarray:
    found = np.random.default_rng([int(tree), int(node) % (1 << 64)]).normal(size=size)
    return found / np.linalg.norm(found)


def _mixed(*parts: int) -> int:
    """A 64-bit key of several numbers."""
    return int(np.random.SeedSequence([int(p) % (1 << 64) for p in parts]).generate_state(1, np.uint64)[0].view(np.int64))


def placed(vectors: DataFrame, trees: int, group: int, margin: float) -> DataFrame:
    """vectors(id, label, weight, v) -> tree, node, chunks, id, weight, v: nodes of at most ``group`` vectors, or dense ones in chunks of half as many."""
    rows = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.xxhash64("label", F.size("v")).alias("node"), "id", "weight", "v"
    )
    columns = ["tree", "node", "chunks", "id", "weight", "v"]
    found, levels = [], []
    while True:
        sizes = written(rows.groupBy("tree", "node").agg(F.count("*").alias("n")), "sizes", let_go=False)
        rows = rows.join(sizes, ["tree", "node"])
        found.append(rows.where(F.col("n") <= group).withColumn("chunks", F.lit(1)).select(columns))
        if sizes.where(F.col("n") > group).isEmpty():
            break
        level = rows.where(F.col("n") > group).select("tree", "node", "id", "weight", "v")
        levels.append(level := written(level.mapInArrow(_project, "tree int, node long, id long, weight long, v array<float>, p double"), "level"))
        stats = level.groupBy("tree", "node").agg(F.count("*").alias("n"), F.percentile_approx("p", [1 - DENSE, 0.5, DENSE], 1000).alias("q"))
        dense = (F.col("q")[1] + margin >= F.col("q")[2]) | (F.col("q")[1] - margin <= F.col("q")[0])
        stats = written(stats.select("tree", "node", "n", F.col("q")[1].alias("cut"), dense.alias("dense")), "nodes", let_go=False)
        level = level.join(stats, ["tree", "node"])
        found.append(level.where("dense").withColumn("chunks", F.ceil(F.col("n") * 2 / group).cast("int")).select(columns))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("cut") + margin, 0), F.when(F.col("p") >= F.col("cut") - margin, 1)))
        rows = (
            level.where("not dense").select("tree", "node", "id", "weight", "v", F.explode(sides).alias("side"))
            .select("tree", F.xxhash64("node", "side").alias("node"), "id", "weight", "v")
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _unit_rows(table: pa.Table) -> np.ndarray:
    x = _matrix(table.column("v").combine_chunks())
    return x / np.linalg.norm(x, axis=1)[:, None]


def _grow(leaf: int, margin: float):
    """The leaves below a node, by recursion: for each vector the keys of those that it is in."""

    def run(key, table):
        working("forest")
        tree, node = (k.as_py() for k in key)
        x, ids = _unit_rows(table), table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        members, keys = [], []
        open_ = [(node, np.arange(len(ids)))]
        while open_:
            node, at = open_.pop()
            sides = ()
            if len(at) > leaf:
                p = x[at] @ _direction(tree, node, x.shape[1])
                cut = np.median(p)
                sides = (at[p <= cut + margin], at[p >= cut - margin])
            if not sides or max(map(len, sides)) > DENSE * len(at):
                members.append(at)
                keys.append(np.full(len(at), _mixed(tree, node)))
            else:
                open_ += [(_mixed(node, k), side) for k, side in enumerate(sides)]
        members, keys = np.concatenate(members), np.concatenate(keys)
        order = np.argsort(members, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(members, minlength=len(ids)))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order]))
        n = len(ids)
        return pa.table({"tree": pa.array(np.full(n, tree, np.int32)), "node": pa.array(np.full(n, key[1].as_py())), "id": pa.array(ids), "mine": lists})

    return run


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and the row of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _compare(cosine: float):
    """Each leaf's pairs (of two chunks: those across): a row per linked vector."""

    def run(key, table):
        working("forest")
        low, high = key[2].as_py(), key[3].as_py()
        table = table.sort_by("id")
        x, weight, ids = _unit_rows(table), table.column("weight").to_numpy(), table.column("id").to_numpy()
        chunk = table.column("chunk").to_numpy()
        mine, mine_row = _lists(table.column("mine"))
        every, every_row = _lists(table.column("keys"))
        out: list[tuple] = []
        for own in np.unique(mine):
            at = mine_row[mine == own]
            if len(at) < 2:
                continue
            close = np.zeros((len(at), len(at)), bool)
            for i in range(0, len(at), _ROWS):
                close[i : i + _ROWS] = x[at[i : i + _ROWS]] @ x[at].T >= cosine
            np.fill_diagonal(close, False)
            if low != high:  # pairs across the two chunks alone
                close &= (chunk[at] == low)[:, None] != (chunk[at] == low)[None, :]
            some = np.flatnonzero(close.any(1))
            if not len(some):
                continue
            at, close = at[some], close[np.ix_(some, some)]
            root = roots(close)
            # pairs that share a leaf of a smaller key are counted there
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            smaller = (every < own) & (place[every_row] >= 0)
            if smaller.any():
                names, column = np.unique(every[smaller], return_inverse=True)
                held = np.zeros((len(at), len(names)), np.float32)
                held[place[every_row[smaller]], column] = 1
                for i in range(0, len(at), _ROWS):
                    close[i : i + _ROWS] &= (held[i : i + _ROWS] @ held.T) == 0
            links = np.concatenate([close[i : i + _ROWS] @ weight[at] for i in range(0, len(at), _ROWS)])
            out.append((ids[at], links, ids[at[root]]))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table(dict(zip(("id", "links", "root"), (pa.array(c.astype(np.int64)) for c in columns), strict=True)))

    return run


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, group: int = GROUP, margin: float = MARGIN) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), "label")
    can = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    distinct = written(vectors.where(can).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "distinct")
    rows = placed(distinct, trees, group, margin)
    one = rows.where("chunks = 1").select("tree", "node", "id", "v")
    mine = one.groupBy("tree", "node").applyInArrow(_grow(leaf, margin), "tree int, node long, id long, mine array<long>")
    mine = written(mine.unionByName(rows.where("chunks > 1").select("tree", "node", "id", F.array(F.xxhash64("tree", "node")).alias("mine"))), "mine", let_go=False)
    keys = written(mine.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("mine"))).alias("keys")), "keys", let_go=False)  # a few for each tree
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = (
        rows.join(mine, ["tree", "node", "id"]).join(keys, "id").withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("tree", "node", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id", "weight", "v", "mine", "keys")
    )
    compared = written(dealt.groupBy("tree", "node", "low", "high").applyInArrow(_compare(cosine), "id long, links long, root long"), "compared")
    for table in (mine, keys):
        dropped(table)
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    known = distinct.join(links, "id", "left").join(classes, "id", "left").select(
        F.col("label").alias("its_label"), F.col("v").alias("its_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    known = written(known, "known")
    return (
        vectors.join(known, (F.col("label") == F.col("its_label")) & (F.col("v") == F.col("its_v")) & can, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op3_rp_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read(spark, sf_dir, "embeddings"))
