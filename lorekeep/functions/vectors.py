"""Vector functions: columns for one query, matrix products for many."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Over the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(_doubles(a), F.lit(1), n), F.slice(_doubles(b), F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def to_bytes(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def from_bytes(raw: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


#: Vectors in a block of queries and of what they are compared with; products of so many by so many are formed at a time.
_QUERIES, _VECTORS = 512, 4096


def _blocks(vectors: DataFrame, side: str, many: int) -> DataFrame:
    """vectors(id, embedding) in so many blocks: {side}_ids in order, {side}_vectors, unit vectors in double precision as bytes."""

    def pack(part):
        part = part.sort_values("id")
        x = np.array(part.embedding.tolist(), np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        return pd.DataFrame({f"{side}_block": [part.block.iloc[0]], f"{side}_ids": [part.id.tolist()], f"{side}_vectors": [x.tobytes()]})

    block = F.pmod(F.monotonically_increasing_id(), F.lit(many))
    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "embedding").withColumn("block", block).groupBy("block").applyInPandas(pack, f"{side}_block long, {side}_ids array<{kind}>, {side}_vectors binary")


def _nearest(asked: np.ndarray, held: np.ndarray, k: int):
    """The k rows of ``held`` nearest to each of ``asked`` by rounded products, ties to the first: row asked, row held, product; in slices."""
    for q in range(0, len(asked), _QUERIES):
        some = asked[q : q + _QUERIES]
        at, on, sims = np.empty(0, int), np.empty(0, int), np.empty(0)
        least = None
        for v in range(0, len(held), _VECTORS):
            products = some @ held[v : v + _VECTORS].T
            if least is None:  # of the first slice, all that may round to the k-th
                least = np.partition(products, -k, axis=1)[:, [-k]] - 2e-9 if k < products.shape[1] else np.full((len(some), 1), -np.inf)
            r, c = np.nonzero(products >= least)
            at, on, sims = np.append(at, r), np.append(on, v + c), np.append(sims, products[r, c])
            order = np.lexsort((on, -np.round(sims, 9), at))
            at, on, sims = at[order], on[order], sims[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, on, sims = at[best], on[best], sims[best]
            # later rows have to be nearer than the k-th, by more than rounding
            n = np.bincount(at, minlength=len(some))
            least = np.full((len(some), 1), -np.inf)
            least[n == k, 0] = np.round(sims[np.cumsum(n) - 1], 9)[n == k] + 4e-10
        yield q + at, on, sims


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int, query_rows: int = _QUERIES, vector_rows: int = _VECTORS) -> DataFrame:
    """vectors(chunk_id, embedding) against queries(query_id, embedding) -> query_id, chunk_id, sim.

    Both sides are packed in blocks; every block of queries meets every block of vectors as one row of two matrices, which
    are multiplied in a task and leave k rows a query; these meet by query. Nothing goes through the driver. What is shuffled is
    either side times the blocks of the other, so many queries ask in large blocks. Vectors that are
    null, hold nulls or are not as long as the first query take no part.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    first = queries.where(whole).select("query_id", F.size("embedding").alias("n")).orderBy("query_id").first()
    if first is None:
        return queries.select("query_id").limit(0).join(vectors.select("chunk_id").limit(0)).withColumn("sim", F.lit(0.0))
    of_length = whole & (F.size("embedding") == first["n"])
    asking = queries.where(of_length & F.col("query_id").isNotNull()).withColumnRenamed("query_id", "id")
    searched = vectors.where(of_length).withColumnRenamed("chunk_id", "id")
    many_q, many_v = (max(1, -(-df.count() // rows)) for df, rows in ((asking, query_rows), (searched, vector_rows)))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    asked = _blocks(asking, "q", many_q).withColumn("v_block", every(many_v))
    held = _blocks(searched, "v", many_v).withColumn("q_block", every(many_q))

    def best(batches):
        for batch in batches:
            for row in batch.itertuples():
                ids, names = np.array(row.q_ids, object), np.array(row.v_ids, object)
                q, v = np.frombuffer(row.q_vectors).reshape(len(ids), -1), np.frombuffer(row.v_vectors).reshape(len(names), -1)
                for at, on, sims in _nearest(q, v, k):
                    yield pd.DataFrame({"query_id": ids[at], "chunk_id": names[on], "sim": sims})

    # blocks against blocks, met by their numbers: neither side is broadcast
    pairs = held.hint("merge").join(asked, ["q_block", "v_block"])
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    found = pairs.mapInPandas(best, f"query_id {kinds[0]}, chunk_id {kinds[1]}, sim double")
    near = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("sim", 9)).alias("near"), "chunk_id", "sim"))), 1, k)
    return found.groupBy("query_id").agg(near.alias("best")).select("query_id", F.explode("best").alias("b")).select("query_id", "b.chunk_id", "b.sim")
