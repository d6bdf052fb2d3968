"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample. Every vector is put on the list of its nearest centroid
and, near a boundary, on those of others almost as near. Lists are cut into chunks of bounded size.
A query walks a neighbour graph of the centroids, which every worker holds in memory (there are at
most MOST_LISTS), from near to near, and takes the lists whose centroids are at most RATIO times as
far as the nearest. Chunks report their nearest to each query; the best of all are the result.

RATIO is fitted: the least of a row of ratios that reaches AIM recall for sample queries against
the sample. Nearness is Euclidean, in double precision, recomputed on the original vectors.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of each length are searched apart; a query meets every row but its own, also those that
share its id or its vector, and every row of an id is a query and a candidate of its own; ties go to
the smaller id; with fewer candidates than k all are returned; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, written
from .forest import usable

#: Bound of the sample that centroids and ratio are fitted on.
SAMPLE = 16_384
#: Vectors per list that is aimed at, and the most lists.
LIST, MOST_LISTS = 512, 4_096
#: A vector is copied to at most COPIES lists whose centroids are within BOUNDARY times the nearest distance.
COPIES, BOUNDARY = 4, 1.03
RATIOS, AIM = (1.02, 1.05, 1.08, 1.1, 1.12, 1.15, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 4.0), 0.97
#: Vectors in a chunk of a list, queries that meet it at once.
CHUNK, QUERIES = 2_048, 2_048
_DEGREE = 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


class Lists:
    """Centroids, the graph over them and the pruning ratio."""

    def __init__(self, centroids: np.ndarray, ratio: float = 1.0):
        self.centroids, self.ratio = centroids, ratio
        between = distances(centroids, centroids)
        near = np.argsort(between, axis=1, kind="stable")[:, 1 : _DEGREE + 1]
        edges = [set(row.tolist()) for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row:
                edges[j].add(i)
        for i in range(len(edges) - 1):  # a chain: every centroid can be reached
            edges[i].add(i + 1)
            edges[i + 1].add(i)
        self.edges = [np.array(sorted(e), np.int64) for e in edges]
        self.start = int(distances(centroids.mean(0)[None, :], centroids).argmin()) if len(centroids) else 0

    def walk(self, q: np.ndarray, ratio: float, least: int = 1, beam: int = 16) -> list[tuple[float, int]]:
        """(distance, list) from near to far: those within ratio of the nearest, and ``least`` at least."""
        measure = lambda at: np.sqrt(((self.centroids[at] - q) ** 2).sum(1))
        first = float(measure(np.array([self.start]))[0])
        seen = np.zeros(len(self.centroids), bool)
        seen[self.start] = True
        frontier, found = [(first, self.start)], [(first, self.start)]
        nearest = [-first]  # the beam's distances, farthest on top
        best = first
        while frontier:
            d, i = heapq.heappop(frontier)
            if len(nearest) >= max(beam, least) and d > max(-nearest[0], best * ratio):
                break
            new = self.edges[i][~seen[self.edges[i]]]
            seen[new] = True
            for e, j in zip(measure(new).tolist(), new.tolist(), strict=True):
                heapq.heappush(frontier, (e, j))
                found.append((e, j))
                best = min(best, e)
                heapq.heappush(nearest, -e)
                if len(nearest) > max(beam, least):
                    heapq.heappop(nearest)
        found.sort()
        return [x for k, x in enumerate(found) if k < least or x[0] <= best * ratio]


def fit(sample: np.ndarray, total: int, k: int, per_list: int = LIST, seed: int = 7) -> Lists:
    """k-means centroids of the sample; the least ratio that finds AIM of the sample's neighbours."""
    n = len(sample)
    count = int(np.clip(total // per_list, 1, min(MOST_LISTS, max(1, n // 4))))
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(n, count, replace=False))]
    for _ in range(8):
        at = distances(sample, centroids).argmin(1)
        size = np.bincount(at, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], sample[rng.choice(n, count)])
    lists = Lists(centroids)
    if count == 1:
        return lists
    asked = sample[rng.choice(n, min(200, n), replace=False)]
    to = distances(sample, centroids)
    own = to <= to.min(1)[:, None] * 1.0000001
    true = np.argsort(distances(asked, sample), axis=1, kind="stable")[:, 1 : k + 1]
    ahead = distances(asked, centroids)
    for ratio in RATIOS:
        lists.ratio = ratio
        taken = ahead <= ahead.min(1)[:, None] * ratio
        if np.mean([(own[t] & taken[i]).any(1).mean() for i, t in enumerate(true)]) >= AIM:
            break
    return lists


def _fitted(vectors: DataFrame, k: int) -> Lists | None:
    total = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id"), "id", "key").limit(SAMPLE).toPandas()
    return fit(np.array(rows.sort_values(["id", "key"], kind="stable").v.tolist(), np.float64), total, k) if len(rows) else None


def _keyed(rows: DataFrame) -> DataFrame:
    """(id, v) with a key that no two rows share; rows equal in both are numbered."""
    rows = rows.select("id", "v")
    again = written(rows.groupBy("id").count().where("count > 1").select("id"), "again", let_go=False)
    number = F.row_number().over(Window.partitionBy("id", "v").orderBy(F.lit(0)))
    one = rows.join(again, "id", "left_anti").select("id", "v", F.lit(1).alias("number"))
    return one.unionByName(rows.join(again, "id", "left_semi").select("id", "v", number.alias("number"))).select("id", "v", F.xxhash64("id", "v", "number").alias("key"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors(id, v), queries(id, v), rows of vectors, all usable -> query_id, rank (from 1), vec_id, score."""
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sorted(r[0] for r in queries.select(F.size("v")).distinct().collect())  # mostly one
    keyed, asking = _keyed(vectors), _keyed(queries)
    for n in lengths:
        found = found.unionByName(_nearest(keyed.where(F.size("v") == n), asking.where(F.size("v") == n), k))
    return found


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    model = _fitted(vectors, k)
    held = spark.sparkContext.broadcast(model)  # MOST_LISTS centroids and their graph

    def placed(batches):
        for batch in batches:
            if not len(batch):
                continue
            to = distances(np.array(batch.v.tolist(), np.float64), held.value.centroids)
            near = np.argsort(to, axis=1, kind="stable")[:, :COPIES]
            far = np.take_along_axis(to, near, 1)
            row, rank = np.nonzero(far <= far[:, :1] * BOUNDARY)
            yield pd.DataFrame({"list": near[row, rank], "own": rank == 0, "id": batch.id.to_numpy()[row], "key": batch.key.to_numpy()[row], "v": batch.v.to_numpy()[row]})

    postings = written(vectors.select("id", "key", "v").mapInPandas(placed, "list int, own boolean, id long, key long, v array<float>"), "postings")
    sizes = {r["list"]: (r["n"], r["own"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect()}  # MOST_LISTS rows
    sizes = spark.sparkContext.broadcast(sizes)

    def routed(batches):
        for batch in batches:
            rows = []
            for i, (_, q) in enumerate(zip(batch.id, batch.v, strict=True)):
                model, own = held.value, 0
                q = np.array(q, np.float64)
                for least in (1, 4, 16, 64, 256, 1024, MOST_LISTS):  # until the lists hold more than k vectors
                    lists = [j for _, j in model.walk(q, model.ratio, least)]
                    if sum(sizes.value.get(j, (0, 0))[1] for j in lists) > k or least >= len(model.centroids):
                        break
                rows += [(j, i) for j in lists if j in sizes.value]
            at = [i for _, i in rows]
            yield pd.DataFrame({"list": [j for j, _ in rows], **{c: batch[c].to_numpy()[at] if at else [] for c in ("id", "key", "v")}})

    asked = written(queries.select("id", "key", "v").mapInPandas(routed, "list int, id long, key long, v array<float>"), "asked")
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows
    # lists by chunks, queries of a list by parts: each chunk meets each part
    cuts = spark.createDataFrame([(j, -(-n // CHUNK), -(-asks[j] // QUERIES)) for j, (n, _) in sizes.value.items() if j in asks] or [(-1, 1, 1)], "list int, chunks int, parts int")
    cuts = F.broadcast(cuts)
    salt = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = postings.join(cuts, "list").select("list", salt("chunks").alias("chunk"), every("parts").alias("part"), "id", "key", "v")
    right = asked.join(cuts, "list").select("list", every("chunks").alias("chunk"), salt("parts").alias("part"), "id", "key", "v")

    def best(posting: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(posting) and len(query):
            posting = posting.sort_values(["id", "key"], kind="stable")
            x, q = np.array(posting.v.tolist(), np.float64), np.array(query.v.tolist(), np.float64)
            ids, keys = posting.id.to_numpy(), posting.key.to_numpy()
            rough = distances(q, x)
            for i, (query_id, query_key) in enumerate(zip(query.id.tolist(), query.key.tolist(), strict=True)):
                at = np.flatnonzero(keys != query_key)
                if len(at) > k:
                    d = rough[i, at]
                    at = at[d <= np.partition(d, k - 1)[k - 1] + 1e-6]
                score = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                for j in np.lexsort((ids[at], score))[:k]:
                    out.append((query_key, query_id, int(keys[at[j]]), int(ids[at[j]]), float(score[j])))
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_key", "vec_id", "score"])

    by = ("list", "chunk", "part")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, "query_key long, query_id long, vec_key long, vec_id long, score double")
    # a query has k rows of each chunk that it meets; the same vector may be on several lists
    best_of = found.groupBy("query_key", "query_id", "vec_key", "vec_id").agg(F.min("score").alias("score")).groupBy("query_key", "query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")
    )
    return best_of.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


def op4_ann_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    vectors = vectors.where(usable(F.col("v")) & F.col("id").isNotNull())
    return nearest(vectors, vectors.where("id % 100 = 0"), 10)
