"""A batch of writes, resolved as if they were written one by one.

Without targets of its own, a write supersedes the nearest entry that is live when its turn comes, be it of
the index or an earlier write of the batch. The order matters only where writes want the same entries, and
a write takes at most one. So the batch is settled in blocks of at most ``block`` writes. For all writes of a block
the ``depth`` nearest are looked up, in parallel, among what is live before it: of the index and of earlier blocks
alike, without what has been superseded. One task settles the block from these lists and from the block's own
vectors, which it compares by matrix products of ``_STEP`` writes with all that came before in the block. A list that
holds ``depth`` rows is known only down to its last one: where that would decide, the block ends early, and the rest is
looked up anew, with longer lists for fewer writes. Nothing is cut off, and no task or list grows with a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.vectors import top_k_per_query

#: Writes that are settled in one task at most; candidates that are looked up for each ahead, at first.
BLOCK, DEPTH = 16_384, 32
#: Writes whose vectors are compared with the block's at once; a block's least part after lists ran out.
_STEP, _LEAST = 128, 512
_SETTLED = "seq long, id string, supersedes array<string>, similarity double"


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _own(df: DataFrame) -> DataFrame:
    """df with columns of its own, though it may come from the same table as another."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def settle(writes: pd.DataFrame, chunks: pd.DataFrame, lists: pd.DataFrame, threshold: float, depth: int) -> pd.DataFrame:
    """Writes of a block in their order, until a list ends before it decides.

    writes: seq, id, supersedes, embedding (null: asks for nothing); chunks: seq, chunk_id, entry_id, embedding, of the block's
    writes; lists: seq, entry_id, chunk_id, near, the nearest of what is live before the block.
    """
    writes = writes.sort_values("seq").reset_index(drop=True)
    chunks = chunks.sort_values("chunk_id").sort_values("seq", kind="stable").reset_index(drop=True)
    at = dict(zip(writes["id"], writes["seq"]))
    lists = lists.assign(order=-lists["near"]).sort_values(["seq", "order", "chunk_id"])
    wanted = {seq: list(zip(p["order"], p["chunk_id"], p["entry_id"])) for seq, p in lists.groupby("seq", sort=False)}
    born, names, entries = chunks["seq"].to_numpy(), chunks["chunk_id"].to_numpy(), chunks["entry_id"].to_numpy()
    of: dict[str, list[int]] = {}
    for j, e in enumerate(entries):
        of.setdefault(e, []).append(j)
    held = _unit(chunks["embedding"]) if len(chunks) else None
    alive = np.ones(len(chunks), bool)
    dead: set[str] = set()
    rows = []
    for start in range(0, len(writes), _STEP):
        part = writes.iloc[start : start + _STEP]
        asks = np.flatnonzero(part["embedding"].notna())
        before = np.searchsorted(born, part["seq"].to_numpy())  # chunks of earlier writes
        most = before[-1]
        place = {q: n for n, q in enumerate(asks)}
        near = np.round(_unit(part["embedding"].iloc[asks]) @ held[:most].T, 9) if len(asks) and most else None
        for q, (seq, name, targets) in enumerate(part[["seq", "id", "supersedes"]].itertuples(index=False)):
            targets, similarity = list(targets), None
            if q in place:
                listed = wanted.get(seq, [])
                took = next((c for c in listed if c[2] not in dead), None)
                known = listed[-1][:2] if len(listed) >= depth else None  # what may follow a full list is unknown
                if near is not None and before[q]:
                    sims = np.where(alive[: before[q]], near[place[q], : before[q]], -np.inf)
                    top = sims.max()
                    if top >= threshold:
                        j = min(np.flatnonzero(sims == top), key=names.__getitem__)
                        took = min((-top, names[j], entries[j]), took or (np.inf, "", ""))
                if known is not None and (took is None or took[:2] > known):
                    return pd.DataFrame(rows, columns=["seq", "id", "supersedes", "similarity"])
                if took is not None:
                    targets, similarity = [took[2]], -took[0]
            for t in targets:
                if at.get(t, seq - 1) < seq:  # a name that a later write gets hides nothing
                    dead.add(t)
                    alive[[j for j in of.get(t, []) if born[j] < seq]] = False
            rows.append((seq, name, targets, similarity))
    return pd.DataFrame(rows, columns=["seq", "id", "supersedes", "similarity"])


def resolve(writes: DataFrame, chunks: DataFrame, live: DataFrame, threshold: float, folder: str, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """What each write supersedes: seq, id, supersedes, similarity (null where no entry was near, or targets were named).

    writes(seq, id, supersedes, embedding): in the order of seq, which like id is unique and not null; a write with targets
    (supersedes null: none) keeps them and looks for no other; without a vector it supersedes nothing. chunks(seq, chunk_id,
    entry_id, embedding): of the writes, as later ones find them. live(chunk_id, entry_id, embedding): of entries of the index that
    are not superseded. Nearness is the cosine rounded to nine digits, at or above the threshold; of equal ones the smaller
    chunk_id counts. Vectors that are null, hold nulls or non-finite numbers or are not as long as the first write's take no part. Targets hide
    entries of the index and earlier writes; other names hide nothing. Tables are read several times: give written ones. folder:
    a new one that executors share, for what is settled, which the result reads.
    """
    spark = writes.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    writes = writes.select("seq", "id", F.coalesce("supersedes", F.array().cast("array<string>")).alias("supersedes"), "embedding")
    asking = writes.where((F.size("supersedes") == 0) & whole).select("seq", "embedding")
    first = asking.select("seq", F.size("embedding").alias("n")).orderBy("seq").first()
    of_length = whole & (F.size("embedding") == (first["n"] if first else -1))
    asks = of_length & (F.size("supersedes") == 0)
    asking, chunks, live = asking.where(of_length), chunks.where(of_length), live.where(of_length)
    settled: list[str] = []
    last, now_block, now_depth = None, block, depth

    def gone() -> DataFrame:
        """gone_id, at: what has been superseded and by which write last."""
        if not settled:
            return spark.createDataFrame([], "gone_id string, at long")
        return spark.read.schema(_SETTLED).parquet(*settled).select(F.explode("supersedes").alias("gone_id"), "seq").groupBy("gone_id").agg(F.max("seq").alias("at"))

    def of_block(df: DataFrame, high: int) -> DataFrame:
        return df.where(F.col("seq") <= high) if last is None else df.where((F.col("seq") > last) & (F.col("seq") <= high))

    def looked_up(high: int) -> DataFrame:
        """The nearest of what is live before the block for each of its writes."""
        of_index = live.join(gone(), F.col("entry_id") == F.col("gone_id"), "left_anti").select("chunk_id", "entry_id", "embedding")
        now = of_index
        if last is not None:
            earlier = chunks.where(F.col("seq") <= last).join(gone(), (F.col("entry_id") == F.col("gone_id")) & (F.col("at") > F.col("seq")), "left_anti")
            now = now.unionByName(earlier.select("chunk_id", "entry_id", "embedding"))
        path = f"{folder}/live-{len(settled)}"
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        found = top_k_per_query(now.select("chunk_id", "embedding"), of_block(asking, high).withColumnRenamed("seq", "query_id"), now_depth)
        found = found.withColumn("near", F.round("sim", 9)).where(F.col("near") >= threshold).join(now.select("chunk_id", "entry_id"), "chunk_id")
        return found.select(F.col("query_id").alias("seq"), "entry_id", "chunk_id", "near")

    def settling(depth: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(w: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            listed = found["near"].notna()
            return settle(w, found[~listed], found[listed], threshold, depth)

        return run

    while True:
        rest = writes if last is None else writes.where(F.col("seq") > last)
        high = rest.select("seq").orderBy("seq").limit(now_block).agg(F.max("seq")).first()[0]
        if high is None:
            break
        found = of_block(chunks, high).select("seq", "chunk_id", "entry_id", "embedding", F.lit(None).cast("double").alias("near"))
        if first:
            found = found.unionByName(looked_up(high).withColumn("embedding", F.lit(None).cast(chunks.schema["embedding"].dataType)))
        # a block's rows: its writes, their chunks and lists of depth rows
        one = _own(of_block(writes, high).withColumn("embedding", F.when(asks, F.col("embedding")))).withColumn("one", F.lit(0)).groupBy("one")
        path = f"{folder}/settled-{len(settled)}"
        one.cogroup(_own(found).withColumn("one", F.lit(0)).groupBy("one")).applyInPandas(settling(now_depth), _SETTLED).write.parquet(path)
        reached = spark.read.schema(_SETTLED).parquet(path).agg(F.max("seq")).first()[0]
        settled.append(path)
        last = last if reached is None else reached
        if last != high:  # longer lists for fewer writes, so that a block's rows stay as many
            now_depth, now_block = now_depth * 2, max(now_block // 2, min(_LEAST, block))
        else:
            now_depth, now_block = depth, block
    if not settled:
        return spark.createDataFrame([], _SETTLED)
    return spark.read.schema(_SETTLED).parquet(*settled)
