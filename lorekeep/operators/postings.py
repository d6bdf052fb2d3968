"""A keyword index in blocks, and exact top-k search that reads few of them.

Chunks of a segment are numbered in the order in which they were written; 256 neighbours are a range.
A block is a term in a range: its postings (chunk, frequency, length, positions), and in columns of
their own the highest frequency and the least length, which bound the score that any of its chunks
can get from the term, whatever the corpus statistics have become since. Blocks are sorted by term.

A search reads the bounds alone first and evaluates the query on them: the most that a range can hold.
The best few ranges are scored, and their k-th score is a threshold: a chunk that belongs to the result
lies in a range whose bound reaches it, so only those ranges' postings are read, and all of them.

Statistics are those of all chunks in the live segments; what later segments hide counts until it is
compacted. Scores are ordered after rounding to nine digits, ties by chunk id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import search_terms
from lorekeep.operators import querylang, retrieval
from lorekeep.operators.bm25 import K1, B
from lorekeep.operators.querylang import Leaf, Node
from lorekeep.session import in_small_batches
from lorekeep.sources.segments import Segments, Snapshot

#: Chunks in a range, as a power of two; ranges that a search scores first, at least.
RANGE_BITS, FIRST_RANGES = 8, 8
#: Ranges whose blocks of a term lie in one file, as a power of two.
STRETCH_BITS = 12
#: So many ranges are named in the scan's filter, more are joined; lower bounds on rounding.
NAMED_RANGES, SLACK = 1000, 1e-8


_BLOCKS = "term string, range long, n long, max_tf int, min_dl long, postings array<struct<doc:long,tf:int,dl:long>>, positions array<array<int>>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch of docs; a range over two batches has two blocks of a term."""
    for batch in batches:
        terms, doc, dl = batch.column("terms"), batch.column("doc").to_numpy(), batch.column("dl").to_numpy()
        flat = terms.flatten().dictionary_encode()
        if not len(flat):
            continue
        lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(doc)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ranges, of_range = np.unique(doc >> RANGE_BITS, return_inverse=True)
        key = of_range[row] * len(flat.dictionary) + flat.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # rows and places stay in order
        key, row, place = key[order], row[order], place[order]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])  # of postings
        tf, of = np.diff(np.r_[starts, len(key)]).astype(np.int32), row[starts]
        key = key[starts]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # of blocks, among postings
        bounds = pa.array(np.r_[first, len(starts)].astype(np.int32))
        posting = pa.StructArray.from_arrays([pa.array(doc[of]), pa.array(tf), pa.array(dl[of])], ["doc", "tf", "dl"])
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(place)].astype(np.int32)), pa.array(place.astype(np.int32)))
        columns = [
            flat.dictionary.take(pa.array(key[first] % len(flat.dictionary))), pa.array(ranges[key[first] // len(flat.dictionary)]), pa.array(np.diff(np.r_[first, len(starts)])),
            pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl[of], first)), pa.ListArray.from_arrays(bounds, posting), pa.ListArray.from_arrays(bounds, places),
        ]
        yield pa.record_batch(columns, ["term", "range", "n", "max_tf", "min_dl", "postings", "positions"])


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc, dl, text), a written table -> the columns of ``_BLOCKS``, grouped where the docs lie, then sorted by term."""
    terms = docs.select("doc", "dl", search_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    found = in_small_batches(terms).mapInArrow(_grouped, _BLOCKS)
    # dealt by term and by stretches of ranges, so that a common term's blocks are in many files
    return found.repartition("term", F.shiftright("range", STRETCH_BITS)).sortWithinPartitions("term", "range")


def write_index(log: Segments, chunks: DataFrame, deletes: DataFrame | None = None, others: dict[str, DataFrame] | None = None) -> tuple[str, dict[str, DataFrame], dict]:
    """Writes a segment of chunks(chunk_id, entry_id, kind, text, ...): its name, tables and figures, for ``Segments.add``.

    deletes(entry_id): entries whose rows in earlier segments it hides, besides those it holds; others: further tables.
    """
    name = uuid.uuid4().hex
    docs = chunks.withColumn("dl", F.size(search_terms(F.coalesce("text", F.lit("")))).cast("long")).withColumn("doc", F.monotonically_increasing_id())
    docs = log.write(name, {"docs": docs})["docs"]  # numbers hold from here on
    ids = docs.select("entry_id")
    for more in [deletes] if deletes is not None else []:
        ids = ids.unionByName(more.select("entry_id"))
    tables = {"docs": docs} | log.write(name, {"blocks": blocks(docs), "ids": ids.distinct()} | (others or {}))
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return name, tables, {"chunks": n, "terms": total}


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


class Search:
    """A query on a snapshot; ``keep`` filters rows of docs(chunk_id, entry_id, kind, doc, version) that may be found."""

    def __init__(self, snapshot: Snapshot, query: str | Node, k: int, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.snapshot, self.k, self.keep = snapshot, k, keep
        self.node = querylang.parse(query) if isinstance(query, str) else query
        self.leaves = querylang.leaves(self.node)
        self.terms = sorted({t for leaf in self.leaves for t in leaf.terms})
        self.n = snapshot.total("chunks")
        self.mean_length = snapshot.total("terms") / self.n if self.n else 1.0

    @property
    def every(self) -> bool:
        """Whether the query asks for chunks without regard to terms, so that none can be left out."""
        return any(not leaf.terms for leaf in self.leaves)

    @cached_property
    def blocks(self) -> DataFrame:
        return self.snapshot.table("blocks").where(F.col("term").isin(self.terms))

    @property
    def frequencies(self) -> dict[str, int]:
        """In how many chunks each term asked is."""
        return self._known[0]

    def _score(self, leaf: Leaf, tf: Column, dl: Column, df: list[Column]) -> Column:
        if not leaf.terms:
            return F.lit(1.0)
        idf = sum((F.log(1 + (self.n - d + 0.5) / (d + 0.5)) for d in df), F.lit(0.0))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.mean_length))

    def _each(self, name: str, function: Callable, value: Column) -> list[Column]:
        return [function(F.when(F.col("term") == t, value)).alias(f"{name}{i}") for i, t in enumerate(self.terms)]

    def _of(self, name: str, leaf: Leaf) -> list[Column]:
        return [F.col(f"{name}{self.terms.index(t)}") for t in leaf.terms]

    @cached_property
    def ranges(self) -> DataFrame:
        """version, range, asked (its blocks), bound, df of each term: ranges that may hold what is asked for, by the blocks'
        bounds alone."""
        found = self.blocks.groupBy("version", "range").agg(F.count("*").alias("asked"), *self._each("tf", F.max, F.col("max_tf")), *self._each("dl", F.min, F.col("min_dl")))
        total = self.blocks.agg(*self._each("df", F.sum, F.col("n")))  # one row
        found = found.crossJoin(F.broadcast(total.fillna(0)))
        has, score = {}, {}
        for leaf in self.leaves:
            tf, dl, df = (self._of(n, leaf) for n in ("tf", "dl", "df"))
            has[leaf] = reduce(and_, (c.isNotNull() for c in tf), F.lit(True))
            # a phrase occurs no more often than its rarest term, in chunks no shorter than its longest shortest
            score[leaf] = self._score(leaf, F.least(*tf), F.greatest(*dl), df) if len(tf) > 1 else self._score(leaf, *tf, *dl, df) if tf else F.lit(1.0)
        dfs = [F.col(f"df{i}") for i in range(len(self.terms))]
        return found.where(querylang.matched(self.node, has, possibly=True)).select("version", "range", "asked", querylang.scored(self.node, score, has, possibly=True).alias("bound"), *dfs)

    @cached_property
    def _known(self) -> tuple[dict[str, int], list, bool]:
        """Frequencies, the ranges of the highest bounds, and whether they are all there are."""
        few = self.ranges.orderBy(F.desc("bound"), "version", "range").limit(NAMED_RANGES + 1).collect() if self.terms else []
        if not few and self.every and self.terms:  # no range has what is required beside
            row = self.blocks.agg(*self._each("df", F.sum, F.col("n"))).fillna(0).first()
        else:
            row = few[0] if few else None
        return {t: row[f"df{i}"] if row else 0 for i, t in enumerate(self.terms)}, few[:NAMED_RANGES], len(few) <= NAMED_RANGES

    def scores(self, ranges: DataFrame | list | None) -> DataFrame:
        """version, doc, score of the chunks that match, in these ranges; None: in all."""
        hits = self.blocks
        if isinstance(ranges, list):
            of = {v: [r.range for r in ranges if r.version == v] for v in {r.version for r in ranges}}
            hits = hits.where(reduce(or_, ((F.col("version") == v) & F.col("range").isin(named) for v, named in of.items()), F.lit(False)))
        elif ranges is not None:
            hits = hits.join(ranges.select("version", "range"), ["version", "range"], "left_semi")
        phrases = any(len(leaf.terms) > 1 for leaf in self.leaves)
        if phrases:  # else positions are not read
            hits = hits.select("version", "term", F.explode(F.arrays_zip("postings", "positions")).alias("p")).select("version", "term", "p.postings.*", "p.positions")
        else:
            hits = hits.select("version", "term", F.explode("postings").alias("p")).select("version", "term", "p.*")
        found = hits.groupBy("version", "doc").agg(F.max("dl").alias("dl"), *self._each("tf", F.max, F.col("tf")), *(self._each("at", F.max, F.col("positions")) if phrases else []))
        if self.every:
            found = self.snapshot.table("docs").select("version", "doc", F.col("dl").alias("own_dl")).join(found, ["version", "doc"], "left").withColumn("dl", F.coalesce("dl", "own_dl"))
        has, score, counts = {}, {}, {}
        for i, leaf in enumerate(self.leaves):
            of, df = self._of("tf", leaf), [F.lit(float(self.frequencies[t])) for t in leaf.terms]
            if len(of) > 1:
                starts = [_moved(c, j) for j, c in enumerate(self._of("at", leaf))]
                both = starts[0]
                for s in starts[1:]:
                    both = F.array_intersect(both, s)
                counts[f"c{i}"] = F.coalesce(F.size(both), F.lit(0))
            else:
                counts[f"c{i}"] = F.coalesce(of[0], F.lit(0)) if of else F.lit(1)
            has[leaf], score[leaf] = F.col(f"c{i}") > 0, self._score(leaf, F.col(f"c{i}"), F.col("dl"), df)
        found = found.withColumns(counts).where(querylang.matched(self.node, has))
        return found.select("version", "doc", querylang.scored(self.node, score, has).alias("score"))

    def _named(self, scores: DataFrame) -> DataFrame:
        docs = self.snapshot.table("docs").select("chunk_id", "entry_id", "kind", "doc", "version")
        docs = self.snapshot.visible(docs.join(scores, ["version", "doc"]))
        return self.keep(docs) if self.keep else docs

    @property
    def first(self) -> list:
        return self._known[1][: max(FIRST_RANGES, -(-self.k // 32))]

    @cached_property
    def threshold(self) -> float:
        """The k-th score among the best ranges; minus infinity where they hold fewer."""
        if self.first == self._known[1] and self._known[2]:
            return float("-inf")  # they are all there are
        scores = self.scores(self.first)
        if self.keep or self.snapshot.hidden() is not None:
            scores = self._named(scores)
        best = scores.orderBy(F.desc("score")).limit(self.k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        return best.least - SLACK if best.n == self.k else float("-inf")

    @cached_property
    def kept(self) -> DataFrame:
        """The ranges that can hold a chunk of the result."""
        return self.ranges.where(F.col("bound") >= self.threshold)

    def matches(self) -> DataFrame:
        """chunk_id, entry_id, kind, score of every chunk that matches, in no order."""
        every = self.scores(None if self.every else self.ranges) if self.leaves and self.n else None
        return self._named(every).select("chunk_id", "entry_id", "kind", "score") if every is not None else self._none()

    def _none(self) -> DataFrame:
        return self.snapshot.spark.createDataFrame([], "chunk_id string, entry_id string, kind string, score double")

    def top(self) -> DataFrame:
        """chunk_id, entry_id, kind, score, rn from 1: the k best."""
        if self.k <= 0 or not self.leaves or not self.n:
            return retrieval.top_k(self._none(), "score", 0)
        if self.every:
            scores = self.scores(None)
        else:
            named = [r for r in self._known[1] if r.bound >= self.threshold]
            # the named ones are those of the highest bounds: the rest matters only if all of them can hold a result
            whole = self._known[2] or len(named) < len(self._known[1])
            scores = self.scores(named if whole else self.kept).where(F.col("score") >= self.threshold)
        return retrieval.top_k(self._named(scores).select("chunk_id", "entry_id", "kind", "score"), "score", self.k)
