"""The knowledge base: init, ingest, search, write, status and traces over an index of segments.

The index is a log of versions (``sources.segments``): ingest puts one segment in the place of all, a
write adds one and touches no other, and two writers at once both succeed. A reader sees one version.
Files are the source of truth; ingest is idempotent. Embedding and reranking are pluggable.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import missing_warning, search_terms
from lorekeep.functions.vectors import cosine
from lorekeep.operators import batch, neardup, postings, retrieval, supersede
from lorekeep.operators.chunker import chunk_entries
from lorekeep.schema import DEFAULT_KIND, ENTRIES, KINDS, Config
from lorekeep.session import ship
from lorekeep.sources import entries as source
from lorekeep.sources.segments import Conflict, Segments, Snapshot
from lorekeep.sources.traces import read_lines, recent_traces
from lorekeep.streaming import maintenance

DIM = 256


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """A deterministic vector of a text: its terms counted in dim places by a hash. Needs no model."""

    @F.pandas_udf("array<float>")
    def counted(places: pd.Series) -> pd.Series:
        return places.map(lambda p: None if p is None else np.bincount(p, minlength=dim).astype(np.float32))

    return counted(F.transform(search_terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))


def lexical_reranker(query: str, text: Column) -> Column:
    """The share of the query's terms that a text has."""
    asked = search_terms(F.lit(query))
    return F.size(F.array_intersect(asked, search_terms(text))) / F.greatest(F.size(F.array_distinct(asked)), F.lit(1))


@dataclass
class KnowledgeBase:
    spark: SparkSession
    folder: str
    config: Config = field(default_factory=Config)
    embed: Callable[[Column], Column] = hashed_embedding
    #: (query, text) -> score; None: the fused score stands.
    rerank: Callable[[str, Column], Column] | None = None

    # tables

    @property
    def entries_dir(self) -> str:
        return f"{self.folder}/entries"

    def __post_init__(self):
        ship(self.spark)

    @property
    def index(self) -> Segments:
        return Segments(self.spark, f"{self.folder}/index")

    def init(self) -> None:
        """Makes the folders and an empty index; what is there stays."""
        Path(self.entries_dir).mkdir(parents=True, exist_ok=True)
        if not self.index.versions():
            self.index.commit(lambda last, version: (last.segments, {"entry_count": 0} | last.meta))

    def _written(self, entries: DataFrame, resolved: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, dict[str, DataFrame], dict]:
        """A segment of entries, not yet part of a version. resolved: from the vectors to the entries as they are to be held."""
        chunks = chunk_entries(entries, self.config.chunking).where("text <> ''")
        # every entry is one that the segment holds, also without a chunk
        name, tables, figures = postings.write_index(self.index, chunks, entries.select(F.col("id").alias("entry_id")))
        tables |= self.index.write(name, {"vectors": tables["docs"].select("chunk_id", "entry_id", "kind", self.embed(F.col("text")).alias("embedding"))})
        return name, tables | self.index.write(name, {"entries": resolved(tables["vectors"]) if resolved else entries}), figures

    @staticmethod
    def _entries(at: Snapshot) -> DataFrame:
        return at.visible(at.table("entries").withColumnRenamed("id", "entry_id")).withColumnRenamed("entry_id", "id")

    def _superseded(self, at: Snapshot) -> DataFrame:
        """entry_id of what is superseded: from the links that a stream keeps, if all segments are its own, else from the entries."""
        found = maintenance.superseded(at.table("links")) if maintenance.stream_of(at) else supersede.superseded_ids(self._entries(at))
        return found.select(F.col("id").alias("entry_id"))

    def _vectors(self, at: Snapshot) -> DataFrame:
        return at.visible(at.table("vectors")).join(self._superseded(at), "entry_id", "left_anti")

    def _files(self) -> int:
        return source.count_entries(self.spark, self.entries_dir)

    # operations

    def ingest(self) -> DataFrame:
        """Puts a segment of all files in the place of those there are. One row: entries, chunks, superseded, skipped.

        Entries written meanwhile have files and segments of their own: the later segment counts.
        """
        while True:
            at = self.index.snapshot()
            files = self._files()
            entries, skipped = source.read_entries(self.spark, self.entries_dir)
            try:
                done = self.index.add(*self._written(entries), meta={"last_ingest": source.now(), "entry_count": files}, replaces=at)
            except Conflict:
                continue  # another ingest or a compaction was first
            break
        counts = [(self._entries(done), "entries_ingested"), (done.visible(done.table("docs")), "chunks_indexed"), (self._superseded(done), "superseded_count")]
        out = self.spark.range(1)
        for df, name in counts:
            out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
        return out.drop("id").crossJoin(skipped.agg(F.array_sort(F.collect_list(F.struct("file", "reason"))).alias("entries_skipped")))

    def search(self, query: str, limit: int | None = None, max_tokens: int | None = None, min_score: float | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Results (rank, id, chunk_id, kind, score, content) and the quality row. query: see ``operators.querylang``."""
        limit = self.config.search.default_limit if limit is None else limit
        if kind is not None and kind.lower() not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        at = self.index.snapshot()
        if not at.meta.get("entry_count") or not at.segments:
            none = self.spark.createDataFrame([], "rank int, id string, chunk_id string, kind string, score double, content string")
            return none, retrieval.quality(none, cold=True)
        n = retrieval.oversampled(limit, kind is not None, self.config.search.reranker_candidates)
        gone, vectors = self._superseded(at), self._vectors(at)
        if kind:
            vectors = vectors.where((F.col("kind") == kind.lower()) | F.col("kind").isNull() | ~F.col("kind").isin(*KINDS))

        def keep(docs: DataFrame) -> DataFrame:
            live = docs.join(gone, "entry_id", "left_anti")
            return live.where(F.col("kind") == kind.lower()) if kind else live

        keyword = postings.Search(at, query, n, keep).top()
        asked = F.lit(self.spark.range(1).select(self.embed(F.lit(query)).alias("q")).first()["q"])  # once, not for each vector
        near = retrieval.top_k(vectors.select("chunk_id", cosine(F.col("embedding"), asked).alias("sim")), "sim", n)
        fused = retrieval.top_k(retrieval.fuse([keyword, near], self.config.search.rrf_k), "rrf", self.config.search.reranker_candidates)
        # texts are fetched for the candidates alone
        found = at.visible(fused.join(at.table("docs").select("chunk_id", "entry_id", "kind", "text", "version"), "chunk_id"))
        score = F.coalesce(self.rerank(query, F.col("text")), F.col("rrf")) if self.rerank else F.col("rrf")
        best = retrieval.best_per_entry(found.withColumn("score", score.cast("double"))).drop("rn")
        before = best.count() if min_score is not None else 0
        if min_score is not None:
            best = best.where(F.col("score") >= min_score)
        ranked = retrieval.top_k(best, "score", self.config.search.reranker_candidates)
        if max_tokens is not None:
            ranked = retrieval.within_budget(ranked, max_tokens)
        results = ranked.where(F.col("rn") <= limit).select(F.col("rn").alias("rank"), F.col("entry_id").alias("id"), "chunk_id", "kind", "score", F.col("text").alias("content"))
        return results, retrieval.quality(results, stale=self._files() != at.meta["entry_count"], before_minimum=before)

    def write(self, content: str, kind: str = DEFAULT_KIND, tags: list[str] | None = None, supersedes: list[str] | None = None) -> dict:
        """Writes an entry; content near to that of another supersedes it, unless targets are named."""
        if kind.lower() not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        targets, similarity, warning = list(supersedes or []), None, None
        at = self.index.snapshot()
        if at.segments and not targets and content.strip():
            asked = F.lit(self.spark.range(1).select(self.embed(F.lit(content)).alias("q")).first()["q"])
            near = neardup.best_match(self._vectors(at), asked, self.config.search.dedup_threshold).collect()
            if near:
                targets, similarity = [near[0]["entry_id"]], near[0]["sim"]
        if targets:
            known = self._entries(at).select("id") if at.segments else self.spark.createDataFrame([], "id string")
            wanted = self.spark.createDataFrame([(t,) for t in targets], "id string")
            missing = supersede.missing_targets(wanted, known).agg(F.array_sort(F.collect_list("id")).alias("ids"))
            warning = missing.select(missing_warning(F.col("ids")).alias("w")).first()["w"]
        entry = source.new_entry(content, kind.lower(), tags, targets)
        source.write_entry(self.entries_dir, entry)  # the file first: the index can be made again
        new = self._written(self.spark.createDataFrame([entry], ENTRIES))
        self.index.add(*new, meta=lambda was: {"last_ingest": source.now(), "entry_count": was.get("entry_count", 0) + 1})
        return {"id": entry["id"], "action": "superseded" if targets else "created", "superseded": targets, "similarity": similarity, "warning": warning}

    def write_batch(self, writes: DataFrame) -> DataFrame:
        """Writes entries as ``write`` would one by one, in the order of seq: seq, id, action, superseded, similarity, warning.

        writes(seq long, content string, kind string, tags array<string>, supersedes array<string>): seq is unique and from 0 to
        2^44 - 1. Null content is empty, a null kind the default, null lists are empty; an unknown kind or a wrong seq is an error
        before anything is written. Targets are ids that the index has; others give a warning. All entries make one segment and
        one version: readers see all or none. Files are written by tasks, under names that hold when a task runs again.
        """
        kind = F.lower(F.coalesce("kind", F.lit(DEFAULT_KIND)))
        asked = writes.select("seq", F.coalesce("content", F.lit("")).alias("body"), kind.alias("kind"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tags", "supersedes")))
        for row in asked.where(~F.col("kind").isin(*KINDS)).limit(1).collect():
            raise ValueError(f"unknown kind: {row['kind']}")
        wrong = F.col("seq").isNull() | ~F.col("seq").between(0, 2**44 - 1) | (F.col("n") > 1)
        for row in asked.groupBy("seq").agg(F.count("*").alias("n")).where(wrong).limit(1).collect():
            raise ValueError(f"seq is not unique or out of range: {row['seq']}")
        at, staging = self.index.snapshot(), f"{self.index.folder}/staging/{uuid.uuid4().hex}"
        part = lambda places, digits: F.lpad(F.lower(F.hex(F.shiftright("seq", places).bitwiseAND(16**digits - 1))), digits, "0")
        stamp, token = f"{time.time_ns() // 1_000_000:012x}", uuid.uuid4().hex[:7]
        # version 7 of UUIDs with seq as their counter: ids are in the order of the writes
        name = F.concat(F.lit(f"{stamp[:8]}-{stamp[8:]}-7"), part(32, 3), F.lit("-8"), part(20, 3), F.lit("-"), part(0, 5), F.lit(token))
        body = F.regexp_replace("body", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
        asked = asked.select("seq", name.alias("id"), F.lit(source.now()).alias("created_at"), "kind", "supersedes", "tags", body.alias("body"))
        try:
            asked.withColumn("embedding", self.embed(F.when(F.col("body") != "", F.col("body")))).write.parquet(f"{staging}/asked")
            asked = self.spark.read.parquet(f"{staging}/asked")
            if at.segments:
                live, known = self._vectors(at).select("chunk_id", "entry_id", "embedding"), self._entries(at).select("id")
            else:
                live, known = self.spark.createDataFrame([], "chunk_id string, entry_id string, embedding array<float>"), self.spark.createDataFrame([], "id string")
            found: list[DataFrame] = []

            def resolved(vectors: DataFrame) -> DataFrame:
                chunks = vectors.join(asked.select("seq", F.col("id").alias("entry_id")), "entry_id")
                found.append(batch.resolve(asked.select("seq", "id", "supersedes", "embedding"), chunks, live, self.config.search.dedup_threshold, f"{staging}/resolved"))
                return asked.drop("seq", "embedding", "supersedes").join(found[0].select("id", "supersedes"), "id").select("id", "created_at", "kind", "supersedes", "tags", "body")

            segment, tables, figures = self._written(asked.select("id", "created_at", "kind", "supersedes", "tags", "body"), resolved)
            named = asked.select("seq", F.explode("supersedes").alias("id"))
            missing = named.join(known, "id", "left_anti").groupBy("seq").agg(missing_warning(F.array_sort(F.collect_set("id"))).alias("warning"))
            said = found[0].join(missing, "seq", "left").select(
                "seq", "id", F.when(F.size("supersedes") > 0, "superseded").otherwise("created").alias("action"), F.col("supersedes").alias("superseded"), "similarity", "warning"
            )
            said = self.index.write(segment, {"written": said})["written"]  # beside the segment's tables, gone with them
            folder = self.entries_dir

            def write(parts):
                for rows in parts:
                    for row in rows.to_dict("records"):
                        source.write_entry(folder, row | {"supersedes": list(row["supersedes"]), "tags": list(row["tags"])})
                    yield pd.DataFrame({"n": [len(rows)]})

            n = tables["entries"].mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if n:
                self.index.add(segment, tables, figures, meta=lambda was: {"last_ingest": source.now(), "entry_count": was.get("entry_count", 0) + n})
            return said
        finally:
            fs, path = self.index._file(staging)
            fs.delete(path, True)

    def compact(self) -> Snapshot:
        """Writes what is visible as one segment in the place of all; what is written meanwhile stays beside it."""
        while True:
            at = self.index.snapshot()
            if len(at.segments) < 2:
                return at
            docs = at.visible(at.table("docs")).drop("version", "doc", "dl")
            entries = self._entries(at).drop("version")
            others = {"entries": entries, "vectors": at.visible(at.table("vectors")).drop("version")}
            if stream := maintenance.stream_of(at):
                others |= {"links": maintenance.last_links(at), "skipped": at.table("skipped").drop("version")}
            name, tables, figures = postings.write_index(self.index, docs, entries.select(F.col("id").alias("entry_id")), others)
            figures |= {"stream": stream} if stream else {}
            try:
                return self.index.compacted(name, tables, figures, of=at)
            except Conflict:
                continue

    def status(self, traces: int = 5) -> DataFrame:
        """One row of counts, with whether files and index have drifted apart, and the last spans."""
        at = self.index.snapshot()
        one = self.spark.range(1).withColumn("bm25_docs", F.lit(int(at.total("chunks"))))
        counts = {"vector_count": lambda: at.visible(at.table("vectors")), "entry_count": lambda: self._entries(at), "superseded_count": lambda: self._superseded(at)}
        for name, table in counts.items():
            one = one.crossJoin(table().agg(F.count("*").alias(name))) if at.segments else one.withColumn(name, F.lit(0).cast("long"))
        recent = self.traces(traces).agg(F.collect_list(F.struct("name", "elapsed_ms", "timestamp_ns")).alias("recent_traces"))
        return one.drop("id").select(
            "*", F.lit(at.meta.get("last_ingest")).alias("last_ingest"), F.lit(self._files() != at.meta.get("entry_count", 0)).alias("stale"), F.lit(self.folder).alias("storage_path")
        ).crossJoin(recent)

    def traces(self, limit: int = 10, span_filter: str | None = None) -> DataFrame:
        return recent_traces(read_lines(self.spark, f"{self.folder}/traces.jsonl"), limit, span_filter)

    def log(self, name: str, started: float, **attributes: str) -> None:
        """Appends a span to the trace log; a log above the limit is set aside first."""
        from lorekeep.sources.traces import ROTATE_BYTES

        path = Path(self.folder, "traces.jsonl")
        if path.exists() and path.stat().st_size > ROTATE_BYTES:
            os.replace(path, path.with_suffix(".jsonl.old"))
        span = {
            "traceId": uuid.uuid4().hex, "spanId": uuid.uuid4().hex[:16], "parentSpanId": "", "name": name, "startTimeUnixNano": int(started * 1e9),
            "endTimeUnixNano": time.time_ns(), "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in attributes.items()], "status": {"code": "OK", "message": ""},
        }
        with path.open("a") as f:
            f.write(json.dumps(span) + "\n")
