"""The knowledge base's tables over the star of test tables: documents are entries and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import chunk_id, iso_time, search_terms
from lorekeep.functions.vectors import cosine
from lorekeep.operators import bm25, postings, retrieval, supersede
from lorekeep.schema import KINDS
from lorekeep.session import shared_folder, ship
from lorekeep.sources.segments import Segments, Snapshot

#: Terms of the standing keyword query.
QUERY = "erin thing ndea the schung"
QUERY_TERMS = QUERY.split()
CANDIDATES, RRF_K, LIMIT, BUDGET = 50, 30, 5, 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(doc_id) -> F.Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (doc_id % 4 + 1).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, created_at, kind, supersedes, tags, body; a later exact copy supersedes the first of its texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # joined by digest: texts themselves are not shuffled for it, copies are aggregated first
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    docs = docs.withColumn("digest", F.sha2("text", 256)).join(first, "digest", "left")
    none = F.array().cast("array<string>")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), iso_time(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), kind_of(F.col("doc_id")).alias("kind"),
        F.when(F.col("first") < F.col("doc_id"), F.array(F.col("first").cast("string"))).otherwise(none).alias("supersedes"),
        F.array("lang", "source").alias("tags"), F.col("text").alias("body"),
    )


def linked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with chains, mutual pairs, self references and missing targets, by doc_id modulo 50."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    at, s = F.col("doc_id") % 50, lambda c: F.array(c.cast("string"))
    links = (
        F.when(at == 0, s(F.col("doc_id") + 1)).when(at == 1, s(F.col("doc_id") - 1)).when(at == 5, s(F.col("doc_id"))).when(at == 7, s(F.col("doc_id") + 1_000_000_000))
        .when(at.between(10, 13), s(F.col("doc_id") - 1)).otherwise(F.array().cast("array<string>"))
    )
    return d.select(F.col("doc_id").cast("string").alias("id"), iso_time(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), kind_of(F.col("doc_id")).alias("kind"), links.alias("supersedes"))


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersede.superseded_ids(entries(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per entry: chunk_id, entry_id, kind, text."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    return d.select(chunk_id(i, F.lit(0)).alias("chunk_id"), i.alias("entry_id"), kind_of(F.col("doc_id")).alias("kind"), "text")


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).join(superseded(spark, sf_dir).select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, entry_id, kind, embedding; every 9th vector has no kind, every 13th one that is unknown."""
    v = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id").cast("string")
    kind = F.when(F.col("vec_id") % 9 == 8, F.lit(None)).when(F.col("vec_id") % 13 == 12, "draft").otherwise(kind_of(F.col("vec_id")))
    return v.select(chunk_id(i, F.lit(0)).alias("chunk_id"), i.alias("entry_id"), kind.alias("kind"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def with_similarity(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = vectors(spark, sf_dir) if rows is None else rows
    return rows.crossJoin(F.broadcast(query_vector(spark, sf_dir))).withColumn("sim", cosine(F.col("embedding"), F.col("q"))).drop("q", "embedding")  # one row


def live_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).join(superseded(spark, sf_dir).select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def keyword_scores(spark: SparkSession, sf_dir: str, allowed: DataFrame | None = None) -> DataFrame:
    c = chunks(spark, sf_dir)
    asked = c.select("chunk_id", F.explode(search_terms(F.col("text"))).alias("term")).where(F.col("term").isin(*QUERY_TERMS))
    return bm25.score(asked.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")), bm25.lengths(c), QUERY_TERMS, allowed)


_INDEXES: dict[tuple[str, str], Segments] = {}


def index(spark: SparkSession, sf_dir: str) -> Segments:
    """The keyword index of the chunks, made by the application's first query that asks for it: a segment of nine tenths, one
    of the rest, and one that deletes superseded entries."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        log, every = Segments(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), chunks(spark, sf_dir)
        late = F.col("entry_id").cast("long") % 10 == 9
        log.add(*postings.write_index(log, every.where(~late)))
        log.add(*postings.write_index(log, every.where(late)))
        gone = superseded(spark, sf_dir).select(F.col("id").alias("entry_id"))
        name = uuid.uuid4().hex
        log.add(name, log.write(name, {"ids": gone}), {})
        _INDEXES[key] = log
    return _INDEXES[key]


def all_chunks(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The index before anything was deleted."""
    return index(spark, sf_dir).snapshot(2)


def live(spark: SparkSession, sf_dir: str) -> Snapshot:
    return index(spark, sf_dir).snapshot()


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: chunk_id, rrf, rn."""
    keyword = postings.Search(live(spark, sf_dir), QUERY, CANDIDATES).top()
    near = retrieval.top_k(with_similarity(spark, sf_dir, live_vectors(spark, sf_dir)), "sim", CANDIDATES)
    return retrieval.top_k(retrieval.fuse([keyword, near], RRF_K), "rrf", CANDIDATES)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with text; entry_id is shared by runs of ids, so that entries have several chunks."""
    found = fused(spark, sf_dir).join(chunks(spark, sf_dir), "chunk_id")
    return found.withColumn("entry_id", F.floor(F.col("entry_id").cast("long") / 8).cast("string"))


#: The same tables in SQL; parts that a query doesn't name are not run.
PRELUDE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, text, lang, source, ['decision','learning','instruction','reference'][(doc_id % 4 + 1)::INT] AS kind, CAST(doc_id AS VARCHAR) AS id,
    strftime(to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
entries AS (SELECT id, created_at, kind, CASE WHEN f.first < d.doc_id THEN [CAST(f.first AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS supersedes, [lang, source] AS tags, d.text AS body
    FROM docs d LEFT JOIN firsts f ON d.text = f.text),
linked AS (SELECT id, created_at, kind, CASE WHEN doc_id % 50 = 0 THEN [CAST(doc_id + 1 AS VARCHAR)] WHEN doc_id % 50 = 1 THEN [CAST(doc_id - 1 AS VARCHAR)] WHEN doc_id % 50 = 5 THEN [id]
    WHEN doc_id % 50 = 7 THEN [CAST(doc_id + 1000000000 AS VARCHAR)] WHEN doc_id % 50 BETWEEN 10 AND 13 THEN [CAST(doc_id - 1 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS supersedes FROM docs),
ledges AS (SELECT DISTINCT id AS src, unnest(supersedes) AS dst, created_at FROM linked),
lwinners AS (SELECT DISTINCT x.src AS id FROM ledges x JOIN ledges y ON x.src = y.dst AND x.dst = y.src AND x.created_at >= y.created_at),
superseded AS (SELECT DISTINCT unnest(supersedes) AS id FROM entries),
chunks AS (SELECT id || ':0' AS chunk_id, id AS entry_id, kind, text FROM docs),
live_chunks AS (SELECT * FROM chunks WHERE entry_id NOT IN (SELECT id FROM superseded)),
toks AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: strlen(t) <= 40) AS ts FROM chunks),
lens AS (SELECT chunk_id, len(ts)::BIGINT AS dl FROM toks),
posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
asked AS (SELECT * FROM posts WHERE term IN ('erin', 'thing', 'ndea', 'the', 'schung')),
dfs AS (SELECT term, count(*) AS df FROM asked GROUP BY term),
bm AS (SELECT a.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
    FROM asked a JOIN dfs USING (term) JOIN lens USING (chunk_id) CROSS JOIN corpus GROUP BY a.chunk_id),
live_bm AS (SELECT bm.* FROM bm JOIN live_chunks USING (chunk_id)),
vecs AS (SELECT CAST(vec_id AS VARCHAR) || ':0' AS chunk_id, CAST(vec_id AS VARCHAR) AS entry_id, vec_id,
    CASE WHEN vec_id % 9 = 8 THEN NULL WHEN vec_id % 13 = 12 THEN 'draft' ELSE ['decision','learning','instruction','reference'][(vec_id % 4 + 1)::INT] END AS kind, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q0 AS (SELECT v AS q FROM vecs WHERE vec_id = 0),
sims AS (SELECT chunk_id, entry_id, vec_id, kind, CASE WHEN list_dot_product(v, v) = 0 OR list_dot_product(q, q) = 0 THEN 0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END AS sim FROM vecs CROSS JOIN q0),
live_sims AS (SELECT * FROM sims WHERE entry_id NOT IN (SELECT id FROM superseded)),
kw AS (SELECT chunk_id, bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, chunk_id) AS rn FROM live_bm QUALIFY rn <= 50),
near AS (SELECT chunk_id, sim, row_number() OVER (ORDER BY round(sim, 9) DESC, chunk_id) AS rn FROM live_sims QUALIFY rn <= 50),
rrf AS (SELECT chunk_id, sum(1.0::DOUBLE / (30 + rn)) AS rrf FROM (SELECT chunk_id, rn FROM kw UNION ALL SELECT chunk_id, rn FROM near) GROUP BY chunk_id),
fused AS (SELECT chunk_id, rrf, row_number() OVER (ORDER BY round(rrf, 9) DESC, chunk_id) AS rn FROM rrf QUALIFY rn <= 50),
cand AS (SELECT f.chunk_id, rrf, rn, CAST(CAST(entry_id AS BIGINT) // 8 AS VARCHAR) AS entry_id, kind, text FROM fused f JOIN chunks USING (chunk_id)),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY round(rrf, 9) DESC, rn) = 1),
final AS (SELECT chunk_id, entry_id, kind, rrf, text, row_number() OVER (ORDER BY round(rrf, 9) DESC, chunk_id) AS rn FROM best),
costed AS (SELECT *, CAST(trunc(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.33) AS BIGINT) AS est FROM final),
budgeted AS (SELECT * FROM costed QUALIFY row_number() OVER (ORDER BY rn) = 1 OR sum(est) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) <= 12000)
"""
