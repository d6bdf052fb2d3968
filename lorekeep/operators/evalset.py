"""Preparation and checks of evaluation sets."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.text import normalize_for_match, query_id, trimmed
from lorekeep.session import in_small_batches

#: Shorter contexts are not matched; a fixed value.
MIN_MATCH_CHARS = 40
#: Queries of each type, and the kinds they aim at; fixed values.
QUERY_TYPES = {"lookup": 6, "multi-hop": 6, "reasoning": 4, "cross-kind": 4}
TARGET_KINDS = ("learning", "reference", "decision", "instruction", "mixed")
#: Bytes of contexts that are sought at once; bodies of a batch that are Python strings at once.
BLOCK_BYTES, BODIES = 16 << 20, 64


def match_contexts(contexts: DataFrame, entries: DataFrame, min_chars: int = MIN_MATCH_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """contexts(context_id, context), entries(id, body) -> context_id, ids (sorted), method.

    A context is sought in bodies as it is, and with white space made single. The contexts are dealt into blocks of bounded
    bytes; an automaton of all strings of a block runs once over each body, in the body's own partition, whatever the
    contexts' lengths; bodies are read once a block and never shuffled.
    """
    contexts, entries = in_small_batches(contexts), in_small_batches(entries)  # the result is of the session of the first
    needle = contexts.withColumn("needle", trimmed(F.col("context"))).withColumn("flat", normalize_for_match(F.col("needle")))
    asked = needle.where(F.length("needle") >= min_chars).select("context_id", "needle", "flat")
    bodies = entries.select("id", "body", normalize_for_match(F.col("body")).alias("flat_body")).where("flat_body is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("needle") + F.octet_length("flat")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    kinds = dict(contexts.dtypes)["context_id"], dict(entries.dtypes)["id"]
    found = contexts.sparkSession.createDataFrame([], f"context_id {kinds[0]}, id {kinds[1]}, exact boolean")
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("context_id", "flat"), F.lit(blocks)) == i).collect()  # block_bytes, about
        if block:
            found = found.unionByName(_matches(bodies, block, kinds))
    hits = found.groupBy("context_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("id")))).alias("exact"), F.array_sort(F.collect_set("id")).alias("normal")
    )
    ids = F.when(F.size("exact") > 0, F.col("exact")).when(F.size("normal") > 0, F.col("normal")).otherwise(F.array().cast(f"array<{kinds[1]}>"))
    method = (
        F.when(F.col("needle") == "", "none").when(F.length("needle") < min_chars, "too_short")
        .when(F.size("exact") > 0, "exact").when(F.size("normal") > 0, "normalized").otherwise("none")
    )
    return needle.join(hits, "context_id", "left").select("context_id", F.coalesce(ids, F.array().cast(f"array<{kinds[1]}>")).alias("ids"), method.alias("method"))


def _matches(bodies: DataFrame, block: list, kinds: tuple[str, str]) -> DataFrame:
    """context_id, id, exact: the bodies(id, body, flat_body) that hold a context of the block."""
    of: dict[str, list] = {}
    for r in block:
        of.setdefault(r.flat, []).append((r.context_id, r.needle))
    shared = bodies.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        of = shared.value
        automaton = ahocorasick.Automaton()
        for flat in of:
            automaton.add_word(flat, flat)
        automaton.make_automaton()
        for batch in (b.slice(at, BODIES) for b in batches for at in range(0, b.num_rows, BODIES)):
            rows = []
            for i, body, flat_body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), batch.column("flat_body").to_pylist(), strict=True):
                for flat in {f for _, f in automaton.iter(flat_body)}:
                    rows += [(context_id, i, needle in body) for context_id, needle in of[flat]]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((types[0], types[1], pa.bool_()))]
            yield pa.record_batch(columns, ["context_id", "id", "exact"])

    schema = f"context_id {kinds[0]}, id {kinds[1]}, exact boolean"
    types = [f.type for f in to_arrow_schema(bodies.sparkSession.createDataFrame([], schema).schema)]
    return bodies.mapInArrow(run, schema)


def testset_rows(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """samples(query, reference_answer, reference_contexts, query_type, persona_name, query_style, query_length) -> rows
    of the evaluation set: with their id, the entries that the contexts come from, and how each was matched."""
    samples = in_small_batches(samples).withColumn("query_id", query_id(F.col("query"), F.col("reference_answer")))
    asked = samples.select("query_id", F.posexplode("reference_contexts").alias("at", "context")).dropDuplicates(["query_id", "at"])
    asked = asked.withColumn("context_id", F.concat_ws("/", "query_id", "at"))
    found = asked.join(match_contexts(asked.select("context_id", "context"), entries), "context_id")
    parts = F.array_sort(F.collect_list(F.struct("at", "method", "ids")))
    of = found.groupBy("query_id").agg(parts.alias("parts")).select(
        "query_id", F.array_sort(F.array_distinct(F.flatten("parts.ids"))).alias("source_entry_ids"), F.col("parts.method").alias("match_methods")
    )
    none = F.array().cast("array<string>")
    return samples.join(of, "query_id", "left").select(
        F.lit(1).alias("schema_version"), "query_id", "query", "reference_answer", "reference_contexts",
        F.coalesce("source_entry_ids", none).alias("source_entry_ids"), "query_type",
        F.struct("persona_name", "query_style", "query_length", F.coalesce("match_methods", none).alias("match_methods")).alias("ragas_metadata"),
    )


def corpus_hash(entries: DataFrame) -> DataFrame:
    """One row: sha256 of the sorted lines ``id:sha256(body)``."""
    return _digest(entries.select(F.concat_ws(":", "id", F.sha2("body", 256)).alias("line")), b"\n", "corpus_hash")


def _digest(lines: DataFrame, between: bytes, name: str) -> DataFrame:
    """sha256 of all lines in order, the bytes ``between`` them. Partitions are sorted by range; the digest, which has to be
    taken in one row, reads them one after the other and holds a batch."""

    def run(batches):
        digest, first = hashlib.sha256(), True
        for batch in batches:
            for line in batch.column("line").to_pylist():
                if line is not None:
                    digest.update((b"" if first else between) + line.encode())
                    first = False
        yield pa.record_batch([pa.array([digest.hexdigest()])], [name])

    return lines.orderBy("line").coalesce(1).mapInArrow(run, f"{name} string")


def snapshot_hash(files: DataFrame) -> DataFrame:
    """files(path, content) -> one row: sha256 over the lines ``path<TAB>sha256`` in order of path."""
    return _digest(files.select(F.concat(F.col("path"), F.lit("\t"), F.sha2("content", 256), F.lit("\n")).alias("line")), b"", "snapshot_hash")


#: Of a set's header: the form of each value; fixed.
HEADER = {
    "schema_version": lambda v: v == 1,
    "created_at": lambda v: bool(re.fullmatch(r"\d{4}-\d\d-\d\d", str(v))),
    "corpus_snapshot_hash": lambda v: bool(re.fullmatch(r"sha256:[0-9a-f]{64}", str(v))),
    "corpus_entry_count": lambda v: isinstance(v, int) and v > 0,
}
#: Queries that each target kind needs; a fixed value.
LEAST_PER_KIND = 2

#: Rules on a query joined with what is known of its entries: where one holds, its code is reported.
_RULES = {
    "incomplete": lambda: F.exists(F.array(*[F.col(c).isNull() for c in ("id", "query", "query_type", "target_kind", "notes")]), lambda x: x),
    "id-repeated": lambda: F.col("same_id") > 1,
    "query-repeated": lambda: F.col("same_query") > 1,
    "query-type-unknown": lambda: ~F.col("query_type").isin(*QUERY_TYPES),
    "target-kind-unknown": lambda: ~F.col("target_kind").isin(*TARGET_KINDS),
    "nothing-expected": lambda: F.coalesce(F.size("expected_entry_ids"), F.lit(0)) <= 0,
    "expected-repeated": lambda: F.size("expected_entry_ids") > F.size(F.array_distinct("expected_entry_ids")),
    "entry-missing": lambda: F.size("expected_entry_ids") > F.coalesce("n_found", F.lit(0)),
    "one-hop": lambda: (F.col("query_type") == "multi-hop") & (F.size("expected_entry_ids") < 2),
    "one-kind": lambda: (F.col("query_type") == "cross-kind") & (F.coalesce("n_kinds", F.lit(0)) < 2),
    "kind-not-mixed": lambda: (F.col("query_type") == "cross-kind") & (F.col("target_kind") != "mixed"),
}


def canary_errors(queries: DataFrame, entries: DataFrame, header: dict | None = None) -> DataFrame:
    """rule, subject: what is wrong with a canary set (id, query, expected_entry_ids, query_type, target_kind, notes) and its header.

    The subject is a query's id, a stratum or a header key. Rules that a null keeps from being decided report nothing.
    """
    spark = queries.sparkSession
    numbered = queries.withColumn("row", F.monotonically_increasing_id())
    of_id = queries.groupBy("id").agg(F.count("*").alias("same_id"))
    of_query = queries.groupBy(F.lower(F.trim("query")).alias("said")).agg(F.count("*").alias("same_query"))
    expected = queries.select("id", F.explode(F.array_distinct("expected_entry_ids")).alias("entry"))
    known = expected.join(entries.select(F.col("id").alias("entry"), "kind"), "entry").groupBy("id").agg(F.count_distinct("entry").alias("n_found"), F.count_distinct("kind").alias("n_kinds"))
    known = numbered.join(of_id, "id", "left").join(of_query, F.lower(F.trim("query")) == F.col("said"), "left").join(known, "id", "left")
    broken = F.array_compact(F.array(*[F.when(rule(), code) for code, rule in _RULES.items()]))
    found = known.select(F.explode(broken).alias("rule"), F.coalesce("id", F.col("row").cast("string")).alias("subject")).distinct()
    for column, code, least in (("query_type", "stratum-size", QUERY_TYPES), ("target_kind", "kind-floor", dict.fromkeys(TARGET_KINDS, LEAST_PER_KIND))):
        want = spark.createDataFrame(list(least.items()), f"{column} string, want long").join(queries.groupBy(column).agg(F.count("*").alias("got")), column, "left")
        got = F.coalesce("got", F.lit(0))
        off = got != F.col("want") if code == "stratum-size" else got < F.col("want")
        found = found.unionByName(want.where(off).select(F.lit(code).alias("rule"), F.col(column).alias("subject")))
    size = queries.agg(F.count("*").alias("n")).where(F.col("n") != sum(QUERY_TYPES.values()))
    found = found.unionByName(size.select(F.lit("set-size").alias("rule"), F.col("n").cast("string").alias("subject")))
    bad = [k for k, fits in HEADER.items() if k not in header or not fits(header[k])] if header is not None else []
    return found.unionByName(spark.createDataFrame([("header", k) for k in bad], "rule string, subject string"))


def parse_distribution(spec: str, allowed: tuple[str, ...]) -> dict[str, float]:
    """``k=v,k=v`` with known, distinct names that sum to 1 within 0.01."""
    found: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, eq, value = part.partition("=")
        name = name.strip()
        if not eq or name in found or name not in allowed:
            raise ValueError(f"bad share {part!r}")
        found[name] = float(value)
    if abs(sum(found.values()) - 1) > 0.01:
        raise ValueError(f"shares sum to {sum(found.values())}, not 1")
    return found
