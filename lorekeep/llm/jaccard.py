"""Similarity join of word 5-shingle sets (Jaccard >= 0.8) by adaptive multi-match prefixes.

Of equal texts one is compared. A set's shingles are ordered from rare to frequent. If two sets overlap
enough, then for every l >= 1 the first l shingles they share stand in the first
|x| - ceil(0.8 |x|) + l places of either; so a set may choose its l, up to the ceil(0.8 |x|) that
it must share with any partner: a longer prefix has more postings to read, but its partners must
share l of them. Each set takes the l of least estimated cost, from the frequencies in its prefix;
a pair is held to the smaller l of its two.

Frequencies are exact over all documents. Blocks of documents send their distinct shingles, packed
and with counts, to the bucket of the shingle, so that a bucket meets a hot shingle once for each
block; it sends back to each block those that several documents have, with their number. A shingle
of one document only can have no partner, counts in no overlap and is not kept: a set is its shared
shingles and its size. A posting goes where no set of its shingle has a size that could fit.

The result is classes, not pairs. So near copies are first joined to a leader, the set of fewest
shingles of its own among those with a shingle; sets with the same leader are a family. Then only
shingles with sets of several classes ask on, and they ask for pairs of families: two families (or
one with itself, if it has several classes) are compared in chunks of bounded size, where sets of
different classes that share enough prefix shingles are verified on the whole sets. A group of
copies, linked or just not alike enough to link, so makes no row for each of its pairs, and chunks
of a family's main class are not compared with each other.

Shingles are 64-bit hashes; a collision between two of the corpus's shingles could change one
overlap by one. Texts are taken as equal by their SHA-256.

Defined results: a null or blank text has no shingles and is linked with nothing; fewer than five
words are one shingle; a text of any length is read whole; repeated ids are repeated rows, in the
class of each one's text if ids repeat with other texts; rows without an id are counted and linked
with nothing; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, dropped, in_small_batches, packed, packed_sorted, raw_text, read, unpacked, unpacked_sorted, whole_id, words, working, written
from .components import components, roots

SHINGLE = 5
#: Links at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Cost of verifying a candidate, per shingle, in postings read.
VERIFY = 0.1
#: Characters of text in a block; bytes of text whose shingles a bucket takes.
BLOCK_CHARS, BUCKET_BYTES = 4 << 20, 8 << 20
#: Sets in a chunk of a family, columns of a matrix that are multiplied at once.
CHUNK, COLUMNS = 256, 4096
#: Odd factors of the words of a shingle.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_hashes = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    h = np.array(_hashes(words(text)), np.uint64)
    if len(h) < SHINGLE:
        return _mix((h * _FACTORS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))) if len(h) else h
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(_mix(total))


_PARTS = ("a", "b", "c", "d", "e", "f")
_CELLS = "bucket int, block string, of_block boolean, " + ", ".join(f"{c} binary" for c in _PARTS)
_NAMES = [c.split()[0] for c in _CELLS.split(", ")]


def _block(buckets: int, name: str, number: int, ids: list[tuple[int, bool]], texts: list) -> pd.DataFrame:
    """A block's own row - ids, sizes, digests, and shingles that several of its documents have, with counts and
    documents - and a row for each bucket: shingles, counts, and the document where that is one."""
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(x) for x in sets], np.int64)
    digests = b"".join(hashlib.sha256(raw_text(t, lower=False)).digest() for t in texts)
    sets = [x[:0] if unnamed else x for (_, unnamed), x in zip(ids, sets, strict=True)]  # without an id: linked with nothing
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sets])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(tokens))
    several = counts > 1
    local = np.repeat(several, counts)
    own = (packed(np.array(ids, np.int64).T.ravel()), packed(sizes), digests, packed_sorted(tokens[starts][several]), packed(counts[several].astype(np.uint32)), packed(owner[local]))
    rows = [(number % buckets, name, True, *own)]
    tokens, counts, owner = tokens[starts], counts.astype(np.uint32), np.where(several, 0, owner[starts]).astype(np.uint32)
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    at = np.append(np.searchsorted(tokens, edges), len(tokens))
    for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if j > i:
            rows.append((b, name, False, packed_sorted(tokens[i:j]), packed(counts[i:j]), packed(owner[i:j]), b"", b"", b""))
    return pd.DataFrame(rows, columns=_NAMES)


def _cells(buckets: int):
    """Rows of documents as blocks, dealt to the buckets of their shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("jaccard", _hashes.known.clear)
        at, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for *i, t in zip(batch.id.tolist(), batch.unnamed.tolist(), batch.text.tolist(), strict=True):
                ids.append(tuple(i))
                texts.append(t)
                size += len(t or "")
                if size >= BLOCK_CHARS:
                    yield _block(buckets, f"{at}-{number}", at + number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block(buckets, f"{at}-{number}", at + number, ids, texts)

    return run


def _shared(part: pd.DataFrame) -> pd.DataFrame:
    """A bucket's shingles that several documents have, for each block, with the documents' number; blocks' own rows pass."""
    cells = part[~part.of_block]
    rows = []
    if len(cells):
        tokens, counts = [unpacked_sorted(x) for x in cells.a], [unpacked(x, np.uint32) for x in cells.b]
        every = np.concatenate(tokens)
        order = np.argsort(every)
        starts = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        df = np.empty(len(every), np.int64)
        df[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts), np.diff(starts, append=len(every)))
        at = 0
        for x, token, count in zip(cells.itertuples(), tokens, counts, strict=True):
            n = df[at : at + len(token)]
            keep = n > 1
            at += len(token)
            if keep.any():
                rows.append((x.bucket, x.block, False, packed_sorted(token[keep]), packed(count[keep]), packed(unpacked(x.c, np.uint32)[keep]), packed(n[keep]), b"", b""))
    return pd.concat([part[part.of_block], pd.DataFrame(rows, columns=_NAMES)], ignore_index=True).astype({"of_block": bool})


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for x in batch.itertuples():
            ids, unnamed = unpacked(x.a, np.int64).reshape(2, -1)
            yield pd.DataFrame({"block": x.block, "place": np.arange(len(ids), dtype=np.int32), "id": pd.arrays.IntegerArray(ids.copy(), unnamed > 0), "n_shingles": unpacked(x.b, np.int64), "digest": [x.c[i : i + 32] for i in range(0, len(x.c), 32)]})


def prefix(df: np.ndarray, n: int) -> tuple[int, int]:
    """From ascending frequencies of a set's shared shingles: the l of least cost, and how many of them its prefix has."""
    alone = n - len(df)
    shared = (n * PERCENT + 99) // 100  # the least that a partner shares: no l may ask for more
    matches = np.arange(1, max(1, shared) + 1)
    reach = np.clip(matches + n - shared - alone, 0, len(df))
    reads = np.r_[0, np.cumsum(df - 1)][reach]
    cost = reads * (1 + VERIFY * n / matches)
    best = int(cost.argmin())
    return best + 1, int(reach[best])


_ACTIVE = "id long, n int, l int, alone int, prefix array<long>, tokens array<long>"


def _prefixes(own: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
    """The sets of a block that can have a partner: size, l, shingles of their own, prefix, and all shared shingles."""
    cells, rows = own[~own.of_block], []
    if len(cells):
        block = own[own.of_block].iloc[0]
        ids, sizes = unpacked(block.a, np.int64).reshape(2, -1)[0], unpacked(block.b, np.int64)
        tokens = np.concatenate([unpacked_sorted(x) for x in cells.a])
        several = np.concatenate([unpacked(x, np.uint32) for x in cells.b]) > 1
        owner = np.concatenate([unpacked(x, np.uint32) for x in cells.c])
        df = np.concatenate([unpacked(x, np.int64) for x in cells.d])
        # those that several documents of the block have are with the block
        local, times = unpacked_sorted(block.d), unpacked(block.e, np.uint32)
        order = np.argsort(tokens[several])
        of_local = df[several][order]  # all of them are shared, so they stand as in the block
        tokens, owner = np.append(tokens[~several], np.repeat(local, times)), np.append(owner[~several], unpacked(block.f, np.uint32))
        df = np.append(df[~several], np.repeat(of_local, times))
        held = np.bincount(owner, minlength=len(ids))
        can = (held * 100 >= sizes * PERCENT) & (sizes > 0)
        can[copies.place.to_numpy(np.int64)] = False
        keep = can[owner]
        tokens, owner, df = tokens[keep], owner[keep], df[keep]
        order = np.lexsort((tokens, df, owner))
        tokens, df = tokens[order].view(np.int64), df[order]
        at = 0
        for k in np.flatnonzero(can).tolist():
            n, m = int(sizes[k]), int(held[k])
            mine = tokens[at : at + m]
            least, reach = prefix(df[at : at + m], n)
            at += m
            if reach:
                rows.append((int(ids[k]), n, least, n - m, mine[:reach], mine))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ACTIVE.split(", ")])


def _enough(overlap, n, m):
    """Whether sets of these sizes with such an overlap are alike enough."""
    return overlap * (100 + PERCENT) >= (n + m) * PERCENT


def _can_overlap(n, n_alone, m, m_alone):
    """Whether they may be, by what of each set some other set has (their sizes fit then too)."""
    return _enough(n - n_alone, n, m) & _enough(m - m_alone, n, m)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    of = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("tokens").alias(f"{side}_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_enough(both, F.col("a_n"), F.col("b_n"))).select("a", "b")


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of these sets of distinct integers share."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(several.sum()), COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return out


def _compare(key, part):
    """Two chunks: the sets of different classes that share enough of their prefixes are verified; each linked set with its part's least."""
    part = part.sort_values("id", kind="stable")
    ids, n, least, own_class = (part[c].to_numpy() for c in ("id", "n", "l", "class"))
    ask = _in_common(part.prefix.tolist()) >= np.minimum(least[:, None], least[None, :])
    ask &= own_class[:, None] != own_class[None, :]
    alone = part.alone.to_numpy()
    ask &= _can_overlap(n[:, None], alone[:, None], n[None, :], alone[None, :])
    asked = np.flatnonzero(ask.any(1))
    if not len(asked):
        return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
    n, ids = n[asked], ids[asked]
    whole = _in_common([part.tokens.iloc[i] for i in asked])
    root = roots(ask[np.ix_(asked, asked)] & _enough(whole, n[:, None], n[None, :]))
    linked = root != np.arange(len(root))
    return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})


def _between_classes(postings: DataFrame, active: DataFrame, star: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) between classes of ``first``, of sets that share a posting's shingle."""
    classes = components(first)
    held = postings.select("token", "id").join(star.select(F.col("a").alias("id"), "b"), "id", "left").join(classes, "id", "left")
    held = written(held.select("token", "id", F.coalesce("b", "id").alias("family"), F.coalesce("component_id", "id").alias("class")), "held", let_go=False)
    mixed = held.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    held = written(held.join(mixed, "token"), "mixed", let_go=False)
    # families, in chunks: sets of the leader's class, and the others
    of_leader = classes.select(F.col("id").alias("family"), F.col("component_id").alias("main"))
    sets = held.select("id", "family", "class").distinct().join(of_leader, "family", "left")
    sets = sets.select("id", "family", "class", (F.col("class") != F.coalesce("main", "family")).cast("int").alias("other"))
    sizes = sets.groupBy("family", "other").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sets = sets.join(sizes, ["family", "other"]).select("id", "family", "class", F.struct("other", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("k")).alias("chunk"))
    sets = written(sets, "sets", let_go=False)
    chunks = written(sets.select("family", "chunk").distinct(), "chunks", let_go=False)
    named = lambda s: chunks.select(F.col("family").alias(f"f{s}"), F.col("chunk").alias(f"c{s}"))
    of_token = written(held.select("token", "family").distinct(), "families", let_go=False)
    x, y = (of_token.select("token", F.col("family").alias(f"f{s}")) for s in "xy")
    across = x.join(y, "token").where("fx < fy").select("fx", "fy").distinct().join(named("x"), "fx").join(named("y"), "fy")
    several = sets.groupBy("family").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select(F.col("family").alias("fx"))
    within = several.join(named("x"), "fx").join(named("y").withColumn("fx", F.col("fy")), "fx").where("cx <= cy and (cx.other = 1 or cy.other = 1)")
    columns = ["fx", "fy", "cx", "cy"]
    pairs = written(across.select(columns).unionByName(within.select(columns)), "pairs", let_go=False)
    # one row for each set and pair of chunks
    dealt = pairs.withColumn("side", F.explode(F.when((F.col("fx") == F.col("fy")) & (F.col("cx") == F.col("cy")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    dealt = dealt.select(*columns, F.when(F.col("side") == 0, F.col("fx")).otherwise(F.col("fy")).alias("family"), F.when(F.col("side") == 0, F.col("cx")).otherwise(F.col("cy")).alias("chunk"))
    dealt = dealt.join(sets, ["family", "chunk"]).select(*columns, "id", "class").join(active.select("id", "n", "l", "alone", "prefix", "tokens"), "id")
    found = written(dealt.groupBy(*columns).applyInPandas(_compare, "a long, b long"), "second")
    for table in (held, sets, chunks, of_token, pairs):
        dropped(table)
    return found


def near_classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = in_small_batches(docs).select(*whole_id("doc_id", "id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)
    shared = written(docs.mapInPandas(_cells(buckets), _CELLS).groupBy("bucket").applyInPandas(_shared, _CELLS), "shared")
    members = written(shared.where("of_block").select("block", "a", "b", "c").mapInPandas(_documents, "block string, place int, id long, n_shingles long, digest binary"), "members", let_go=False)
    # of each text that occurs again one document stays, with the least id
    again = members.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "block", "place")).alias("one"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select("digest", F.col("one.id").alias("first"), F.struct("one.block", "one.place").alias("one")), "again", let_go=False)
    copies = members.join(again, "digest").where(F.struct("block", "place") != F.col("one")).select("block", "place")
    active = written(shared.groupBy("block").cogroup(copies.groupBy("block")).applyInPandas(_prefixes, _ACTIVE), "active")
    dropped(shared)

    of_prefix = active.select("id", "n", "alone", F.explode("prefix").alias("token"))
    leaders = of_prefix.groupBy("token").agg(F.min(F.struct("alone", "id", "n")).alias("leader"), F.min("n").alias("least"), F.max("n").alias("most"))
    # a posting stays if the sizes of its shingle's sets leave room for a partner
    postings = of_prefix.join(leaders, "token").where(_enough(F.col("n") - F.col("alone"), F.col("n"), F.col("least")) & (F.col("n") * PERCENT <= 100 * F.col("most")))
    postings = written(postings.select("token", "id", "n", "alone", F.col("leader.id").alias("b"), F.col("leader.n").alias("m"), F.col("leader.alone").alias("other")), "postings")
    star = (
        postings.where((F.col("id") != F.col("b")) & _can_overlap(F.col("n"), F.col("alone"), F.col("m"), F.col("other")))
        .groupBy("id", "b").count().groupBy("id").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
        .select(F.col("id").alias("a"), "b")
    )
    star = written(star, "star", let_go=False)
    first = written(_alike(star, active), "first")
    second = _between_classes(postings, active, star, first)
    classes = components(first.unionByName(second))
    for table in (active, postings, star, first, second):
        dropped(table)
    found = members.join(again.select("digest", "first"), "digest", "left").withColumn("first", F.coalesce("first", "id"))
    found = found.join(classes.select(F.col("id").alias("first"), F.col("component_id").alias("class")), "first", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("class", "first")).otherwise(F.col("id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"))


def op8_jaccard_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
