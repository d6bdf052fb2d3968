"""The versioned index against a plain scan, with writers at once, deletes, compaction and vacuum."""

import itertools
import math
import random
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import postings, querylang
from lorekeep.operators.postings import Search
from lorekeep.operators.querylang import Group, Leaf, QueryError, parse
from lorekeep.sources.segments import Conflict, Segments

CHUNKS = "chunk_id string, entry_id string, kind string, text string"
KINDS = ("decision", "learning")


def made(n, seed=1, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    return [(f"{first + i}:0", str(first + i), KINDS[i % 2], " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(n)]


def add(log, rows, deletes=(), replaces=None):
    spark = log.spark
    gone = spark.createDataFrame([(d,) for d in deletes], "entry_id string")
    return log.add(*postings.write_index(log, spark.createDataFrame(rows, CHUNKS).repartition(2), gone), replaces=replaces)


def plain(live, every, node, k, kind=None):
    """Scores by a scan; every: all rows that the statistics count."""
    tokens = {c: re.findall(r"[a-z0-9]+", t.lower()) for c, _, _, t in every}
    n, mean = len(every), sum(map(len, tokens.values())) / len(every)
    df = Counter(t for ts in tokens.values() for t in set(ts))

    def tf(leaf, ts):
        m = len(leaf.terms)
        return 1 if not m else sum(tuple(ts[i : i + m]) == leaf.terms for i in range(len(ts) - m + 1))

    def value(node, ts):
        if isinstance(node, Leaf):
            f = tf(node, ts)
            if not node.terms:
                return node.boost
            idf = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in node.terms)
            return node.boost * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / mean)) if f else None
        must, should, never = ([value(p, ts) for p in ps] for ps in (node.must, node.should, node.never))
        if None in must or any(v is not None for v in never) or not must and all(v is None for v in should):
            return None
        return node.boost * sum(v for v in must + should if v is not None)

    found = [(round(v, 9), c) for c, _, own, _ in live if (v := value(node, tokens[c])) is not None and kind in (None, own)]
    return [(c, s) for s, c in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def found(search):
    return [(r.chunk_id, round(r.score, 9)) for r in search.top().orderBy("rn").collect()]


def same(got, want):
    assert [c for c, _ in got] == [c for c, _ in want] and all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want, strict=True))


QUERIES = ["w0", "w20 w25 w3", '"w0 w1"', "+w3 -w0 w1^2", "(w1 AND w2) OR w29", '+"w0 w0" w5', "w1 AND NOT w0", "* -w0", "nowhere", "w7-w0", "body:w4 (+w2 -w1)^3", ""]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    log = Segments(spark, f"file://{tmp_path_factory.mktemp('index')}")
    add(log, made(900))
    add(log, made(60, 2, 900) + made(40, 3, 100), deletes=[str(i) for i in range(300, 340)])  # entries 100 to 139 are written anew
    return log


@pytest.fixture(scope="module")
def rows():
    new = made(60, 2, 900) + made(40, 3, 100)
    old = [r for r in made(900) if int(r[1]) not in {*range(100, 140), *range(300, 340)}]
    return old + new, made(900) + new


@pytest.mark.parametrize("query", QUERIES)
def test_against_a_scan(log, rows, query):
    live, every = rows
    node = parse(query)
    # replaced chunks count in the statistics until they are compacted
    stats = [(f"{i}", *r[1:]) for i, r in enumerate(every)]
    named = {r: s[0] for r, s in zip(every, stats, strict=True)}
    want = plain([(named[r], *r[1:]) for r in live], stats, node, 10)
    back = {s[0]: r[0] for r, s in zip(every, stats, strict=True)}
    want = sorted(((back[c], s) for c, s in want), key=lambda x: (-x[1], x[0]))
    got = found(Search(log.snapshot(), query, 10))
    assert [round(s, 7) for _, s in got] == [round(s, 7) for _, s in want]
    at_the_edge = {round(s, 7) for _, s in got[-1:]}
    assert {c for c, s in got if round(s, 7) not in at_the_edge} == {c for c, s in want if round(s, 7) not in at_the_edge}


def test_fewer_blocks_are_read_with_the_same_result(spark, tmp_path):
    log = Segments(spark, f"file://{tmp_path}/i")
    rng = random.Random(4)
    # most chunks have the common term once in a long text; few, close together, have the rare one
    rows = [(f"{i:05d}:0", str(i), "learning", "common " + " ".join(f"x{rng.randint(0, 50)}" for _ in range(20)) + (" rare rare" if 5000 <= i < 5030 else "")) for i in range(8192)]
    log.add(*postings.write_index(log, spark.createDataFrame(rows, CHUNKS).coalesce(1)))
    search = Search(log.snapshot(), "rare common", 10)
    same(found(search), plain(rows, rows, parse("rare common"), 10))
    every, kept = (df.agg(F.sum("asked")).first()[0] for df in (search.ranges, search.kept))
    assert every == 33 and kept == 2, (every, kept)
    only = Search(log.snapshot(), "+rare +common", 10)
    assert only.ranges.count() == 1


def test_filters_hold_before_the_cut(log, rows):
    keep = lambda df: df.where(F.col("kind") == "decision")
    got = Search(log.snapshot(), "w0 w1", 25, keep).top().collect()
    assert len(got) == 25 and {r.kind for r in got} == {"decision"}
    all_ = Search(log.snapshot(), "w0 w1", 2000).top().where("kind = 'decision'").orderBy("rn").limit(25).collect()
    assert [r.chunk_id for r in got] == [r.chunk_id for r in all_]


def test_compaction_and_old_versions(spark, tmp_path):
    log = Segments(spark, f"file://{tmp_path}/i")
    assert log.snapshot().version == 0 and found(Search(log.snapshot(), "w0", 5)) == []
    add(log, made(200))
    before = log.snapshot()
    add(log, made(20, 5, 50), deletes=["7"])
    live = [r for r in made(200) if r[1] != "7" and not 50 <= int(r[1]) < 70] + made(20, 5, 50)
    base = log.snapshot()
    written = postings.write_index(log, base.visible(base.table("docs")).select("chunk_id", "entry_id", "kind", "text"))
    late = made(5, 6, 60)
    add(log, late)  # between reading and committing
    log.compacted(*written, of=base)
    with pytest.raises(Conflict):
        log.compacted(*written, of=base)
    assert len(log.snapshot().segments) == 2
    live = [r for r in live if not 60 <= int(r[1]) < 65]
    got = {r.chunk_id for r in Search(log.snapshot(), "*", 1000).top().collect()}
    assert got == {r[0] for r in live + late}
    same(found(Search(before, "w3 w4", 10)), plain(made(200), made(200), parse("w3 w4"), 10))
    gone = log.vacuum(grace=0)
    assert len(gone) == 2 and log.versions() == [log.snapshot().version]
    assert {r.chunk_id for r in Search(log.snapshot(), "*", 1000).top().collect()} == got
    with pytest.raises(KeyError):
        log.snapshot(1)
    log.clear()
    assert found(Search(log.snapshot(), "w0", 5)) == []
    assert len(log.vacuum(grace=3600)) == 0 and len(log.vacuum(grace=0)) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log = Segments(spark, f"file://{tmp_path}/i")
    failed = []

    def write(i):
        try:
            for j in range(4):
                log.add(f"s{i}-{j}", {}, {"chunks": 1})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    last = log.snapshot()
    assert last.version == 20 and {s["name"] for s in last.segments} == {f"s{i}-{j}" for i, j in itertools.product(range(5), range(4))}
    assert [s["version"] for s in last.segments] == list(range(1, 21)) and last.total("chunks") == 20


def test_parser():
    a, b, c = (Leaf((x,)) for x in "abc")
    assert parse("a") == a and parse("A b") == Group((), (a, b)) and parse('"a b"^2') == Leaf(("a", "b"), 2.0)
    assert parse("+a b -c") == Group((a,), (b,), (c,))
    assert parse("a AND b OR c") == Group((), (Group((a, b)), c)) == parse("(a AND b) c")
    assert parse("a OR b AND NOT c") == Group((), (a, Group((b,), (), (c,))))
    assert parse("a AND b AND c") == Group((a, b, c))
    assert parse("x-y") == Leaf(("x", "y")) and parse("body:a") == a and parse('body:"a b"') == Leaf(("a", "b"))
    assert parse("") == parse(" ... ") == querylang.NOTHING
    assert parse("(a b)^2") == Group((), (a, b), (), 2.0) and parse("*") == Leaf(())
    assert parse("a" * 41) == querylang.NOTHING and parse("((a))") == a


@pytest.mark.parametrize("query", ['"a', "(a", "a)", "-a", "NOT a", "AND a", "a AND", "a AND OR b", "title:a", "a ^2 ^", "+(", "()-a", "(-a) b"])
def test_malformed(query):
    with pytest.raises(QueryError):
        parse(query)


def test_odd_chunks(spark, tmp_path):
    log = Segments(spark, f"file://{tmp_path}/i")
    rows = [("a:0", "a", None, None), ("b:0", "b", "k", ""), ("c:0", "c", "k", "x " * 3000), ("d:0", "d", "k", "x y"), ("d:0", "d", "k", "x y")]
    add(log, rows)
    assert [c for c, _ in found(Search(log.snapshot(), "y", 9))] == ["d:0", "d:0"]
    assert len(found(Search(log.snapshot(), "*", 9))) == 5
    add(log, [])
    assert len(found(Search(log.snapshot(), '"x x"', 9))) == 1
