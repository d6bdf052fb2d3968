"""The index maintained by a stream, against ingest of all files and against a loop over all entries."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from lorekeep.plans.knowledge import KnowledgeBase
from lorekeep.schema import ENTRIES
from lorekeep.sources.entries import write_entry
from lorekeep.sources.segments import Segments
from lorekeep.streaming import maintenance as m

WORDS = {"a": "rivers carry water", "b": "stones lie still", "c": "birds sing in spring", "d": "ships cross the sea", "e": "rivers freeze in winter"}


def entry(i, day, supersedes=(), body=None, kind="learning"):
    return {"id": i, "created_at": f"2024-01-{day:02}T00:00:00Z", "kind": kind, "supersedes": list(supersedes), "tags": [], "body": WORDS[i] if body is None else body}


def test_as_ingest(spark, tmp_path):
    streamed, whole = KnowledgeBase(spark, str(tmp_path / "streamed")), KnowledgeBase(spark, str(tmp_path / "whole"))
    # a and b supersede each other, the halves arrive apart; d names what comes later
    parts = [[entry("a", 2, ["b"]), entry("d", 4, ["e", "ghost"])], [entry("b", 1, ["a"]), entry("c", 3), entry("e", 5)]]
    checkpoint = str(tmp_path / "checkpoint")
    for n, part in enumerate(parts):
        for e in part:
            write_entry(streamed.entries_dir, e)
            write_entry(whole.entries_dir, e)
        if n:
            for kb in (streamed, whole):
                (tmp_path / kb.folder / "entries" / "bad.md").write_text("no front matter")
        m.maintain(streamed, checkpoint).awaitTermination()
        whole.ingest()
        ids = lambda kb: {r[0] for r in kb._superseded(kb.index.snapshot()).collect()}
        assert m.stream_of(streamed.index.snapshot()) and not m.stream_of(whole.index.snapshot())
        assert ids(streamed) == ids(whole) == [{"b", "e", "ghost"}, {"b", "e", "ghost"}][n]
        state, want = streamed.status().first(), whole.status().first()
        assert [state[c] for c in ("bm25_docs", "vector_count", "entry_count", "superseded_count", "stale")] == [want[c] for c in ("bm25_docs", "vector_count", "entry_count", "superseded_count", "stale")]
    found = lambda kb: [(r["id"], r["content"]) for r in kb.search("rivers OR birds OR stones")[0].collect()]
    assert sorted(found(streamed)) == sorted(found(whole)) and {i for i, _ in found(streamed)} == {"a", "c", "d"}
    assert [r["file"] for r in streamed.index.snapshot().table("skipped").collect()] == ["bad.md"]
    streamed.compact()
    assert m.stream_of(streamed.index.snapshot()) and ids(streamed) == ids(whole) and len(streamed.index.snapshot().segments) == 1
    # a newer version of d under another name takes back what the old one named
    newer = entry("d", 6, ["c"], "ships stay in port")
    (tmp_path / "streamed/entries/d-2.md").write_text((tmp_path / "streamed/entries/d.md").read_text())  # a repeated one changes nothing
    write_entry(str(tmp_path / "other"), newer)
    (tmp_path / "streamed/entries/d-3.md").write_text((tmp_path / "other/d.md").read_text())
    m.maintain(streamed, checkpoint).awaitTermination()
    assert ids(streamed) == {"b", "c"} and ("d", "ships stay in port") in streamed._entries(streamed.index.snapshot()).select("id", "body").collect()
    # a write beside the stream: its segment holds no links, so entries are asked
    done = streamed.write("something else entirely", supersedes=["d"])
    assert m.stream_of(streamed.index.snapshot()) is None and ids(streamed) == {"b", "c", "d"} and done["action"] == "superseded"


def brute(entries):
    """id -> the version that counts, and what is superseded."""
    last = {}
    for e in entries:
        if e["id"] is not None and (e["id"] not in last or (e["created_at"] or "") > last[e["id"]]["created_at"]):
            last[e["id"]] = e | {"created_at": e["created_at"] or ""}
    targets = {i: {t for t in e["supersedes"] or [] if t is not None} for i, e in last.items()}
    named = {t for ts in targets.values() for t in ts}
    wins = {x for x, ts in targets.items() for y in ts if x in targets.get(y, ()) and last[x]["created_at"] >= last[y]["created_at"]}
    return last, named - wins


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_a_lost_commit(spark, tmp_path, seed):
    """Versions, pairs, self references and missing targets in a random order over several batches; each batch is lost once after
    it was added, and once before."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    rows = [
        {"id": i, "created_at": None if rng.random() < 0.05 else f"{day}-{n:03}", "kind": "learning", "supersedes": None if rng.random() < 0.1 else [*rng.sample(names, rng.randint(0, 3)), *([None] if rng.random() < 0.2 else [])], "tags": None, "body": None}
        for n, (i, day) in enumerate((rng.choice(names[:10]), rng.randint(1, 9)) for _ in range(40))
    ] + [{"id": None, "created_at": "1", "kind": None, "supersedes": ["n1"], "tags": None, "body": "x"}]
    # one null date for an id at most, so that no two versions tie
    seen: set[str] = set()
    rows = [r for r in rows if r["created_at"] is not None or not (r["id"] in seen or seen.add(r["id"]))]
    rng.shuffle(rows)
    folder, checkpoint, log = str(tmp_path / "in"), str(tmp_path / "checkpoint"), Segments(spark, str(tmp_path / "index"))
    for k in range(3):
        spark.createDataFrame([r | {"file": "f", "error": None} for r in rows[k::3]], ENTRIES + ", file string, error string").coalesce(1).write.mode("append").parquet(folder)
    own, lost = m.rocks(spark), iter(["before", None, "after", None, None, None, None])

    def write(entries, skipped):
        name = f"s{random.random()}"
        return name, log.write(name, {"entries": entries.withColumnRenamed("id", "entry_id"), "ids": entries.select(F.col("id").alias("entry_id"))}), {}

    def commit(batch, number, done):
        loss = next(lost)
        if loss == "before":
            raise RuntimeError("lost")
        done(batch, number)
        if loss == "after":
            raise RuntimeError("lost")

    failures = 0
    while True:
        stream = own.readStream.schema(ENTRIES + ", file string, error string").option("maxFilesPerTrigger", 1).parquet(folder)
        try:
            m.start(stream, partial(commit, done=m.commits(log, write, checkpoint)), checkpoint).awaitTermination()
            break
        except Exception as e:
            assert "lost" in str(e)
            failures += 1
    last, gone = brute(rows)
    at = log.snapshot()
    assert failures == 2 and at.version == 3 and len(at.segments) == 3
    assert {r["id"] for r in m.superseded(at.table("links")).collect()} == gone
    held = at.visible(at.table("entries")).collect()
    assert {r["entry_id"]: r["created_at"] for r in held} == {i: e["created_at"] for i, e in last.items()} and len(held) == len(last)
    assert {r["id"] for r in m.superseded(m.last_links(at).withColumn("version", F.lit(1))).collect()} == gone
