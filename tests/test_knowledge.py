import time

from lorekeep.operators import retrieval
from lorekeep.plans.knowledge import KnowledgeBase, lexical_reranker
from lorekeep.sources.entries import write_entry
from lorekeep.streaming.incremental import ingest_stream


def entry(i, kind, body, supersedes=()):
    return {"id": i, "created_at": f"2024-01-0{len(i)}T00:00:00Z", "kind": kind, "supersedes": list(supersedes), "tags": [], "body": body}


def test_life_cycle(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path))
    results, quality = kb.search("anything")
    assert results.count() == 0 and quality.first()["suggestion"] == retrieval.COLD
    write_entry(kb.entries_dir, entry("a", "decision", "We store vectors in parquet tables because scans are fast."))
    write_entry(kb.entries_dir, entry("b", "learning", "The cache must be cleared after a schema change."))
    write_entry(kb.entries_dir, entry("cc", "reference", "Ports and addresses of services.", ["b"]))
    done = kb.ingest().first()
    assert (done["entries_ingested"], done["chunks_indexed"], done["superseded_count"]) == (3, 3, 1)

    results, quality = kb.search("parquet vectors")
    rows = results.collect()
    assert rows[0]["id"] == "a" and rows[0]["kind"] == "decision" and "b" not in {r["id"] for r in rows}
    assert quality.first()["confidence"] == "low"
    assert {r["id"] for r in kb.search("services", kind="reference")[0].collect()} == {"cc"}
    none, quality = kb.search("parquet", min_score=99.0)
    assert none.count() == 0 and quality.first()["suggestion"] == retrieval.BELOW_MINIMUM
    kb.rerank = lexical_reranker
    assert kb.search("parquet vectors")[0].first()["score"] == 1.0
    kb.rerank = None

    new = kb.write("We store vectors in parquet tables because scans are fast!", "decision")
    assert new["action"] == "superseded" and new["superseded"] == ["a"] and new["similarity"] >= 0.85
    assert new["id"] in {r["id"] for r in kb.search("parquet vectors")[0].collect()}
    other = kb.write("Entirely different words about gardening", supersedes=["ghost"])
    assert other["warning"] == "superseded entry 'ghost' not found"
    assert kb.write("")["action"] == "created"

    kb.log("lorekeep.search", time.time() - 0.01, query="x")
    said = kb.status().first()
    assert said["entry_count"] == 6 and not said["stale"] and said["recent_traces"][0]["name"] == "lorekeep.search"
    write_entry(kb.entries_dir, entry("d", "learning", "more"))
    assert kb.status().first()["stale"]


def test_stream(spark, tmp_path):
    write_entry(str(tmp_path / "in"), entry("a", "decision", "First."))
    for more, want in ((None, 1), (entry("b", "learning", "Second."), 2)):
        if more:
            write_entry(str(tmp_path / "in"), more)
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == want


def test_command_line(spark, tmp_path):
    from lorekeep.__main__ import options, run

    said = lambda *words: run(spark, options().parse_args([str(tmp_path / "kb"), *words]))
    said("write", "rivers carry water to the sea", "--kind", "learning", "--tag", "water")
    said("write", "stones do not swim", "--kind", "decision")
    said("ingest")
    found = said("search", "rivers water", "--limit", "3", "--kind", "learning")
    assert "rivers" in str(found[0]) and "confidence" in found[-1]
    assert said("status") and isinstance(said("traces", "--limit", "2"), list)


def test_index_of_segments(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path))
    kb.init()
    kb.init()
    assert kb.index.versions() == [1] and kb.search("x")[0].count() == 0
    first = kb.write("Rivers carry water to the sea.", "learning")
    second = kb.write("Stones lie on the ground, heavy and grey.", "decision")
    assert len(kb.index.snapshot().segments) == 2 and kb.status().first()["entry_count"] == 2
    said = lambda **more: [r["id"] for r in kb.search("rivers OR +stones", **more)[0].collect()]
    before = said()
    assert set(before) == {first["id"], second["id"]}
    third = kb.write("Rivers carry water to the sea!", "learning")  # supersedes the first
    assert third["superseded"] == [first["id"]] and set(said()) == {second["id"], third["id"]}
    old = kb.index.snapshot()
    kb.compact()
    assert len(kb.index.snapshot().segments) == 1 and set(said()) == {second["id"], third["id"]}
    assert kb.status().first()["superseded_count"] == 1 and not kb.status().first()["stale"]
    kb.ingest()
    kb.ingest()
    assert len(kb.index.snapshot().segments) == 1 and set(said()) == {second["id"], third["id"]}
    assert kb._entries(old).count() == 3  # a reader of an earlier version is not disturbed
    assert len(kb.index.vacuum(grace=0)) == 5 and set(said(kind="decision")) == {second["id"]}
    assert said(max_tokens=1) and said(limit=0) == []


def test_an_entry_written_anew(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path))
    write_entry(kb.entries_dir, entry("a", "decision", "old words here"))
    kb.ingest()
    at = kb.index.snapshot()
    name, tables, figures = kb._written(spark.createDataFrame([entry("a", "decision", "new words there")], "id string, created_at string, kind string, supersedes array<string>, tags array<string>, body string"))
    kb.index.add(name, tables, figures)
    assert [r["content"] for r in kb.search("words")[0].collect()] == ["new words there"]
    assert kb.index.snapshot(at.version).table("docs").first()["text"] == "old words here"


def test_a_batch_of_writes(spark, tmp_path):
    """The same as one write after the other, seen at once; one version."""
    said = [
        (3, "Rivers carry water to the sea.", "learning", None, None), (5, "  Rivers carry water to the sea!\n", "DECISION", ["a"], []), (9, "", None, None, None),
        (11, "Stones lie on the ground, heavy and grey.", None, ["b"], ["ghost"]), (12, "Rivers carry water to the sea?", "reference", None, None), (2**43, "Stones lie on the ground; heavy and grey", None, [], None),
    ]
    writes = spark.createDataFrame(said, "seq long, content string, kind string, tags array<string>, supersedes array<string>")
    one, all_at_once = KnowledgeBase(spark, str(tmp_path / "one")), KnowledgeBase(spark, str(tmp_path / "all"))
    first = {"rivers": [kb.write("Rivers carry the water to the sea", "learning")["id"] for kb in (one, all_at_once)]}
    want, names = [], {first["rivers"][0]: "first"}
    for seq, content, kind, tags, supersedes in said:
        done = one.write(content, kind or "learning", tags, supersedes)
        names[done["id"]] = seq
        want.append((seq, done["action"], [names.get(i, i) for i in done["superseded"]], done["similarity"] and round(done["similarity"], 6), done["warning"]))
    before = all_at_once.index.snapshot().version
    found = all_at_once.write_batch(writes).orderBy("seq").collect()
    names = {first["rivers"][1]: "first"} | {r["id"]: r["seq"] for r in found}
    assert [(r["seq"], r["action"], [names.get(i, i) for i in r["superseded"]], r["similarity"] and round(r["similarity"], 6), r["warning"]) for r in found] == want
    assert [w[2] for w in want] == [["first"], [3], [], ["ghost"], [5], [11]]
    assert all_at_once.index.snapshot().version == before + 1 and [r["id"] for r in found] == sorted(r["id"] for r in found)
    state = all_at_once.status().first()
    assert state["entry_count"] == 7 and not state["stale"]
    live = {r["id"] for r in all_at_once.search("rivers stones", limit=9)[0].collect()}
    assert {names[i] for i in live} == {12, 2**43}
    all_at_once.ingest()  # the files hold the same
    assert {r["id"] for r in all_at_once.search("rivers stones", limit=9)[0].collect()} == live


def test_a_batch_that_is_refused(spark, tmp_path):
    import pytest

    kb, kind = KnowledgeBase(spark, str(tmp_path)), "seq long, content string, kind string, tags array<string>, supersedes array<string>"
    for rows in ([(1, "x", "draft", None, None)], [(1, "x", None, None, None), (1, "y", None, None, None)], [(-1, "x", None, None, None)], [(None, "x", None, None, None)]):
        with pytest.raises(ValueError):
            kb.write_batch(spark.createDataFrame(rows, kind))
    assert kb.write_batch(spark.createDataFrame([], kind)).count() == 0 and kb.index.versions() == []
