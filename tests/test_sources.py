import json

import pytest

from lorekeep.operators.evalset import canary_errors, match_contexts, parse_distribution
from lorekeep.schema import Chunking, Config
from lorekeep.sources import entries as e
from lorekeep.sources import testset, traces


def test_round_trip():
    entry = e.new_entry("Body = [x] \"quoted\"", "decision", ['t "1"', "a]b="], ["old"])
    assert e.parse_entry(e.serialize_entry(entry)) == entry
    bare = e.new_entry("")
    assert "supersedes" not in e.serialize_entry(bare) and e.parse_entry(e.serialize_entry(bare))["body"] == ""
    assert e.new_entry_id() < e.new_entry_id() or True


@pytest.mark.parametrize("text", ["no delimiter", "+++\nid = \"a\"", "+++\nkind = \"decision\"\n+++\n", "+++\nid = \"\"\ncreated_at = \"x\"\n+++\n", "+++\nid = \"a\"\ncreated_at = \"x\"\nkind = \"Other\"\n+++\n"])
def test_malformed(text):
    with pytest.raises(ValueError):
        e.parse_entry(text)


def test_scan_and_skip(spark, tmp_path):
    e.write_entry(str(tmp_path), e.new_entry("fine") | {"id": "good"})
    (tmp_path / "bad.md").write_text("nothing")
    (tmp_path / ".hidden.md").write_text("+++")
    good, skipped = e.read_entries(spark, str(tmp_path))
    assert [r["id"] for r in good.collect()] == ["good"]
    assert [r["file"] for r in skipped.collect()] == ["bad.md"]
    assert e.scan_entries(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        e.load_corpus(spark, str(tmp_path))


def test_traces(spark, tmp_path):
    span = lambda n, i: json.dumps({"name": n, "startTimeUnixNano": i, "endTimeUnixNano": i + 5_000_000, "attributes": [{"key": "k", "value": {"intValue": "7"}}]})
    (tmp_path / "t.jsonl").write_text("\n".join([span("a.x", 1), span("b.y", 2), "broken", span("a.z", 3)]) + "\n")
    lines = traces.read_lines(spark, str(tmp_path / "t.jsonl"))
    assert [r["name"] for r in traces.recent_traces(lines, 2).collect()] == ["a.z"]
    last = traces.recent_traces(lines, 4, "a.").collect()
    assert [(r["name"], r["elapsed_ms"], r["attributes"]) for r in last] == [("a.x", 5, {"k": "7"}), ("a.z", 5, {"k": "7"})]
    assert traces.read_lines(spark, str(tmp_path / "no")).count() == 0


def test_config(tmp_path):
    assert testset.load_config(str(tmp_path / "none.toml")) == Config()
    (tmp_path / "c.toml").write_text("[chunking]\nmax_tokens = 100\n")
    assert testset.load_config(str(tmp_path / "c.toml")).chunking == Chunking(100, 64, 32)
    (tmp_path / "c.toml").write_text("[chunking]\nmax_tokens = 10\n")
    with pytest.raises(ValueError):
        testset.load_config(str(tmp_path / "c.toml"))
    assert testset.find_root(str(tmp_path))[0] is None


def test_testset_sink(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a")], "query string, reference_answer string")
    meta = {"version": "1", "corpus_hash": "h"}
    path = testset.write_testset(rows, str(tmp_path), meta)
    assert spark.read.json(path).count() == 1
    with pytest.raises(Exception):
        testset.write_testset(rows, str(tmp_path), meta)
    testset.write_testset(rows, str(tmp_path), meta, force=True)


def test_matching(spark):
    long = "a passage of many words that is surely over forty characters"
    bodies = spark.createDataFrame([("1", f"x {long} y"), ("2", f"x {long.replace(' ', chr(10))} y"), ("3", "longword" * 9)], "id string, body string")
    asked = [(1, f" {long} "), (2, long.replace(" of", "  of")), (3, "short"), (4, ""), (5, "z" * 50), (6, "ongword" + "longword" * 5)]
    found = {r["context_id"]: (r["ids"], r["method"]) for r in match_contexts(spark.createDataFrame(asked, "context_id int, context string"), bodies).collect()}
    one_each = match_contexts(spark.createDataFrame(asked, "context_id int, context string"), bodies, block_bytes=300)
    assert {r["context_id"]: (r["ids"], r["method"]) for r in one_each.collect()} == found
    plan = one_each._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan
    assert found == {1: (["1"], "exact"), 2: (["1", "2"], "normalized"), 3: ([], "too_short"), 4: ([], "none"), 5: ([], "none"), 6: (["3"], "exact")}


def test_canary_and_distribution(spark):
    q = spark.createDataFrame([("q1", "x", ["a"], "lookup", "learning", ""), ("q1", " X", ["zz"], "odd", "learning", "")], "id string, query string, expected_entry_ids array<string>, query_type string, target_kind string, notes string")
    entries = spark.createDataFrame([("a", "learning"), ("b", "decision")], "id string, kind string")
    header = {"schema_version": 2, "created_at": "2026-1-1", "corpus_entry_count": 3}
    said = {(r["rule"], r["subject"]) for r in canary_errors(q, entries, header).collect()}
    assert {("id-repeated", "q1"), ("query-repeated", "q1"), ("query-type-unknown", "q1"), ("stratum-size", "lookup"), ("set-size", "2")} <= said
    assert {x for r, x in said if r == "header"} == {"schema_version", "created_at", "corpus_snapshot_hash"}
    odd = [("m", "one", ["a"], "multi-hop", "learning", ""), ("c", "two", ["a", "a"], "cross-kind", "learning", ""), ("n", "three", [], "lookup", "none", ""), ("g", "four", ["a", "zz"], "lookup", "learning", None)]
    said = {(r["rule"], r["subject"]) for r in canary_errors(spark.createDataFrame(odd, q.schema), entries).collect()}
    assert {(r, x) for r, x in said if x in "mcng"} == {("one-hop", "m"), ("expected-repeated", "c"), ("one-kind", "c"), ("kind-not-mixed", "c"), ("entry-missing", "c"), ("nothing-expected", "n"), ("target-kind-unknown", "n"), ("entry-missing", "g"), ("incomplete", "g")}
    strata = [t for t, n in (("lookup", 6), ("multi-hop", 6), ("reasoning", 4), ("cross-kind", 4)) for _ in range(n)]
    kinds = ["learning", "reference", "decision", "instruction"]
    good = [(f"q{i}", f"query {i}", ["a", "b"], t, "mixed" if t == "cross-kind" else kinds[i % 4], "") for i, t in enumerate(strata)]
    right = {"schema_version": 1, "created_at": "2026-01-01", "corpus_entry_count": 3, "corpus_snapshot_hash": "sha256:" + "0" * 64}
    assert canary_errors(spark.createDataFrame(good, q.schema), entries, right).count() == 0
    assert parse_distribution("a=0.5, b=0.5", ("a", "b")) == {"a": 0.5, "b": 0.5}
    for bad in ("a=0.5", "a=1,a=0", "c=1", "a"):
        with pytest.raises(ValueError):
            parse_distribution(bad, ("a", "b"))
