from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.operators.chunker import chunk_entries, split_sentences, split_text
from lorekeep.schema import ENTRIES, Chunking


def numbered(n, end=""):
    return " ".join(f"w{i}" for i in range(n)) + end


def test_sentences():
    assert split_sentences("One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert split_sentences("First paragraph\n\nSecond paragraph") == ["First paragraph", "Second paragraph"]
    assert split_sentences("Before.\n```\ncode. here. x\n```\nAfter.") == ["Before.", "```\ncode. here. x\n```", "After."]
    assert split_sentences("soft\nwrapped line. Next") == ["soft wrapped line.", "Next"]
    assert split_sentences("Ends here.\nGoes on") == ["Ends here. Goes on"]
    assert split_sentences("a\n```\nopen. block") == ["a", "```\nopen. block"]
    assert split_sentences("") == []


def test_short_and_empty():
    assert split_text("hello world") == ["hello world"]
    assert split_text("") == []
    assert split_text("a\n\n b") == ["a b"]


def test_windows_without_sentences():
    chunks = split_text(numbered(100), Chunking(30, 5, 10))
    assert len(chunks) >= 3 and all(len(c.split()) <= 30 for c in chunks)
    assert chunks[1].split()[:5] == chunks[0].split()[-5:]


def test_short_tail_is_merged():
    assert [len(c.split()) for c in split_text(numbered(35), Chunking(30, 5, 32))] == [35]


def test_sentence_packing_and_overlap():
    text = " ".join(numbered(9, f" end{i}.") for i in range(5))
    chunks = split_text(text, Chunking(25, 0, 5))
    assert len(chunks) >= 2 and all(len(c.split()) <= 25 for c in chunks)
    over = split_text(" ".join(" ".join(f"s{i}w{j}" for j in range(9)) + f" e{i}." for i in range(4)), Chunking(20, 5, 5))
    assert over[1].split()[:5] == over[0].split()[-5:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c.", "d!", "e?", "\n\n", "f"]), max_size=120), st.integers(2, 20), st.integers(0, 10), st.integers(0, 10))
def test_properties(parts, size, overlap, least):
    overlap, least = min(overlap, size - 1), min(least, size)
    text = " ".join(parts)
    rule = Chunking(size, overlap, least)
    chunks = split_text(text, rule)
    assert chunks == split_text(text, rule)
    assert {w for c in chunks for w in c.split()} == set(text.split())
    assert all(len(c.split()) <= size + overlap + max(least - 1, 0) for c in chunks)


def test_entries(spark):
    rows = [("a", "t", "learning", [], [], "+++\nx\n+++\nbody here"), ("b", "t", "decision", [], [], ""), ("c", "t", "decision", [], [], None)]
    found = {(r["entry_id"], r["chunk_index"]): r["text"] for r in chunk_entries(spark.createDataFrame(rows, ENTRIES)).collect()}
    assert found == {("a", 0): "body here", ("b", 0): "", ("c", 0): ""}
