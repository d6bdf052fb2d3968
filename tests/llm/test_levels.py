import array
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

levels = pytest.importorskip("lorekeep.llm.levels")
tokenizers = pytest.importorskip("tokenizers")
PATH = levels.vocabulary_path()
OWN, LIB = levels.RunEncoder(PATH), tokenizers.Tokenizer.from_file(PATH)


def library(text):
    return array.array("I", LIB.encode(text or "", add_special_tokens=False).ids).tobytes()


CASES = ["", None, " \t\n", "The, the THE,", "don't I'LL we've's", "a<|endoftext|>b <|STARTOFTEXT|>", "aİ< İ ǅ ſ ªº", "été! naïve, ß", "x\x1cy\x85z\xa0w", "日本 😀", "..., ,.", "1.234", "word" * 3000]


def test_cases():
    assert list(OWN.encode(CASES)) == [library(t) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAsStT'’.,<| \n\t\x0b\x1c\x85\xa0éÉİſǅΣς́̇中0²", "<|endoftext|>"]), max_size=30).map("".join), max_size=5))
def test_like_the_library(texts):
    assert list(OWN.encode(texts)) == [library(t) for t in texts]


def test_little_memory(monkeypatch):
    monkeypatch.setattr(levels, "RUNS", 2)
    monkeypatch.setattr(levels, "SLICE_BYTES", 8)
    own = levels.RunEncoder(PATH)
    assert list(own.encode(CASES * 2)) == [library(t) for t in CASES * 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=12), st.integers(1, 15))
def test_level_is_the_least_sum_of_squares(before, size):
    windows = levels.Windows(16)
    for n in before:
        list(windows.place(0, bytes(4 * n)))
    counts = windows.counts.copy()

    def squares(h):
        c = counts.copy()
        if h:
            c[h] -= 1
        if h + size < 16:
            c[h + size] += 1
        return int((c * c).sum())

    open_ = [h for h in range(1, 17 - size) if counts[h]]
    want = min([0, *open_], key=lambda h: (squares(h), -h))
    assert squares(windows.level(size)) == squares(want)
    assert windows.level(size) == want


def held_to(rows, docs, capacity):
    """Each document's ids lie in its pieces, once; windows are gapless and full or a power of two."""
    want = {}
    for doc_id, text in docs:
        want.setdefault(str(doc_id), []).append(library(text) + (1).to_bytes(4, "little"))
    for key, ids in want.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if str(r.doc_id) == key)
        assert sum(p[1] for p in own) == sum(len(i) // 4 for i in ids)
        if len(ids) == 1:
            at = 0
            for start, length, crc, n in own:
                assert (start, n, crc) == (at, len(ids[0]) // 4, zlib.crc32(ids[0][4 * at : 4 * (at + length)]))
                at += length
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


DOCS = [(1, "hello world"), (2, None), (3, ""), (4, "many words here " * 400), (5, "same text"), (5, "same text"), (None, "no id"), (1 << 60, "large"), (-(1 << 63), "least"), *[(100 + i, "w " * (i % 37)) for i in range(200)]]


@pytest.mark.parametrize("capacity, most_open", [(2048, 4096), (64, 4096), (64, 5), (50, 3)])
def test_pack(spark, capacity, most_open):
    df = spark.createDataFrame([(*d, "x", 7) for d in DOCS], "doc_id long, text string, sequence_id string, offset int").repartition(3)
    held_to(levels.pack_online(df, PATH, capacity, most_open=most_open).collect(), DOCS, capacity)
    assert levels.pack_online(df.limit(0), PATH).count() == 0


def test_documents_stay_whole_while_windows_can_be_filled():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 4000)
    windows = levels.Windows(16)
    full = [w for s in sizes for w in windows.place(0, bytes(4 * int(s)))]
    assert sum(len(p[2]) // 4 for w in full for p in w) >= 0.98 * sizes.sum()  # without a cut
    assert all(sum(len(p[2]) // 4 for p in w) == 16 for w in full)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    held_to(levels.op11_sum_of_squares(spark, "/root/testdata/sf0.001").collect(), docs, 2048)
