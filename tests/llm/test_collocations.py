import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

collocations = pytest.importorskip("lorekeep.llm.collocations")
SCHEMA = "lang string, text string, phrase int, shard string"


def by_hand(rows, least, top, subsumed=50):
    words, grams = defaultdict(int), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    grams[lang][tuple(ws[i : i + n])] += 1
    out = []
    for lang, f in grams.items():
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(100 * b >= subsumed * a for h, b in f.items() if len(h) == 3 and b >= least and g in (h[:2], h[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode("utf-8", "surrogatepass"), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode("utf-8", "surrogatepass"), -a, left, right, words[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


ODD = [
    (None, "New York, new york. New York! x y"), ("und", "new york"), ("en", None), ("en", ""), ("en", " \t\n"), ("de", "ÄB cd Äb cd äB cd"),
    ("en", "a b c " * 40), ("en", "a b c d\ta b\x0bc d"), ("en", "a b c " * 40), ("fr", "x\x85y z\xa0w x\x85y z\xa0w \x1c x\x85y z\xa0w"), ("en", "un " * 5000),
]


@pytest.mark.parametrize("least, top, words, group", [(1, 2000, 10**6, 10**6), (2, 3, 20, 1), (3, 2000, 1, 2)])
def test_by_hand(spark, least, top, words, group):
    df = spark.createDataFrame([(*r, 1, "s") for r in ODD * 2], SCHEMA).repartition(3)
    assert rows_of(collocations.collocations(df, least, top, shard_words=words, group_rows=group)) == by_hand(ODD * 2, least, top)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None, 1, "s")], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(2, 5))
def test_grams(symbols, longest):
    symbols = np.array(symbols, np.int64)
    want = Counter(tuple(symbols[i : i + n].tolist()) for n in range(2, longest + 1) for i in range(len(symbols) - n + 1) if symbols[i : i + n].all())
    got = [(tuple(g), c) for found, counts in collocations.grams(symbols, longest) for g, c in zip(found.tolist(), counts.tolist(), strict=True)]
    assert len(got) == len(want) and dict(got) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30))
def test_suffix_array(symbols):
    order = collocations.suffix_array(np.array(symbols, np.int64), 64)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    phrases = spark.createDataFrame([((1 << 32) | 2, 0, big)], "pair long, third int, a long")
    known = spark.createDataFrame([(1, "en", "a", big + 1), (2, "en", "b", big + 2)], "id long, lang string, word string, f long")
    r = collocations._scored(phrases, known, 50).first()
    assert r.score == 1_000_000 * big * big // ((big + 1) * (big + 2))


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    want = by_hand(docs, 10, 2000)
    sql = con.execute(collocations.OP12_SQL).df()[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]]
    assert len(want) > 20
    assert rows_of(collocations.op12_collocations_suffix_array(spark, "/root/testdata/sf0.001")) == want == sorted(sql.itertuples(index=False, name=None))
