import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

warc = pytest.importorskip("lorekeep.llm.warc")
url_filter = pytest.importorskip("lorekeep.llm.url_filter")
ppm = pytest.importorskip("lorekeep.llm.ppm")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(5, "http://b.org/", big), (2, "http://www.A.com/p?q=1", big), (3, "http://a.com/", "é" * 50), (4, None, "é" * 50), (6, "bad\r\nurl", "short"), (7, "", "short"), (8, "http://a.com/", None), (9, "http://a.com:8080/x", ""), (2, "http://a.com/again", big), (None, "http://c.org", big), (10, "http://a.com/", "long " * 50_000)]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, refers_to int").withColumn("at", F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    warc.write_archives(df.repartition(3), f"file://{tmp_path}/w")
    index = warc.capture_index(spark, f"file://{tmp_path}/w")
    rows = index.collect()
    assert [(r["url_key"], r["captured"]) for r in rows] == sorted((r["url_key"], r["captured"]) for r in rows)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = collections.Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i is not None and first.get(h, i) != i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    assert {r["url_key"] for r in rows if r["page_id"] == 2} == {"com,a)/p?q=1", "com,a)/again"}
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_filter(spark):
    events = [("bad", "x.com", "add", 10), ("bad", "x.com", "remove", 20), ("bad", "x.com", "add", 30), ("bad", "x.com", "add", 30), ("odd", "a.x.com", "add", 15), ("odd", "a.x.com", "remove", 15), ("path", "y.org/p", "add", 5), (None, "x.com", "add", 1), ("bad", None, "add", 1), ("bad", "z.net", "add", None), ("bad", "z.net", "other", 1)]
    captures = [(i, u, at) for i, (u, at) in enumerate([("http://A.x.com/q", 9), ("http://a.x.com/q", 10), ("http://a.x.com/q", 19), ("http://a.x.com/q", 20), ("http://x.com", 29), ("http://x.com", 300), ("http://y.org/p/r", 6), ("http://y.org/q", 6), ("http://notx.com/", 12), (None, 12), ("nonsense", 12), ("http://x.com", None), ("http://z.net/", 9)])]
    e = spark.createDataFrame(events, "list string, key string, action string, at long")
    c = spark.createDataFrame([(*x, "k") for x in captures], "id long, url string, at long, key string")
    found = {r["id"]: (r["blocked"], r["lists"]) for r in url_filter.temporal_list_join(c, e, bucket_seconds=7).collect()}
    blocked = {1: "bad", 2: "bad", 5: "bad", 6: "path"}
    assert found == {i: (i in blocked, blocked.get(i, "")) for i, _, _ in captures}
    assert url_filter.temporal_list_join(c.limit(0), e).count() == 0
    assert all(not r["blocked"] for r in url_filter.temporal_list_join(c, e.limit(0)).collect())


TEXTS = ["The cat sat on the mat.", "the cat sat on the mat and the dog ran", "", None, "Zebra ünïcode ß", "aaaa aaaa aaaab", "the the the dog", "quick dog ran", "quick dog ran", *[f"random text {k} the dog" for k in range(12)], "long " * 3000]


def test_language_model(spark, monkeypatch):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    learn = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    found = {r["doc_id"]: r for r in ppm.language_model_scores(df, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()}
    d = ppm.ORDER
    line = lambda t: [ppm.START] * d + list((t or "").translate(LOWER).encode()) + [ppm.END]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""]
    trie, words = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t in docs:
        if learn(i):
            words.update(tokens(t))
            x = line(t)
            for p in range(d, len(x)):
                for k in range(d + 1):
                    trie[tuple(x[p - k : p])][x[p]] += 1

    def chance(context, s):
        out, p = set(), 1.0
        for k in range(d, -1, -1):
            c = {b: n for b, n in trie[tuple(context[d - k :])].items() if b not in out}
            if not c:
                continue
            if s in c:
                return p * c[s] / (sum(c.values()) + len(c))
            p *= len(c) / (sum(c.values()) + len(c))
            out |= set(c)
        return p / (256 - len(out))

    assert sum(chance(list(b"the "), s) for s in range(256)) == pytest.approx(1)
    n, v = sum(words.values()), len(words)
    for i, t in docs:
        x, w, r = line(t), tokens(t), found[i]
        assert r["score"] == pytest.approx(sum(math.log10(chance(x[p - d : p], x[p])) for p in range(d, len(x))), abs=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[y] + 0.1) / (n + 0.1 * (v + 1))) for y in w), abs=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(words[y] > 0 for y in w), n)
    assert ppm.language_model_scores(df.limit(0), F.lit(True)).count() == 0
    untaught = ppm.language_model_scores(df.where("doc_id < 3"), F.lit(False)).collect()
    assert len(untaught) == 3 and all(r["n_known"] == 0 for r in untaught)


def test_dates(spark):
    df = spark.createDataFrame([(1, "http://a.com", "x", 0)], "page_id long, url string, html string, at long")
    text = warc.records(df).first()["record"]
    assert f"WARC-Date: {datetime.datetime(1970, 1, 1).isoformat()}Z" in text


def test_large_and_missing_ids(spark, tmp_path):
    """Ids of any size, negative or null, through the queries of pages."""
    ids = [0, 1, -5, 10**12, 1 << 60, (1 << 63) - 1, None, None]
    pages = [(i, u, "x" * 200) for i, u in zip(ids, ["http://a.com/p", "http://me:pw@B.org:80/q", "http://[::1]:80/x", "http://c.net", None, "http://u@v@d.org/", "http://a.com/", "http://b.org/"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc.op1_warc_external_merge(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r["page_id"] for r in rows))) == sorted(map(str, ids))
    assert all((r["record_type"] == "revisit") == (r["page_id"] not in (-5, None)) and (r["refers_to"] == -5) == (r["record_type"] == "revisit") for r in rows)
    found = url_filter.op7_url_temporal_list_join(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r["page_id"] for r in found))) == sorted(map(str, ids))
    assert all(not r["blocked"] for r in found if r["page_id"] is None)
    hosts = {r[0]: r[1] for r in spark.createDataFrame(pages, "page_id long, url string, html string").where("page_id is not null").select("page_id", url_filter.host(F.col("url"))).collect()}
    assert hosts == {0: "a.com", 1: "b.org", -5: "[::1]", 10**12: "c.net", 1 << 60: None, (1 << 63) - 1: "d.org"}


def test_queries_against_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    for query, sql in ((warc.op1_warc_external_merge, warc.OP1_SQL), (url_filter.op7_url_temporal_list_join, url_filter.OP7_SQL)):
        found = query(spark, sf)
        names = sorted(found.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.select(*names).collect())


def test_one_capture_far_away(spark):
    """One capture centuries later; entries without an end stay a few blocks."""
    captures = [(i, "http://a.com/", 100 + i) for i in range(50)] + [(99, "http://a.com/", 10**11), (98, "http://b.com/", -(10**10))]
    events = [("bad", "a.com", "add", 120), ("odd", "a.com", "add", 130), ("odd", "a.com", "remove", 10**10), ("old", "b.com", "add", -(10**11))]
    c, e = spark.createDataFrame(captures, "id long, url string, at long"), spark.createDataFrame(events, "list string, key string, action string, at long")
    found = {r["id"]: r["lists"] for r in url_filter.temporal_list_join(c, e, bucket_seconds=7).collect()}
    assert found == {i: {"a.com": ",".join(n for n, a, b in (("bad", 120, 10**12), ("odd", 130, 10**10)) if a <= at < b), "b.com": "old"}[u[7:-1]] for i, u, at in captures}
    pieces = spark.sql("select 1").select(F.size(url_filter.blocks(F.lit(-(10**9)), F.lit(10**9), 10))).first()[0]
    assert pieces < 2 * 8 * 11


def test_archives_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PAGE_BYTES", 100)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 64)
    pages = [(i, "http://a.com/", chr(97 + i % 26) * (10 if i % 3 else 1500) + str(i)) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("at", F.lit(0)).coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w")
    rows = warc.capture_index(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in rows) == [(i, len(h)) for i, _, h in pages]
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 17 + 3  # four long pages in each archive, or 64 short ones
