import random
import re

import numpy as np
import pytest

jaccard = pytest.importorskip("lorekeep.llm.jaccard")
forest = pytest.importorskip("lorekeep.llm.forest")
ann = pytest.importorskip("lorekeep.llm.ann")
components = pytest.importorskip("lorekeep.llm.components")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 40), (41, 40), (41, 41), (30, 40)] + [(100, k) for k in range(101, 140)]
    found = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == classes({x for p in links for x in p}, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def near_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    docs = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "nbsp joined words a b c"), (8, "É e é e é e")]
    n = 10
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 150))] + shared[: rng.choice([0, 20, 60])]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            docs.append((n, " ".join(w)))
            n += 1
    hub = [word() for _ in range(120)]
    for _ in range(40):  # a group of near copies
        w = list(hub)
        w[rng.randrange(len(w))] = word()
        docs.append((n, " ".join(w)))
        n += 1
    return docs + [(n + k, docs[-1][1]) for k in range(5)]


def test_jaccard(spark):
    docs = near_texts()
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, n_shingles double, token string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(df).collect()}
    sets = shingle_sets(docs)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = classes(ids, links)
    assert found == {i: (len(sets[i]), of[i]) for i in ids}


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "word " * 20_000)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(df).collect()), key=str)
    assert rows == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 1, 2)], key=str)
    assert jaccard.near_classes(df.limit(0)).count() == 0


def test_multi_match_prefix():
    """Sets that overlap enough share l shingles among the first places of either, for every l."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(5, 60))
        x = set(rng.choice(500, n, replace=False).tolist())
        y = set(x) - set(rng.choice(sorted(x), max(0, int(n * 0.1)), replace=False).tolist()) | {int(1000 + rng.integers(50))}
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        for most in range(1, 9):
            cut = lambda s: set(sorted(s)[: len(s) - (len(s) * 80 + 99) // 100 + most])  # noqa: B023, E731
            assert len(cut(x) & cut(y)) >= min(most, len(x & y))


def test_short_sets(spark):
    """A set must not ask for more matches than a partner can share with it."""
    for n in range(1, 12):
        for df in (np.full(n, 2), np.full(n, 50), np.arange(2, n + 2)):
            assert jaccard.prefix(df, n)[0] <= -(-n * 4 // 5)
    # ten and eleven are one shingle, whose leader is the longer text with id 1
    docs = [(10, "alpha beta gamma delta eps"), (11, "Alpha beta gamma delta eps"), (1, "alpha beta gamma delta eps x y")]
    docs += [(100 + i, f"q{i} beta gamma delta eps x y") for i in range(8)]
    # the same with sets of two to eight shingles
    for n in range(2, 9):
        text = " ".join(f"w{n}x{k}" for k in range(n + 4))
        docs += [(1000 * n + 10, text), (1000 * n + 11, text.upper())]
        for k in range(n):
            part = " ".join(text.split()[k : k + 5])
            docs += [(1000 * n + k, part + f" a{n} b{n} c{n}")]
            docs += [(1000 * n + 100 + 10 * k + i, f"q{i} " + " ".join(part.split()[1:]) + f" a{n} b{n} c{n}") for i in range(6)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = shingle_sets(docs)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = classes(ids, links)
    assert found == {i: (len(sets[i]), of[i]) for i in ids}


def links_of(sets):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_many_nearly_alike(spark, monkeypatch):
    """A large group of near copies, of which many are not quite alike enough to link, compared in several chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    passage = [word() for _ in range(60)]
    docs = []
    for n in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[word()], [], [word(), word()]])
        docs.append((n, " ".join(w)))
    for n in range(500, 560):  # mostly one passage, in different surroundings
        docs.append((n, " ".join([word() for _ in range(rng.randint(0, 14))] + passage[rng.randint(0, 3) :] + base[: rng.randint(0, 9)])))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    sets = shingle_sets(docs)
    links = links_of(sets)
    linked = {x for p in links for x in p}
    assert 20 < len(docs) - len(linked) < 540
    of = classes(sorted(sets), links)
    assert found == {i: (len(sets[i]), of[i]) for i in sets}


def test_ids_with_several_texts(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    docs = [(1, text("a")), (1, text("b")), (2, text("b") + " more"), (3, text("c")), (3, text("c")), (4, text("a") + " x"), (None, text("c")), (None, text("z"))]
    rows = jaccard.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 1), (None, None), (None, None)], key=str)
    assert all(r["n_shingles"] in (36, 37) for r in rows)


def test_op8(spark):
    sf = "/root/testdata/sf0.001"
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    of = classes(sorted(sets), links_of(sets))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op8_jaccard_adaptive_prefix(spark, sf).collect()} == {i: (len(sets[i]), of[i]) for i in sets}


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(60):
            base = rng.normal(size=16)
            rows += [(base + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.3]), label) for _ in range(rng.integers(1, 4))]
        hub = rng.normal(size=16)
        rows += [(hub + rng.normal(size=16) * 0.03, label) for _ in range(120)]
        rows += [(hub, label)] * 20
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    same = rows[0][1]
    return rows + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [None, *same[1:]], 0), (n + 3, [float("nan"), *same[1:]], 0), (n + 4, [float("inf"), *same[1:]], 0), (n + 5, same, None), (n + 6, same[:5], 0), (n + 7, [], 0)]


@pytest.mark.parametrize("group", [8_192, 60])  # the second splits as tables and compares dense nodes in chunks
def test_forest(spark, group):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, keys string, n int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_embeddings(df, leaf=40, group=group).collect()}
    good = [r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good}
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.93]
    of = classes([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = sum(found[i][0] for i in count) / sum(count.values())
    assert 0.99 <= got <= 1 and all(found[i][0] <= count[i] for i in count)
    assert np.mean([found[i][1] == of[i] for i in of]) > 0.99
    assert all(k == (i == c) for i, (_, c, k) in found.items())
    assert forest.near_embeddings(df.limit(0)).count() == 0


def test_nearest(spark):
    rows = [(i, v) for i, v, _ in vectors()]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    usable = df.where(forest.usable(df.v))
    found = ann.nearest(usable, usable.where("id % 7 = 0"), 10).collect()
    good = {i: np.array(v) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in good if i % 7 == 0):
        true = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = [(s, i) for _, i, s in sorted(by[q])]
        assert mine == sorted(mine) and len(mine) == 10 and all(abs(s - np.sqrt(((good[i] - good[q]) ** 2).sum())) < 1e-12 for s, i in mine)
        hit += len({i for _, i in mine} & {i for _, i in true})
        total += 10
    assert hit / total >= 0.9
    few = ann.nearest(usable.where("id < 4"), usable.where("id < 4"), 10).collect()
    assert len(few) == 12
    assert ann.nearest(usable.limit(0), usable.limit(0), 10).count() == 0
    salted = ann.nearest(usable.where("id < 50"), usable.where("id = 0"), 10)
    assert salted.count() == 10


def test_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "LIST", 64)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = ann.nearest(df, df.where("id % 10 = 0"), 5).collect()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    want = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:6].tolist()) for q in range(0, 300, 10)}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) / 150 >= 0.9


def test_repeated_ids_and_lengths(spark):
    """Every row but the query's own is a candidate, also of the same id or vector; lengths are searched apart."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0]), (1, [0.5, 0.5])] + [(100, rng.normal(size=3).tolist()), (101, rng.normal(size=3).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = ann.nearest(df, df.where("id % 100 = 0"), 10).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in found)
    want = []
    for k, (q, v) in enumerate(rows):
        if q % 100 == 0:
            others = sorted((round(float(np.linalg.norm(np.float32(v).astype(float) - np.float32(w).astype(float))), 5), i) for n, (i, w) in enumerate(rows) if n != k and len(w) == len(v))
            want += [(q, rank, i, d) for rank, (d, i) in enumerate(others, 1)]
    assert got == sorted(want)


def test_op3_and_op4(spark):
    """The queries against brute force on the small table."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v, _ in rows])
    ids = np.array([i for i, _, _ in rows])
    near = {}
    for r in ann.op4_ann_balanced_postings(spark, sf).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for k, i in enumerate(ids):
        if i % 100 == 0:
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            d[k] = np.inf
            hit += len({v for _, v in near[i]} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit / (10 * len(near)) >= 0.9 and set(near) == {i for i in ids.tolist() if i % 100 == 0}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([-1 if c is None else c for _, _, c in rows])
    close = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & (label >= 0)
    np.fill_diagonal(close, False)
    of = classes(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(close))])
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.op3_rp_forest_near_dup(spark, sf).collect()} == {i: (int(n), of[i], of[i] == i) for i, n in zip(ids.tolist(), close.sum(1))}
