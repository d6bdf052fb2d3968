import numpy as np
import pytest

whitening = pytest.importorskip("lorekeep.llm.whitening")
SCHEMA = "vec_id long, vector array<double>, component string, n int"


def by_numpy(vectors):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    exact = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[a / n for a in r] for r in exact])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [sum(a * a for a in r) for r in exact], centred, e, v


def check(rows, ids, vectors, most=32):
    deviations, centred, e, v = by_numpy(vectors)
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((str(i), c) for i in ids for c in range(1, k + 1))
    of = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        want = centred @ v[:, c] / np.sqrt(e[c])
        got = np.array([of[i, c + 1].whitened for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert of[ids[0], c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert all(of[i, 1].deviation == d and of[i, 1].n == len(ids) for i, d in zip(ids, deviations, strict=True))
    assert all(r.identity_error < 1e-9 for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 5) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("dims", [1, 3, 40, 110])
def test_against_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(300, dims)) * (1 + np.arange(dims)) + 3).tolist()
    check(whitening.whitened(frame(spark, list(enumerate(vectors)))).collect(), list(range(300)), vectors)


def test_left_out_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    two, three = [(-(1 << 63), [0.1, 2.0]), (7, [-0.3, 1.0]), (1 << 60, [0.9, -5.0])], [(4, [1.0, 2.0, 3.0]), (5, [1.5, 0.0, 3.0])]
    bad = [(20, None), (21, []), (22, [1.0, None]), (23, [nan, 1.0]), (24, [inf, 0.0]), (25, [-inf, 0.0])]
    rows = whitening.whitened(frame(spark, two + bad + three)).collect()
    ids = {i for i, _ in two}
    check([r for r in rows if r.vec_id in ids], [i for i, _ in two], [v for _, v in two])
    check([r for r in rows if r.vec_id not in ids], [4, 5], [v for _, v in three])


def test_without_variance(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0])] * 5 + [(2, [1.0, 2.0])])).count() == 0
    constant = [(i, [float(i), 5.0, float(i * i % 7)]) for i in range(20)]
    assert {r.component for r in whitening.whitened(frame(spark, constant)).collect()} == {1, 2}


def test_ids_and_extremes(spark):
    rows = [(None, [1.0, 0.5]), (3, [2.0, 0.25]), (3, [2.0, 0.25]), (4, [1e300, -1e300])]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in found if r.component == 1) == ["3", "3", "4", "None"]
    assert all(r.deviation is None for r in found if r.vec_id == 4)  # over 2^106


def test_exact_beyond_64_bits():
    fit = whitening._Fit(3, [30, 10**15])
    x = np.array([[10, 4 * 10**15], [11, -(10**15)]])
    assert fit.deviations(x) == [sum((3 * a - s) ** 2 for a, s in zip(r, fit.sums, strict=True)) for r in x.tolist()]


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null").collect()
    check(whitening.op13_whitening_svd(spark, "/root/testdata/sf0.001").collect(), [r.vec_id for r in table], [r.embedding for r in table])
