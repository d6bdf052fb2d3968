import random

from lorekeep.operators import supersede as s

SCHEMA = "id string, created_at string, supersedes array<string>"


def ids(df):
    return {r["id"] for r in df.collect()}


def test_cases(spark):
    cases = {
        "simple": ([("a", "1", []), ("b", "2", ["a"])], {"a"}),
        "chain": ([("a", "1", []), ("b", "2", ["a"]), ("c", "3", ["b"])], {"a", "b"}),
        "mutual": ([("a", "1", ["b"]), ("b", "2", ["a"])], {"a"}),
        "equal times": ([("a", "1", ["b"]), ("b", "1", ["a"])], set()),
        "missing": ([("a", "1", ["gone"])], {"gone"}),
        "itself": ([("a", "1", ["a"])], set()),
        "three": ([("a", "1", ["b"]), ("b", "2", ["c"]), ("c", "3", ["a"])], {"a", "b", "c"}),
        "fan in": ([("a", "1", []), ("b", "2", ["a"]), ("c", "3", ["a"])], {"a"}),
        "winner superseded by a third": ([("a", "1", ["b"]), ("b", "2", ["a"]), ("c", "3", ["b"])], {"a"}),
    }
    for name, (rows, want) in cases.items():
        assert ids(s.superseded_ids(spark.createDataFrame(rows, SCHEMA))) == want, name
    assert ids(s.superseded_ids(spark.createDataFrame([], SCHEMA))) == set()


def test_against_loop(spark):
    rng = random.Random(1)
    for _ in range(5):
        rows = [(c, str(rng.randint(1, 3)), rng.sample("abcdef", rng.randint(0, 3))) for c in "abcde"]
        of = {i: (at, sup) for i, at, sup in rows}
        named = {x for _, sup in of.values() for x in sup}
        wins = {x for x in of for y in of if y in of[x][1] and x in of[y][1] and of[x][0] >= of[y][0]}
        assert ids(s.superseded_ids(spark.createDataFrame(rows, SCHEMA))) == named - wins


def test_partition(spark):
    e = spark.createDataFrame([("a", "1", []), ("c", "2", ["a"]), ("e", "3", ["c", "zz"])], SCHEMA)
    assert ids(s.visible(e)) == {"e"} and ids(s.dangling(e)) == {"zz"}
    assert s.duplicate_ids(e.unionByName(e.where("id = 'a'"))).collect()[0]["n"] == 2
