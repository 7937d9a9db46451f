import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import benchmark, catalogue, folds, spans
from codequarry.operators import findings as O

KIND = "ordinal long, scan_id long, type string, location string, line int, proof string, description string"


def same(a, b):
    a, b = (x.replace("\\", "/").strip().lower().removeprefix("./").lstrip("/") for x in (a, b))
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def token(t):
    return "access" if t in ("idor", "auth_bypass") else t


def findings_at_random(seed, n, lines=60):
    rng = random.Random(seed)
    paths = ["A.php", "app/A.php", "repo/app/A.php", "other\\A.php", "./b/B.php", "B.php", "c/C.PHP", "/c/c.php", "XA.php"]
    words = ["", "One  thing", "one thing", "two"]
    scans = [1152921504606846977, 1152921504606846976, None]
    return [(i, rng.choice(scans), rng.choice(["idor", "auth_bypass", "xss"]), rng.choice(paths), rng.choice([None, *range(lines)]), rng.choice(words), rng.choice(words)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def squeeze(x):
    return " ".join(x.lower().split())


def says_the_same(a, b):
    return any(squeeze(x) and squeeze(x) == squeeze(y) for x, y in ((a[5], b[5]), (a[6], b[6])))


def one_kind(a, b):
    return a[1] == b[1] and token(a[2]) == token(b[2]) and same(a[3], b[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_findings_of_one_file_by_hand_rule(spark, seed):
    rows, kept = findings_at_random(seed, 150), []
    for r in rows:
        near = lambda k: one_kind(r, k) and None not in (r[4], k[4]) and (r[4] == k[4] or (abs(r[4] - k[4]) <= 2 and says_the_same(r, k)))  # noqa: B023, E731
        if not any(map(near, kept)):
            kept.append(r)
    got = O.drop_near(frame(spark, rows))
    assert sorted(r.ordinal for r in got.collect()) == [r[0] for r in kept]
    assert {r.scan_id for r in got.collect()} == {r[1] for r in rows} and len(kept) < len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_two_sources_of_one_file_by_hand_rule(spark, seed):
    rows = findings_at_random(seed, 120, 90)
    old, new = rows[:40], rows[40:]
    taken = list(old)
    for r in new:
        if not any(one_kind(r, k) and None not in (r[4], k[4]) and abs(r[4] - k[4]) <= 5 for k in taken):
            taken.append(r)
    assert sorted(r.ordinal for r in O.merge(frame(spark, new), frame(spark, old)).collect()) == sorted(r[0] for r in taken)


def test_paths_that_mean_one_file(spark):
    rows = [(0, 1, "xss", "app/A.php", 10, "", "x"), (1, 1, "xss", "repo/app/A.php", 12, "", "y"), (2, 1, "xss", "Admin/B.php", 10, "", "x"), (3, 1, "xss", "Api/B.php", 10, "", "x"), (4, 1, "xss", "A.PHP", 11, "", "z")]
    got = O.merge(frame(spark, rows[1:]), frame(spark, rows[:1]))
    assert sorted(r.ordinal for r in got.collect()) == [0, 2, 3]
    span = spark.createDataFrame([("repo/app/A.php", 9, 11), ("B.php", 1, 3)], "location string, start int, end int")
    assert sorted(r.ordinal for r in O.outside_spans(frame(spark, rows), span).collect()) == [1, 2, 3]


def test_roots_join_what_may_be_one_file(spark):
    df = spark.createDataFrame([(1, "a/x"), (1, "b/x"), (1, "x"), (2, "a/x"), (2, "b/x"), (None, "a/x"), (1, "a/y/x"), (1, "z"), (1, "")], "k int, p string")
    assert {(r.k, r.p): r._root for r in spans.with_root(df, ("k",), "p").collect()} == {(1, "a/x"): "x", (1, "b/x"): "x", (1, "x"): "x", (2, "a/x"): "a/x", (2, "b/x"): "b/x", (None, "a/x"): "a/x", (1, "a/y/x"): "x", (1, "z"): "z", (1, ""): ""}


def test_spans_by_hand_rule(spark):
    rng = random.Random(6)
    rows = findings_at_random(5, 200, 400)
    holes = [(rng.choice([1152921504606846977, None]), rng.choice(["A.php", "app/A.php", "B.php", "no.php"]), (s := rng.randrange(400)), s + rng.choice([-1, 0, 5, 60])) for _ in range(25)] + [(None, "A.php", None, 5)]
    inside = lambda r: r[4] is not None and any(k == r[1] and s is not None and s <= r[4] <= e and same(q, r[3]) for k, q, s, e in holes)
    got = O.outside_spans(frame(spark, rows), spark.createDataFrame(holes, "scan_id long, location string, start int, end int"), ("scan_id", "location"))
    assert sorted(r.ordinal for r in got.collect()) == [r[0] for r in rows if not inside(r)] != [r[0] for r in rows]


def test_a_hot_file_makes_no_pairs(spark):
    n = 50_000
    lines = spark.range(n).select(F.lit("hot.php").alias("location"), F.col("id").alias("line"))
    holes = spark.range(n).select(F.lit("hot.php").alias("location"), (F.col("id") * 2).alias("start"), (F.col("id") * 2).alias("end"))
    found = O.outside_spans(lines, holes)
    assert found.count() == n // 2
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [4, 4096])
def test_names_around_points_by_hand_rule(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    rng = random.Random(7)
    points = [(rng.choice([1, 2, None]), rng.choice([None, *range(100)])) for _ in range(120)]
    groups = [(rng.choice([1, 2, 3, None]), (s := rng.randrange(100)), s + rng.randrange(0, 40), rng.sample(["a", "b", "c", "d"], rng.randrange(0, 3))) for _ in range(40)] + [(1, None, 5, ["x"]), (1, 0, 50, None)]
    want = {}
    for f, p in points:
        if p is not None:
            around = sorted((g[1], g[3]) for g in groups if g[0] == f and None not in g and g[1] < p < g[2]) if f is not None else sorted((g[1], g[3]) for g in groups if g[0] is None and g[1] < p < g[2])
            want[f, p] = list(dict.fromkeys(m for _, names in around for m in names))
    got = catalogue.inherited_middleware(spark.createDataFrame(points, "file int, position int"), spark.createDataFrame(groups, "file int, start int, end int, middleware array<string>"))
    assert {(r.file, r.position): r.middleware for r in got.collect()} == want


def test_findings_and_labels_without_a_line_fit_nothing(spark):
    f = spark.createDataFrame([(0, "a", "xss", None), (1, "a", "xss", 5), (2, "a", "idor", 6)], "ordinal long, file string, type string, line int")
    t = spark.createDataFrame([("a", "xss", None, ["xss"]), ("a", "xss", 7, None), ("a", "auth_bypass", 4, ["idor"])], "file string, type string, line int, accepted_types array<string>")
    got = sorted((tuple(r) for r in benchmark.assign(f, t).collect()), key=str)
    assert got == sorted([("a", "xss", None, "fp"), ("a", "xss", None, "fn"), ("a", "xss", 5, "fp"), ("a", "auth_bypass", 6, "tp"), ("a", "xss", 7, "fn")], key=str)
