import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import folds


def brute_chunks(sizes, max_size, chunk_size):
    out, chunk, used, held = [], 0, 0, 0
    for n in sizes:
        n = max(n or 0, 0)
        if held and (used + n > max_size or held >= chunk_size):
            chunk, used, held = chunk + 1, 0, 0
        used, held = used + n, held + 1
        out.append(chunk)
    return out


def brute_admitted(sizes, budget, reserve):
    out, used = [], 0
    for n in sizes:
        n = max(n or 0, 0)
        fits = budget == 0 or used + n + reserve <= budget
        used += n * fits
        out.append(fits)
    return out


@pytest.fixture
def scans(spark):
    """Scans of very different lengths, one without an id, one with an id beyond doubles, null sizes and sizes of 0."""
    rng = random.Random(4)
    sizes = {1152921504606846977: 900, 1152921504606846976: 37, 5: 1, None: 60, 6: 64, 7: 8}
    rows = [(s, f"f{i:05}", rng.choice([None, 0, 1, 3, 10, 40, 99, 150])) for s, n in sizes.items() for i in range(n)]
    rows += [(8, f"f{i:05}", 0) for i in range(50)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "scan long, path string, size long").repartition(3), rows


def by_scan(rows):
    out = {}
    for s, p, n in sorted(rows, key=str):
        out.setdefault(s, []).append((p, n))
    return {s: sorted(x) for s, x in out.items()}


@pytest.mark.parametrize(("max_size", "chunk_size", "block"), [(100, 4, 8), (300, 10, 8), (10**9, 7, 16), (0, 3, 8), (120, 50, 4096), (90, 1, 4)])
def test_chunks_over_many_blocks(spark, scans, monkeypatch, max_size, chunk_size, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    df, rows = scans
    got = {(r.scan, r.path): r.chunk for r in folds.fold_chunks(df, ("scan",), "path", max_size, chunk_size).collect()}
    want = {(s, p): c for s, x in by_scan(rows).items() for (p, _), c in zip(x, brute_chunks([n for _, n in x], max_size, chunk_size))}
    assert got == want


@pytest.mark.parametrize(("budget", "reserve", "block"), [(0, 4, 8), (500, 50, 8), (2000, 0, 16), (40, 50, 8), (50, 50, 8), (10**7, 0, 8)])
def test_budget_over_many_blocks(spark, scans, monkeypatch, budget, reserve, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    df, rows = scans
    got = {(r.scan, r.path): (r.size, r.admitted) for r in folds.admit(df, ("scan",), "path", budget, reserve, "size").collect()}
    want = {(s, p): (n, a) for s, x in by_scan(rows).items() for (p, n), a in zip(x, brute_admitted([n for _, n in x], budget, reserve))}
    assert got == want


def test_a_budget_that_shrinks_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 4)
    sizes = [x for k in range(60, 20, -2) for x in (1, k)]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "scan int, o int, tokens int")
    got = [r.admitted for r in sorted(folds.admit(df, ("scan",), "o", 61, 0).collect(), key=lambda r: r.o)]
    assert got == brute_admitted(sizes, 61, 0)


@pytest.fixture
def many_partitions(spark):
    """As many ranges as shuffle partitions, however little there is in them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_long_scan_is_worked_on_by_many_tasks(spark, many_partitions):
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("scan"), "id", (F.col("id") * 7919 % 101).alias("size"))
    found = folds.fold_chunks(df, ("scan",), "id", 500, 10)
    assert {r.id: r.chunk for r in found.collect()} == dict(enumerate(brute_chunks([i * 7919 % 101 for i in range(n)], 500, 10)))
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    placed = folds.running(df, ("scan",), ("id",), {"pos": (F.sum, F.lit(1)), "most": (F.max, F.col("size"))})
    assert placed.where("pos <> id").isEmpty() and placed.where("id = 0 and most is null").count() == 1
    assert placed.select(F.spark_partition_id()).distinct().count() > 1


def test_no_scans(spark):
    df = spark.createDataFrame([], "scan int, o int, tokens int")
    assert folds.fold_chunks(df, ("scan",), "o", 10, 3, "tokens").collect() == [] and folds.admit(df, ("scan",), "o", 10, 3).collect() == []
