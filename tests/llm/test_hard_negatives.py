import random

import numpy as np
import pytest

from codequarry.llm.hard_negatives import RotatedRows, mine_hard_negatives, rotation, scores_of, useful

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, asks, scale=256, positives=5, negatives=3, least=50, most=95):
    """Every row against every row, in Python's integers."""
    odd = lambda x: x is None or x != x or abs(x) == float("inf")
    good = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and not any(map(odd, v))]
    out = []
    for a, (i, v, label) in enumerate(good):
        if not asks(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for c, (j, w, other) in enumerate(good) if c != a and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and -least * s <= -100 * x[0] <= -most * s][:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def mined(df, anchors="vec_id % 5 = 0", **sizes):
    rows = mine_hard_negatives(df, anchors, **sizes).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)


def vectors(n, d, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    return [(i, (centres[(k := int(rng.integers(labels)))] + spread * rng.normal(size=d)).tolist(), k) for i in range(n)]


@pytest.mark.parametrize(("d", "labels", "sizes"), [(1, 2, {}), (3, 2, {"block_numbers": 40}), (16, 4, {"block_numbers": 200, "anchors_a_task": 7}), (40, 30, {"block_numbers": 1000, "fit_rows": 10})])
def test_against_brute_force_however_rows_are_dealt(spark, crowd, d, labels, sizes):
    rows = vectors(120, d, labels, d)
    df = crowd(spark.createDataFrame(rows, KIND)).repartition(5)
    assert mined(df, **sizes) == brute(rows, lambda i: i % 5 == 0)


def test_hot_label_ties_and_repeated_rows(spark):
    rng = random.Random(1)
    small = lambda: [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, small(), 0 if i % 3 else 1 + i % 7) for i in range(90)]
    rows += [(5, [1.0] * 4, 0), (5, [1.0] * 4, 0), (5, [0.5] * 4, 2), (10, [1.0] * 4, 2)] + [(200, [1.0] * 4, 3)] * 6
    df = spark.createDataFrame(rows, KIND)
    want = brute(rows, lambda i: i % 5 == 0)
    assert mined(df, block_numbers=60) == want and mined(df) == want
    assert sum(r[0] == 5 for r in want) > 15  # four rows of this id ask


def test_odd_rows_take_no_part(spark, crowd):
    inf, nan = float("inf"), float("nan")
    rows = vectors(40, 3, 2, 9)
    rows += [(None, [1.0, 1.0, 1.0], 0), (45, None, 1), (50, [1.0, None, 1.0], 0), (55, [1.0, nan, 1.0], 0), (60, [inf, 1.0, 1.0], 1), (65, [1.0, 1.0, 1.0], None)]
    rows += [(70, [], 0), (71, [], 0), (72, [], 1), (75, [2.0, 1.0], 0), (76, [2.0, 1.0], 0), (77, [1.5, 0.5], 1)]
    df = crowd(spark.createDataFrame(rows, KIND))
    found = mined(df)
    assert found == brute(rows, lambda i: i % 5 == 0)
    assert (70, 71, 1, 72, 0, 0) in found and (75, 76, 1, 77, 327680, 229376) in found
    assert mined(df.where("false")) == [] and mined(df, "vec_id < 0") == [] and mined(df.where("label = 0")) == []


def test_wide_components_are_exact_or_an_error(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(5)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, KIND)
    assert mined(df) == brute(rows, lambda i: i % 5 == 0)
    for big in (1e9, 1e30):
        with pytest.raises(Exception, match="does not fit"):
            mined(spark.createDataFrame([(i, [big * (1 + i % 2), big], i % 2) for i in range(6)], KIND))


def test_bounds_hold_at_every_level_and_discard():
    rng = np.random.default_rng(4)
    x = np.floor(1e6 * rng.normal(size=(400, 24)) * np.geomspace(1, 1e-3, 24)).astype(np.int64)
    x[:50] *= 10**6
    held, asked = RotatedRows(x, turn := rotation(x)), RotatedRows(x[::40], rotation(x))
    assert np.allclose(turn @ turn.T, np.eye(24))
    kept = []
    for a, q in enumerate(asked.x):
        exact = x.astype(object) @ q.astype(object)
        part, before = np.zeros(len(x)), 0
        for i, k in enumerate(held.levels):
            part, before = part + held.y[:, before:k] @ asked.y[a, before:k], k
            gap = held.rest[i] * asked.rest[i][a] + held.slack * held.norm * asked.norm[a]
            assert all(abs(e - int(p)) <= int(g) + 1 for e, p, g in zip(exact, part, gap))
            kept.append(useful(part - gap, part + gap, [(-float("inf"), float("inf"))], 5).mean())
        assert np.argsort(-exact.astype(float))[:5].tolist() == sorted(range(400), key=lambda j: (-exact[j], j))[:5]
        assert all(scores_of(held, np.arange(400), q) == exact)
    assert np.mean(kept) < 0.5
