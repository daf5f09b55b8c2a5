"""Hard negatives against all pairs in plain numbers; the scan against exact scores on random vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesift.llm import bond_negatives as bond

SCHEMA = "vec_id long, label int, embedding array<float>, score int, `block` string, `a.b` int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    usable = [
        (i, label, [math.floor(256 * np.float64(np.float32(x))) for x in vector])
        for i, label, vector in rows
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for k, (anchor, label, own) in enumerate(usable):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v)), math.inf if i is None else i, lab, j) for j, (i, lab, v) in enumerate(usable)]
        scored.sort(key=lambda r: r[:2])
        near = [r for r in scored if r[2] == label and r[3] != k][:positives]
        for minus, positive, *_ in near:
            fits = [r for r in scored if r[2] != label and low * -minus <= 100 * -r[0] <= high * -minus][:negatives]
            out += [(anchor, positive, rank, n[1], -minus, -n[0]) for rank, n in enumerate(fits, 1)]
    return sorted((tuple(None if x == math.inf else x for x in r) for r in out), key=order)


def vectors(n, dims, seed, spread=1.0):
    """Clusters of vectors, some equal, with few values so that scores tie, and dimensions of falling size."""
    rng = random.Random(seed)
    middles = [[rng.choice([-1, 0, 1]) * spread ** (d / 4) for d in range(dims)] for _ in range(6)]
    return [(i, rng.randrange(4), [m + rng.choice([-0.25, 0, 0, 0.25]) for m in rng.choice(middles)]) for i in range(n)]


ODD = [
    (50, 1, [0.5, 0.5]), (50, 1, [0.5, 0.5]), (None, 1, [0.5, 0.25]), (None, 2, [0.25, 0.25]), (100, None, [1.0, 1.0]), (150, 1, None),
    (200, 2, [float("nan"), 1.0]), (250, 2, [None, 1.0]), (300, 2, [float("inf"), 1.0]), (350, 1, []), (400, 2, [1.0]), (-50, 1, [-0.5, -0.5]),
    (1, 2, [0.3, 0.3]), (2, 2, [0.3, 0.3]), (3, 3, [0.4, 0.4]), (4, 1, [0.0, 0.0]), (450, 5, [0.1, 0.2]), (5, 1, [1e30, 0.0]), (6, 2, [0.3, 0.3, 9.0]),
]


def mined(spark, rows, **options):
    made = spark.createDataFrame([(i, label, v, 1, "b", 2) for i, label, v in rows], SCHEMA)
    got = bond.mine(made, F.col("vec_id"), F.col("label"), F.col("embedding"), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return got


def order(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize("rows", [vectors(400, 12, 1), vectors(300, 30, 2, 0.5), [(i, i % 2, [0.5, 0.5]) for i in range(120)], [], [(50, 1, [1.0])]])
def test_against_all_pairs(spark, rows):
    assert sorted(map(tuple, mined(spark, rows).collect()), key=order) == brute(rows)


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 5]
    assert sorted(map(tuple, mined(spark, rows).collect()), key=order) == brute(rows)
    assert mined(spark, ODD).count() > 0  # a component beyond all bounds


def test_small_blocks_and_chunks(spark, monkeypatch):
    """Many blocks met by many chunks give the rows of one; the hot label and the equal vectors fall into all of them."""
    rows = vectors(300, 12, 3) + [(1000 + i, 1, [0.5] * 12) for i in range(150)]
    whole = mined(spark, rows).repartition(1)
    want = brute(rows)
    assert sorted(map(tuple, whole.collect())) == want
    monkeypatch.setattr(bond, "ANCHORS", 2)
    assert sorted(map(tuple, mined(spark, rows).collect())) == want


def test_the_scan_excludes_by_bounds():
    """Rows leave before all dimensions are read, and never one of the result."""
    rng = np.random.default_rng(5)
    columns = (rng.normal(size=(64, 3000)) * 200 * 0.8 ** np.arange(64)[:, None]).astype(np.int64)
    lows, highs = columns.min(axis=1), columns.max(axis=1)
    seen = []
    for a in range(20):
        anchor, alive = columns[:, a], np.arange(3000) != a

        def watched(keep):
            def run(sums, left, least, most):
                kept = keep(sums, left, least, most)
                seen.append((most > least, np.count_nonzero(kept)))
                return kept

            return run

        exact = anchor @ columns
        places, scores = bond.vertical(columns, lows, highs, anchor, alive, watched(bond.nearest(5)))
        assert (scores == exact[places]).all()
        own = places[bond.ranked(places, scores, np.arange(3000), 5)]
        assert list(own) == [i for i in np.argsort(-exact, kind="stable") if i != a][:5]
        windows = [(int(s) // 2, int(s) * 95 // 100) for s in exact[own]]
        places, scores = bond.vertical(columns, lows, highs, anchor, alive, watched(bond.within(windows, 3)))
        for low, high in windows:
            inside = (scores >= low) & (scores <= high)
            got = places[inside][bond.ranked(places[inside], scores[inside], np.arange(3000), 3)]
            assert list(got) == [i for i in np.argsort(-exact, kind="stable") if low <= exact[i] <= high and i != a][:3]
    assert min(n for early, n in seen if early) < 100
