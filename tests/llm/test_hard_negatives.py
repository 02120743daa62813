"""Hard negatives: brute force, bounds, blocks, edges."""

import math
import random

import numpy as np

from talentgrid.llm import op13_hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, q string"


def brute(rows, every=50, positives=5, negatives=3):
    fine = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, lab, v in fine:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fine if j != i)
        for p, j, _ in [s for s in scored if s[2] == lab][:positives]:
            hard = [s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out |= {(i, j, k, s[1], -p, -s[0]) for k, s in enumerate(hard, 1)}
    return out


def mined(df, **more):
    return {tuple(r) for r in H.mine(df, **more).collect()}


def rows_of(rng, n, dim, labels, spread=1.0):
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [spread * (0.6 * centre[i % labels][d] + 0.3 * rng.gauss(0, 1) + 0.4) for d in range(dim)], i % labels, "x") for i in range(n)]


def test_brute_force_in_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = rows_of(rng, 700, 20, 4)
    rows += [(1000 + i, rows[7][1], 3, "x") for i in range(300)]  # one common vector and label
    df = spark.createDataFrame(rows, ROWS)
    want = brute(rows)
    assert mined(df) == want and len(want) > 40
    for name, value in (("LEAST_ROWS", 1), ("MOST_ROWS", 37), ("ANCHOR_ROWS", 3), ("STEP_ROWS", 10)):
        monkeypatch.setattr(H, name, value)
    assert mined(df) == want


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 16, 64, 67):
        x = rng.integers(-300, 300, (40, dim)).astype(np.float64)
        mean, dev = H.summaries(x)
        ia, ib = np.divmod(np.arange(1600), 40)
        exact, at, last = (x @ x.T).ravel(), 0, None
        for parts in H.LEVELS:
            size = np.diff(np.append(H.edges(dim, parts), dim))
            m, d = (v[:, at : at + len(size)] * np.sqrt(size) for v in (mean, dev))
            at += len(size)
            low, up = ((m @ m.T + s * (d @ d.T)).ravel() for s in (-1, 1))
            assert (low <= exact + 1e-6 * np.abs(exact) + 1e-6).all() and (exact <= up + 1e-6 * np.abs(exact) + 1e-6).all()
            assert last is None or (up <= last + 1e-6 * np.abs(last) + 1e-6).all()
            last = up
        assert at == mean.shape[1] == dev.shape[1] and len(ia) == len(ib)


def test_bands():
    p = np.array([-10, -1, 0, 1, 2, 3, 20, 21, 10**18 + 7])
    low, high = H.band(p)
    for k, v in enumerate(p.tolist()):
        near = [n for n in range(low[k] - 3, high[k] + 4) if 50 * v <= 100 * n <= 95 * v] if v < 100 else None
        assert near is None or near == list(range(low[k], high[k] + 1))
    assert (50 * int(p[-1]) <= 100 * int(low[-1]) < 50 * int(p[-1]) + 100) and (95 * int(p[-1]) - 100 < 100 * int(high[-1]) <= 95 * int(p[-1]))


def test_nulls_lengths_repeats_ties_and_nothing(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0], 1, None), (2, [1.0, 2.0, 5.0], 1, "a"), (3, [1.0], 1, "b"), (4, [], 1, "c"), (5, [0.7, 1.4], 2, "d"), (6, [0.7, 1.4], 2, "e"), (8, [0.7, 1.4], 3, "f"), (9, [0.6, 1.4], 3, "g"), (50, [1.0, 2.0], 9, "h")]
    bad = [(None, [1.0, 2.0], 1, "x"), (10, None, 1, "x"), (11, [1.0, None], 1, "x"), (12, [nan, 1.0], 1, "x"), (13, [inf, 1.0], 2, "x"), (14, [1.0, 2.0], None, "x")]
    rows = good + bad + [good[0], good[4]]  # two rows come twice
    got = mined(spark.createDataFrame(rows, ROWS))
    padded = [(i, [*v, *[0.0] * (3 - len(v))], lab, q) for i, v, lab, q in good]
    assert got == brute(padded) and {r[:4] for r in got} >= {(0, 2, 1, 5), (0, 2, 2, 6), (0, 2, 3, 8)}
    assert mined(spark.createDataFrame([], ROWS)) == set()
    assert mined(spark.createDataFrame(bad, ROWS)) == set()
    assert mined(spark.createDataFrame([(0, [], 1, "x"), (1, [], 1, "x"), (2, [], 2, "x")], ROWS)) == {(0, 1, 1, 2, 0, 0)}


def test_large_numbers_are_exact(spark):
    rows = [(0, [1e6, 3.0], 1, "x"), (1, [1e6, 1e6], 1, "x"), (2, [7e5, -2e6], 2, "x"), (3, [8e5, 9.0], 2, "x"), (4, [9.4e5, 1e3], 3, "x")]
    assert mined(spark.createDataFrame(rows, ROWS)) == brute(rows)
    huge = [(0, [1e30], 1, "x"), (1, [1e30], 1, "x"), (2, [1e29], 2, "x")]
    assert mined(spark.createDataFrame(huge, ROWS)) == set()  # both scores stay at the end of the range
