"""Spaced selection, blend weights, calibration and local solves against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloft.operators import interpolate as itp, modelling as ml, windows as win


def miles(a, b):
    from math import asin, cos, radians, sin, sqrt

    x = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3959.0 * asin(sqrt(min(1.0, x)))


@pytest.mark.parametrize("k,kept", [(5, ()), (900, ()), (2000, ((30.0, -97.0), (30.5, -97.5)))])
def test_rounds_pick_what_greedy_picks(spark, k, kept):
    rng = random.Random(k)
    rows = [(i, 29 + 3 * rng.random(), -99 + 3 * rng.random(), float(rng.randrange(40))) for i in range(2500)] + [(9001, None, -97.0, 99.0), (9002, 30.0, -97.0, None)]
    want, near = [], list(kept)
    for i, lat, lon, s in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (-r[3], r[0])):
        if len(want) < k and all(abs(lat - a) > 0.12 or miles((lat, lon), (a, b)) >= 8 for a, b in near):
            want.append(i)
            near.append((lat, lon))
    got = win.spaced_top_k(spark.createDataFrame(rows, "id long, lat double, lon double, s double"), "s", k, 8.0, kept).orderBy("pick").collect()
    assert [r["id"] for r in got] == want and [r["pick"] for r in got] == list(range(1, len(want) + 1))


def by_supports(a, b, summed):
    """The best of the stationary points of all supports."""
    k, best, value = len(b), None, 0.0 if not summed else np.inf
    for size in range(1, k + 1):
        for s in map(list, combinations(range(k), size)):
            system, right = np.zeros((size + summed, size + summed)), np.ones(size + summed)
            system[:size, :size], right[:size] = a[np.ix_(s, s)], b[s]
            system[size:, :size], system[:size, size:] = 1.0, 1.0
            w = np.zeros(k)
            w[s] = np.linalg.lstsq(system, right, rcond=None)[0][:size]
            now = w @ a @ w - 2 * b @ w
            if (w >= -1e-12).all() and now < value - 1e-12:
                best, value = w, now
    return np.zeros(k) if best is None else best


@pytest.mark.parametrize("summed", [True, False])
def test_active_set_finds_the_best_support(summed):
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.normal(size=(40, 6)) + rng.normal(size=(40, 1))
        y = x @ np.maximum(rng.normal(size=6), 0) + rng.normal(size=40)
        a, b = x.T @ x, x.T @ y
        assert ml.active_set(a, b, summed) == pytest.approx(by_supports(a, b, summed), abs=1e-6)
    x = rng.normal(size=(500, 1)) + 0.1 * rng.normal(size=(500, 25))
    x[:, 3] = x[:, 4]
    w = ml.active_set(x.T @ x, x.T @ x[:, 4] * 1.1, summed)
    assert (w >= 0).all() and (not summed or w.sum() == pytest.approx(1))


def test_min_max_form_is_the_monotone_fit(spark):
    rng = random.Random(6)
    bins = [(f, b, 0.0 if b == 7 else sum(y), 0 if b == 7 else len(y)) for f in range(2) for b in range(20) for y in [[rng.gauss(b / 4, 3) for _ in range(rng.randint(1, 5))]]]
    got = {(r["f"], r["bin"]): r["cal"] for r in ml.isotonic_bins(spark.createDataFrame(bins, "f int, bin long, s double, n long"), "f").collect()}
    for f in range(2):
        pools = []
        for _, b, s, n in (x for x in bins if x[0] == f and x[3]):
            pools.append([s, n, [b]])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s2, n2, b2 = pools.pop()
                pools[-1] = [pools[-1][0] + s2, pools[-1][1] + n2, pools[-1][2] + b2]
        want = {b: s / n for s, n, bs in pools for b in bs}
        want[7] = want[6]
        assert {b: got[f, b] for b in range(20)} == pytest.approx(want)


def test_stacked_kriging_solves_each_system(spark):
    rng = random.Random(3)
    rows = [(i, 30 + 2 * rng.random(), -97 + 2 * rng.random(), rng.gauss(0, 2)) for i in range(30)] + [(99, 45.0, -80.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, resid double")
    got = {r["id"]: r["corr"] for r in itp.kriging(df, df, k=6, exclude_self=True).collect()}
    km = lambda p, q: miles(p, q) * 6371.0 / 3959.0
    for i, lat, lon, _ in rows:
        near = sorted((km((lat, lon), r[1:3]), r[0], r) for r in rows if r[0] != i)[:6]
        h, x = np.array([n[0] for n in near]), np.array([n[2][3] for n in near])
        c = lambda d: np.var(x) * np.exp(-3 * d / 60.0)
        m = np.ones((7, 7))
        m[:6, :6], m[6, 6] = [[c(km(p[2][1:3], q[2][1:3])) for q in near] for p in near], 0
        w = np.linalg.solve(m + 1e-6 * np.eye(7), np.append(c(h), 1.0))[:6]
        assert got[i] == pytest.approx(0.0 if (h > 180).all() else w @ x, abs=1e-6)


def test_leverage_form_leaves_one_out(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(30, 1, size=(25, 3)), rng.normal(size=25)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, resid double")
    got = {r["id"]: r["corr"] for r in itp.ridge_loo(df, ["a", "b", "c"]).collect()}
    for i in range(25):
        keep = np.arange(25) != i
        mx, my = x[keep].mean(axis=0), y[keep].mean()
        z = x[keep] - mx
        assert got[i] == pytest.approx(my + (x[i] - mx) @ np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y[keep] - my)), abs=1e-9)
    assert itp.ridge_loo(df.limit(1), ["a"]).first()["corr"] == 0
