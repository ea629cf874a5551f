"""Exact order statistics by counting ranges, against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloft.operators import quantiles as qu


def columns(kind, n, rng):
    if kind == "ties":
        return [rng.choice([0.0, 0.0, 0.0, 5.0, rng.random()]) for _ in range(n)]
    if kind == "skewed":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "constant":
        return [7.5] * n
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "constant"])
def test_quantiles_of_all_rows(spark, kind):
    rng = random.Random(kind)
    x, y = columns(kind, 4001, rng), columns("normal", 4001, rng)
    rows = [(a, b if i % 7 else None) for i, (a, b) in enumerate(zip(x, y))] + [(float("nan"), float("nan")), (None, None)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0)
    targets = {f"x{i}": (F.col("x"), s) for i, s in enumerate(shares)} | {"y": (F.col("y"), 0.5)}
    got = qu.quantiles(df, targets, in_place=20).first()
    for i, s in enumerate(shares):
        assert got[f"x{i}"] == pytest.approx(np.quantile(x, s), rel=1e-9), s
    assert got["y"] == pytest.approx(np.median([b for b in (r[1] for r in rows[:-2]) if b is not None]))


def test_quantiles_by_group(spark):
    rng = random.Random(2)
    groups = {"hot": columns("ties", 3000, rng), "warm": columns("normal", 500, rng), "cold": [1.0, 4.0], "none": [None, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    got = {r["g"]: (r["low"], r["mid"]) for r in qu.quantiles(df, {"low": (F.col("x"), 0.1), "mid": (F.col("x"), 0.5)}, "g", in_place=30).collect()}
    assert got["none"] == (None, None) and set(got) == set(groups)
    for g in ("hot", "warm", "cold"):
        assert got[g] == pytest.approx(tuple(np.quantile(groups[g], [0.1, 0.5])))


def test_pivots_that_miss_are_made_again(spark, monkeypatch):
    """Sketches that are far off only cost passes."""
    monkeypatch.setattr(qu, "PRECISION", 25)
    x = list(range(2000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    got = qu.quantiles(df, {"a": (F.col("x"), 0.31), "b": (F.col("x"), 0.93)}, in_place=150).first()
    assert (got["a"], got["b"]) == pytest.approx(tuple(np.quantile(x, [0.31, 0.93])))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert qu.quantiles(df, {"m": (F.col("x"), 0.5)}).collect()[0]["m"] is None
    assert qu.quantiles(df, {"m": (F.col("x"), 0.5)}, "g").collect() == []
