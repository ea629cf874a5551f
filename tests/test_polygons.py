"""Polygon covers against the ray test of every pair."""

import math
import random

from pyspark.sql import functions as F

from airloft.functions.geometry import contains
from airloft.operators import joins


def star(rng, x, y, r, n):
    points = [(x + r * f * math.cos(a), y + r * f * math.sin(a)) for a, f in ((2 * math.pi * i / n, rng.uniform(0.4, 1)) for i in range(n))]
    return [[list(p) for p in points] + [list(points[0])]]


def test_cover_finds_what_every_pair_tells(spark):
    rng = random.Random(7)
    shapes = [(i, star(rng, rng.uniform(-100, -95), rng.uniform(28, 33), r, n)) for i, (r, n) in enumerate([(0.01, 5), (0.3, 7), (2.0, 300), (6.0, 40), (0.0001, 4), (1.5, 3)])]
    ring, hole = star(rng, -97.0, 30.0, 3.0, 12)[0], star(rng, -97.0, 30.0, 1.0, 9)[0]
    shapes += [(50, [ring, hole]), (51, [[[-98.0, 29.0], [-96.0, 29.0], [-96.0, 31.0], [-98.0, 31.0], [-98.0, 29.0]]]), (52, [])]
    polygons = spark.createDataFrame(shapes, "shape int, rings array<array<array<double>>>")
    at = [(i, rng.uniform(27, 34), rng.uniform(-101, -94)) for i in range(3000)] + [(5000 + i, p[1], p[0]) for i, p in enumerate(shapes[1][1][0])] + [(6000, 30.0, -98.0), (6001, 29.0, -97.0), (6002, None, -97.0)]
    points = spark.createDataFrame(at, "id int, lat double, lon double")
    for boundary in (False, True):
        want = points.crossJoin(polygons).where(contains(F.col("rings"), F.col("lon"), F.col("lat"), boundary)).select("id", "shape")
        got = joins.in_polygons(points, polygons, (), boundary).select("id", "shape")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_large_areas_take_few_cells(spark):
    square = [[[-100.0, 28.0], [-92.0, 28.0], [-92.0, 36.0], [-100.0, 36.0], [-100.0, 28.0]]]
    wild = star(random.Random(2), -97.0, 31.0, 3.0, 600)
    cover = joins.polygon_cover(spark.createDataFrame([(1, square), (2, wild)], "shape int, rings array<array<array<double>>>"))
    cells = {r["shape"]: r["n"] for r in cover.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cells[1] < 100
    edges = cover.where("shape = 2 AND _edges IS NOT NULL").agg(F.avg(F.size("_edges"))).first()[0]
    assert edges < 120 and cover.where("shape = 2 AND _edges IS NULL").count() > 0  # of 600
    none = joins.in_polygons(spark.createDataFrame([(1, 30.0, -97.0)], "id int, lat double, lon double"), spark.createDataFrame([], "shape int, rings array<array<array<double>>>"))
    assert none.count() == 0 and none.columns == ["id", "lat", "lon", "shape"]
