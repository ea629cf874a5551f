"""Neighbour properties, edge cases of joins and aggregates, sources and sinks."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloft.operators import aggregates as agg, clean, interpolate as itp, joins, modelling as ml, placement as pl, windows as win
from airloft.sources import io

FORM = "sensor_id string, lat double, lon double, date date, pm25 double"


def sensor_days(seed, days=6):
    rng = random.Random(seed)
    places = [(30 + rng.uniform(-0.8, 0.8), -97 + rng.uniform(-0.8, 0.8)) for _ in range(8)] + [(34.5, -103.0)]
    return [(str(i), *p, date(2025, 1, 1) + timedelta(d), rng.uniform(0, 40)) for i, p in enumerate(places) for d in range(days) if rng.random() > 0.25]


def km(a, b):
    p, q = np.radians(a), np.radians(b)
    x = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(x)))


def brute(rows, pool, radii=(25, 50, 100)):
    out = {}
    grand = np.mean([r[4] for r in pool]) if pool else 0.0
    for s, la, lo, d, pm in rows:
        near = [(km((la, lo), (r[1], r[2])), r[4]) for r in pool if r[3] == d and r[0] != s]
        day = [r[4] for r in pool if r[3] == d]
        mean = {k: [v for x, v in near if x <= k] for k in radii}
        loo = (sum(day) - pm) / max(len(day) - 1, 1) if day else None
        m50 = np.mean(mean[50]) if mean[50] else (loo if loo is not None else grand)
        out[s, d] = [np.mean(mean[25]) if mean[25] else m50, len(mean[25]), m50, len(mean[50]), float(np.std(mean[50])) if mean[50] else 0.0, np.mean(mean[100]) if mean[100] else m50, len(mean[100])]
    return out


NAMES = ["nbr_pm25_25km", "nbr_count_25km", "nbr_pm25_50km", "nbr_count_50km", "nbr_std_50km", "nbr_pm25_100km", "nbr_count_100km"]


def check(df, expected):
    got = {(r["sensor_id"], r["date"]): [r[n] for n in NAMES] for r in df.collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert np.allclose(got[k], expected[k], atol=1e-9), k


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_equal_brute_force(spark, seed):
    rows = sensor_days(seed)
    df = spark.createDataFrame(rows, FORM)
    check(joins.neighbor_features(df, df), brute(rows, rows))


def test_neighbours_of_a_reduced_pool(spark):
    rows = sensor_days(7)
    df = spark.createDataFrame(rows, FORM)
    pool = [r for r in rows if r[0] != "2"]
    check(joins.neighbor_features(df, df.where("sensor_id <> '2'")), brute(rows, pool))


def test_held_out_neighbours(spark):
    rows = sensor_days(3)
    got = joins.neighbor_features_heldout(spark.createDataFrame(rows, FORM)).collect()
    assert got
    for r in got:
        pool = [x for x in rows if x[0] != r["fold"]]
        mine = [x for x in rows if x[0] == r["sensor_id"] and x[3] == r["date"]]
        want = brute(mine, pool)[r["sensor_id"], r["date"]]
        assert math.isclose(r["nbr_pm25_50km"], want[2], abs_tol=1e-9) and r["nbr_count_50km"] == want[3]


def test_held_out_deviations_and_all_radii(spark):
    import statistics

    rows = [r for r in sensor_days(5) if r[4] is not None]
    got = joins.neighbor_features_heldout(spark.createDataFrame(rows, FORM)).collect()
    assert got
    for r in got:
        near = {k: [x[4] for x in rows if x[3] == r["date"] and x[0] not in (r["sensor_id"], r["fold"]) and km((r["lat"], r["lon"]), x[1:3]) <= k] for k in (25, 50, 100)}
        assert [r[f"nbr_count_{k}km"] for k in near] == [len(v) for v in near.values()]
        assert math.isclose(r["nbr_std_50km"], statistics.pstdev(near[50]) if near[50] else 0.0, abs_tol=1e-6)
        for k, v in near.items():
            if v:
                assert math.isclose(r[f"nbr_pm25_{k}km"], statistics.fmean(v), abs_tol=1e-9)


def test_day_means_without_held_out_sites(spark):
    day = date(2025, 1, 1)
    rows = [("a", day, 4.0, False), ("b", day, 6.0, False), ("c", day, 50.0, True), ("d", day, None, False), ("e", date(2025, 1, 2), 9.0, False)]
    got = joins.day_mean_without(spark.createDataFrame(rows, "id string, date date, pm25 double, held boolean"), F.col("held"))
    assert {r["id"]: r["loo_mean"] for r in got.collect()} == {"a": 6.0, "b": 4.0, "c": 5.0, "d": 5.0, "e": None}


def test_lone_sensor_day_is_zero_not_null(spark):
    lone = [("a", 30.0, -97.0, date(2025, 1, 1), 9.0), ("b", 30.1, -97.0, date(2025, 1, 2), 5.0)]
    df = spark.createDataFrame(lone, FORM)
    missing = spark.createDataFrame([("c", 30.0, -97.0, date(2025, 1, 9), 4.0)], FORM)
    got = {r["sensor_id"]: r["nbr_pm25_50km"] for r in joins.neighbor_features(df.union(missing), df).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 7.0}


def test_radius_is_inclusive(spark):
    far = 50 / (6371 * math.pi / 180)
    rows = [("a", 30.0, -97.0, date(2025, 1, 1), 1.0), ("b", 30.0 + far * (1 - 1e-12), -97.0, date(2025, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, FORM)
    assert {r["nbr_count_50km"] for r in joins.neighbor_features(df, df).collect()} == {1}


def test_snapshot_gate(spark):
    pts = spark.createDataFrame([("p", 30.0, -97.0)], "id string, lat double, lon double")
    s = lambda n: spark.createDataFrame([(30.0 + i / 1000, -97.0, float(i)) for i in range(n)], "lat double, lon double, pm25 double")
    assert joins.point_neighbors(pts, s(19)).count() == 0 and joins.point_neighbors(pts, s(20)).count() == 1


def test_nearest_ties(spark):
    pts = spark.createDataFrame([(i, 30 + i / 50, -97.0) for i in range(20)] + [(99, None, 1.0)], "id int, lat double, lon double")
    t = spark.createDataFrame([("b", 31.0, -97.5), ("a", 31.0, -96.5), ("c", 20.0, -80.0)], "k string, lat double, lon double")
    got = {r["id"]: r["k"] for r in joins.nearest(pts, t, "k").collect()}
    assert got.pop(99) is None and set(got.values()) <= {"a", "b"} and len(got) == 20
    assert joins.nearest(pts, t.limit(0), "k").where("k IS NOT NULL OR km IS NOT NULL").count() == 0


def test_nearest_neighbours_anywhere(spark):
    import random

    def km(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))

    rng = random.Random(4)
    place = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    pts = [place() for _ in range(60)] + [(89.9, 10.0), (-90.0, 0.0), (10.0, 179.99), (10.0, -179.99), (30.0, -97.0)]
    close = [(40 + rng.random(), -90 + rng.random()) for _ in range(80)]  # far from most points, so reaches must widen
    for src in ([place() for _ in range(120)] + [(10.0, -179.98), (89.8, -170.0)], close):
        p = spark.createDataFrame([(i, *x) for i, x in enumerate(pts)], "id int, lat double, lon double")
        t = spark.createDataFrame([(i, *x) for i, x in enumerate(src)], "id int, lat double, lon double")
        got = {}
        for r in joins.knn(p, t, 3).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["source_id"]))
        want = {i: [j for _, j in sorted((km(x, y), j) for j, y in enumerate(src))[:3]] for i, x in enumerate(pts)}
        assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == want
        dist = {r["id"]: r["dist"] for r in joins.dist_to_set(p, t, 500.0).collect()}
        assert all(abs(dist[i] - min(500.0, min(km(x, y) for y in src))) < 1e-6 for i, x in enumerate(pts))
        pairs = {(r["id"], r["j"]) for r in joins.within(p, t.withColumnRenamed("id", "j"), 3000.0).collect()}
        assert pairs == {(i, j) for i, x in enumerate(pts) for j, y in enumerate(src) if km(x, y) <= 3000.0}
    two = spark.createDataFrame([(1, 10.0, 179.99), (2, 10.0, -179.99)], "id int, lat double, lon double")
    assert all(r["km"] < 3 for r in joins.nearest_other(two).collect()) and joins.nearest_other(two.limit(1)).first()["km"] is None


def test_cell_or_nearest_by_squares(spark):
    pts = [(30.2, -97.4), (50.0, 10.0), (0.0, 0.0), (-60.0, 170.0), (None, 1.0)]
    cells = [(30, -97, 1.0), (31, -100, 2.0), (48, 30, 3.0)]
    got = {r["i"]: r["value"] for r in joins.cell_or_nearest(spark.createDataFrame([(i, *x) for i, x in enumerate(pts)], "i int, lat double, lon double"), spark.createDataFrame(cells, "cy int, cx int, value double"), 9.0).collect()}
    best = lambda x: min(cells, key=lambda c: ((c[0] - x[0]) ** 2 + (c[1] - x[1]) ** 2, c))[2]
    assert got == {i: 9.0 if x[0] is None else best(x) for i, x in enumerate(pts)}


def test_short_ranking_is_filled_by_coverage(spark):
    form = "id string, lat double, lon double, composite double, coverage_need double"
    ranked = spark.createDataFrame([("a", 30.0, -97.0, 0.9, 0.0)], form)
    fill = spark.createDataFrame([("a", 30.0, -97.0, 0.9, 0.0), ("b", 32.0, -97.0, 0.5, 0.0), ("c", 34.0, -97.0, 0.3, 1.0), ("d", 30.01, -97.0, 0.8, 1.0)], form)
    got = pl.select_spaced(ranked, fill, 3).orderBy("pick").collect()
    assert [r["id"] for r in got] == ["a", "c", "b"] and [r["pick"] for r in got] == [1, 2, 3] and set(got[0].asDict()) == {"id", "lat", "lon", "composite", "coverage_need", "pick"}


def test_robust_z_with_flat_sensor(spark):
    rows = [("flat", 5.0)] * 5 + [("flat", 500.0)] + [("ok", float(v)) for v in range(10)]
    got = win.robust_z(spark.createDataFrame(rows, "sensor_id string, pm25 double"), "sensor_id", "pm25").groupBy("sensor_id").count().collect()
    assert dict(map(tuple, got)) == {"flat": 5, "ok": 10}


def test_median_fill_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert sorted(r[0] for r in clean.fill_median(df, ["v"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_spaced_top_k(spark):
    rows = [("a", 30.0, -97.0, 3.0), ("b", 30.01, -97.0, 2.9), ("c", 31.0, -97.0, 1.0)]
    got = win.spaced_top_k(spark.createDataFrame(rows, "id string, lat double, lon double, s double"), "s", 2)
    assert [r["id"] for r in got.orderBy("pick").collect()] == ["a", "c"]


def test_group_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(str(k), i) for k in range(7) for i in range(k + 1)], "k string, i int")
    folds = {r["k"]: r["fold"] for r in win.group_folds(df, "k", 3).collect()}
    sizes = [sum(int(k) + 1 for k, f in folds.items() if f == n) for n in range(3)]
    assert len(folds) == 7 and max(sizes) - min(sizes) <= 3
    assert set(r["fold"] for r in win.group_folds(df, "k", 3, most=2).collect()) <= {0, 1, 2}


def test_kriging_and_idw_edges(spark):
    form = "id string, lat double, lon double, resid double"
    src = spark.createDataFrame([("s", 30.0, -97.0, 2.0), ("t", 30.2, -97.0, 4.0)], form)
    at = spark.createDataFrame([("x", 30.0, -97.0), ("far", 50.0, -97.0)], "id string, lat double, lon double")
    assert {r["id"]: r["corr"] for r in itp.idw(at, src).collect()} == {"x": 2.0, "far": 0.0}
    got = {r["id"]: r["corr"] for r in itp.kriging(at, src, 60.0).collect()}
    assert got["far"] == 0.0 and 1.5 < got["x"] < 4.0


def test_ridge_loo_equals_refits(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(12, 2)), rng.normal(size=12)
    df = spark.createDataFrame([(str(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id string, u double, v double, resid double")
    got = {r["id"]: r["corr"] for r in itp.ridge_loo(df, ["u", "v"]).collect()}
    for i in range(12):
        k = np.arange(12) != i
        xm, ym = x[k].mean(0), y[k].mean()
        w = np.linalg.solve((x[k] - xm).T @ (x[k] - xm) + 2 * np.eye(2), (x[k] - xm).T @ (y[k] - ym))
        assert math.isclose(got[str(i)], ym + (x[i] - xm) @ w, abs_tol=1e-8)


def test_blend_weights_find_the_mix(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(10, 3, (3, 300))
    y = 0.7 * a + 0.3 * b
    df = spark.createDataFrame([(str(i % 15), *map(float, r)) for i, r in enumerate(zip(y, a, b, c))], "sensor_id string, y double, p_a double, p_b double, p_c double")
    w, report = ml.blend_weights(df, ["a", "b", "c"])
    got = {r["model"]: r["weight"] for r in w.where("blend = 'convex'").collect()}
    assert np.allclose([got["a"], got["b"], got["c"]], [0.7, 0.3, 0.0], atol=1e-6)
    assert all(r["r2"] > 0.999 for r in report.where("blend = 'convex'").collect())


def test_coverage_counts_differences(spark):
    form = "id string, lat double, lon double, ejf double"
    t = spark.createDataFrame([("a", 30.0, -97.0, 0.0), ("b", 30.5, -97.0, 10.0), ("c", 31.0, -97.0, 20.0)], form)
    old, new = t.where("id = 'a'").select("lat", "lon"), t.where("id = 'c'").select("lat", "lon")
    r = agg.coverage(t, new, old).first()
    assert (r["covered"], r["existing_covered"], r["new_covered"]) == (2, 1, 1)
    assert sum(r["total"] for r in agg.coverage_by_quartile(t, new, old).collect()) == 3


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "pop.xls").write_bytes("﻿OID_,ID,NAME\n1,48001,x\n2,,y\n".encode())
    pop = io.read_bom_csv(spark, str(tmp_path / "pop.xls"))
    assert pop.columns[0] == "OID_" and pop.where("ID IS NULL").count() == 1
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    io.write_map(df, str(tmp_path / "map"))
    assert sorted(map(tuple, io.read_map(spark, str(tmp_path / "map"), "k", "v").collect())) == [("a", 1.0), ("b", 2.0)]
    io.write_table(df, str(tmp_path / "t"), "k")
    assert io.read_table(spark, str(tmp_path / "t"), ["v"]).count() == 2
    io.write_csv(df, str(tmp_path / "c")), io.write_records(df, str(tmp_path / "r")), io.publish(df, str(tmp_path / "p"))
    assert io.load_or_none(spark, str(tmp_path / "p")).count() == 2 and io.load_or_none(spark, str(tmp_path / "none")) is None
    assert io.read_records(spark, str(tmp_path / "r")).count() == 2 and io.stage(df, str(tmp_path / "s")).count() == 2


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda g, kind, c: {"type": "Feature", "properties": {"GEOID": g, "NAME": "n"}, "geometry": {"type": kind, "coordinates": c}}
    import json

    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("1", "Polygon", [ring]), feature("2", "MultiPolygon", [[ring], [ring]])]}))
    got = {r["geoid"]: len(r["rings"]) for r in io.read_features(spark, str(tmp_path / "x.geojson")).collect()}
    assert got == {"1": 1, "2": 2}


def test_streaming_dedupe_and_gate(spark, tmp_path):
    from airloft.streaming import live

    spark.createDataFrame([("a", 1), ("b", 2)], "sensor_id string, n int").write.parquet(str(tmp_path / "in"))
    publish = live.publish_if_usable(str(tmp_path / "out"), 3)
    publish(spark.read.parquet(str(tmp_path / "in")), 0)
    assert io.load_or_none(spark, str(tmp_path / "out")) is None
    live.publish_if_usable(str(tmp_path / "out"), 2)(spark.read.parquet(str(tmp_path / "in")), 1)
    (tmp_path / "out" / "version=000000000009-x").mkdir()  # a write that failed
    assert io.load_or_none(spark, str(tmp_path / "out")).count() == 2
