"""Work on pairs that is never shuffled pair by pair."""

import random

from airloft.operators import placement as pl


def places(spark, n=80):
    rng = random.Random(2)
    return spark.createDataFrame([(f"{i:03d}", 30 + rng.random(), -97 + rng.random(), rng.random(), rng.random()) for i in range(n)], "id string, lat double, lon double, composite double, coverage_need double")


def test_pair_terms_and_objectives_do_not_shuffle_pairs(spark):
    cands = places(spark)
    linear, pair = pl.interaction_terms(cands)
    plan = pair._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" not in plan and "hashpartitioning(j#" not in plan
    assert plan.count("Join") == 1  # the pairs' own
    chosen = cands.selectExpr("CAST(id AS long) % 3 AS selection_id", "id").unionByName(cands.limit(9).selectExpr("7L AS selection_id", "id"))
    want = {r["selection_id"]: r["value"] for r in pl.objective(chosen, linear, pair).collect()}
    got = {r["selection_id"]: r["value"] for r in pl.selection_objective(chosen, cands).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_heldout_neighbours_by_brute_force_for_moving_sensors(spark):
    """Sensors with one reading a day take the streamed way, those with several the grouped one; both give what is left without the sensor."""
    from airloft.operators import joins

    rng = random.Random(3)
    data = [(str(i % 25), 30 + rng.random(), -97 + rng.random(), f"2025-01-0{1 + i // 25}", rng.random() * 40) for i in range(50)] + [("3", 30.5, -96.5, "2025-01-01", 11.0)]
    out = joins.neighbor_features_heldout(spark.createDataFrame(data, "sensor_id string, lat double, lon double, date string, pm25 double"))
    got = {(r["fold"], r["sensor_id"], r["date"], r["lat"]): r for r in out.collect()}
    for (fold, sid, day, lat), r in got.items():
        lon = next(x[2] for x in data if x[:2] == (sid, lat))
        near = [v for s, a, o, d, v in data if d == day and s not in (fold, sid) and _km(lat, lon, a, o) <= 50]
        assert r["nbr_count_50km"] == len(near)
        if near:
            assert abs(r["nbr_pm25_50km"] - sum(near) / len(near)) < 1e-9
    assert {k[0] for k in got if k[2] == "2025-01-01"} >= {"3", "4"}


def _km(a, b, c, d):
    from math import asin, cos, radians, sin, sqrt

    x = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * 6371.0 * asin(sqrt(x))


def test_pairs_of_small_tables_are_met_in_all_tasks(spark):
    from airloft.operators import joins

    rows = places(spark, 60).selectExpr("id AS a", "lat", "lon"), places(spark, 60).selectExpr("id AS b", "lat", "lon")
    assert joins.within(*rows, 20.0).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
