"""Ties and edges that rounding would decide."""

import random

from pyspark.sql import functions as F

from airloft.operators import joins


def test_nearest_ties_go_to_the_smaller_key(spark):
    rng = random.Random(4)
    places = [(i, 27.0 + rng.random() * 9, -105.0 + rng.random() * 10, 0.001 + rng.random() * 0.01) for i in range(300)]
    points = spark.createDataFrame([(str(i), a, o) for i, a, o, _ in places], "id string, lat double, lon double")
    # As far to the east as to the west; rounding makes one of them nearer by some 1e-13 km.
    targets = spark.createDataFrame([(f"{side}{i:03d}", a, o + sign * d) for i, a, o, d in places for side, sign in (("a", 1), ("b", -1))], "GEOID string, lat double, lon double")
    near = joins.nearest(points, targets, "GEOID")
    pairs = points.crossJoin(targets.withColumnsRenamed({"lat": "y", "lon": "x"}))
    km = F.rint(joins.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) * 1e9)
    want = {r["id"]: r["k"][1] for r in pairs.groupBy("id").agg(F.min(F.struct(km, "GEOID")).alias("k")).collect()}
    assert {r["id"]: r["GEOID"] for r in near.collect()} == want
    known = points.where(F.col("id").cast("int") % 2 == 0).select("id", F.lit("x").alias("GEOID"))
    assert {r["id"]: r["GEOID"] for r in joins.assign_missing_key(points, known, targets).collect()} == {k: "x" if int(k) % 2 == 0 else v for k, v in want.items()}
