"""Points on the edges of shapes given by a formula, and polygons upon polygons."""

from airloft.operators import joins
from airloft.plans import views


def diamonds(spark, rows):
    """(date, tier, key, rings, x, y, w) of diamonds (date, tier, x, y, w)."""
    ring = lambda x, y, w: [[[x - w, y], [x, y - w], [x + w, y], [x, y + w], [x - w, y]]]
    return spark.createDataFrame([(d, t, i, ring(x, y, w), x, y, w) for i, (d, t, x, y, w) in enumerate(rows)], "date string, tier int, key int, rings array<array<array<double>>>, x double, y double, w double")


def lattice():
    """Places of the views' lattice at 0.5 degrees of longitude and 2 of latitude from others: on the edge of their diamond of 2.5, but for rounding."""
    return [(-106.0 + i / 84.0, 26.0 + j / 101.0, -106.0 + (i + 42) / 84.0, 26.0 + (j + 202) / 101.0) for i, j in ((k * 37 % 900, k * 53 % 700) for k in range(120))]


def test_formula_decides_on_the_edge(spark):
    places = lattice()
    shapes = diamonds(spark, [(str(i), 1 + i % 3, x, y, 2.5) for i, (x, y, _, _) in enumerate(places)])
    points = spark.createDataFrame([(str(i), str(i), b, a) for i, (_, _, a, b) in enumerate(places)], "id string, date string, lat double, lon double")
    inside = {str(i): abs(a - x) + abs(b - y) < 2.5 for i, (x, y, a, b) in enumerate(places)}
    assert len(set(inside.values())) == 2
    got = joins.smoke_tier(points, shapes.drop("key"), rule=views.in_diamond()).collect()
    assert {r["id"]: r["tier"] > 0 for r in got} == inside
    one = lambda i: (shapes.where(f"key = {i}").drop("key", "date", "tier"), points.where(f"id = '{i}'").drop("date"))
    for i in (0, 1, 2):
        shape, point = one(i)
        x, y, a, b = places[i]
        assert joins.inside_any(point, shape, rule=views.in_diamond(edge=True)).first()["in_tx"] == (abs(a - x) + abs(b - y) <= 2.5)
    days = joins.entity_day_tier(points.drop("date"), shapes.drop("key"), rule=views.in_diamond()).collect()
    assert {r["id"] for r in days if r["id"] == r["date"]} == {k for k, v in inside.items() if v}


def test_counts_and_highest_tiers_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(str(i % 2), 1 + i % 3, -106.0 + rng.randrange(1008) / 84.0, 26.0 + rng.randrange(1009) / 101.0, 0.05 * 2 ** (i % 8)) for i in range(60)]
    shapes = diamonds(spark, rows)
    spots = [(26.0 + rng.randrange(1009) / 101.0, -106.0 + rng.randrange(1008) / 84.0) for _ in range(150)] * 2
    points = spark.createDataFrame([(str(i), str(i % 2), *p) for i, p in enumerate(spots)] + [("none", "0", None, None)], "id string, date string, lat double, lon double")
    inside = lambda r, p: abs(p[1] - r[2]) + abs(p[0] - r[3]) < r[4]
    for rule in (views.in_diamond(), None):
        counts = {r["key"]: r["n"] for r in joins.count_in_polygons(points, shapes.drop("date", "tier"), "key", rule=rule).collect()}
        if rule is not None:
            assert counts == {k: n for k, r in enumerate(rows) if (n := sum(inside(r, p) for p in spots))}
    tiers = {r["id"]: r["tier"] for r in joins.smoke_tier(points, shapes.drop("key"), rule=views.in_diamond()).collect()}
    assert tiers == {str(i): max([r[1] for r in rows if r[0] == str(i % 2) and inside(r, p)], default=0) for i, p in enumerate(spots)} | {"none": 0}
    empty = shapes.limit(0)
    assert joins.count_in_polygons(points, empty.drop("date", "tier"), "key").count() == 0
    assert {r["tier"] for r in joins.smoke_tier(points, empty.drop("key")).collect()} == {0}
