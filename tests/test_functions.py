"""Hand-computed cases of scalar, band and geometry functions."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from airloft.functions import bands, geometry as geo, scalars as sc


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keys(spark):
    got = one(spark, sc.normalize_geoid(F.lit("123.0")), sc.normalize_geoid(F.lit("x")), sc.pad_key(F.lit("123456"), 3), sc.fips_key(F.lit(1), F.lit(22), F.lit(333)), sc.strip_county(F.lit("Travis COUNTY")), sc.canon_id(F.lit("42.0")))
    assert got == ("00000000123", None, "123456", "01022000333", "Travis", "42")


def test_aqi_and_bands(spark):
    values = [9.0, 9.04, 9.1, 13.0, 13.1, 17.0, 17.1, 35.4, 35.5, 325.5, -1.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", bands.epa_aqi(F.col("v")).alias("a"), bands.band_name(F.col("v")).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [50, 50, 51, 58, 58, 66, 66, 100, 101, 500, 0, None]
    assert [r["b"] for r in rows] == ["Good", "Moderate", "Moderate", "Moderate", "Elevated", "Elevated", "High", "High", "High", "High", "Good", None]


def test_color_ends(spark):
    assert one(spark, *[bands.pm_color(F.lit(v)) for v in (0.0, 9.0, 13.0, 17.0, 55.0, 900.0)]) == ("#90ee90", "#00b894", "#ffd700", "#e8590c", "#800000", "#800000")


def test_density(spark):
    got = one(spark, *[bands.density_tier(F.lit(x).cast("string")) for x in (None, "", " heavy ", "odd", "Light")])
    assert got == (0, 0, 3, 1, 1)


def test_grid_is_half_even(spark):
    assert one(spark, *[sc.cell_index(F.lit(x), 0.5) for x in (0.25, 0.75, -0.25)]) == (0, 2, 0)


def test_weekday_and_days(spark):
    got = one(spark, sc.weekday(F.lit(date(2024, 1, 1))), sc.epoch_day(F.lit(86399)), sc.from_ymd(F.lit("20240229")), sc.to_day(F.lit("bad")), sc.season(F.lit(12)))
    assert got == (0, date(1970, 1, 1), date(2024, 2, 29), None, "Winter")


def test_display_float(spark):
    assert one(spark, *[sc.display_float(F.lit(x).cast("string")) for x in (None, "NaN", "oops", "2.25")]) == (0.0, 0.0, 0.0, 2.2)


def test_parse_latlon(spark):
    rows = one(spark, *[sc.parse_latlon(F.lit(x)) for x in ("30.1, -97.5", "30.1", "a,b", "10,10")])
    assert [r["error"] for r in rows] == [None, "format", "number", "bounds"]
    assert rows[0]["lat"] == 30.1


def test_distance(spark):
    km, mi, zero = one(spark, sc.haversine_km(*map(F.lit, (30.0, -97.0, 31.0, -97.0))), sc.haversine_mi(*map(F.lit, (30.0, -97.0, 31.0, -97.0))), sc.haversine_km(*map(F.lit, (30.0, -97.0, 30.0, -97.0))))
    assert math.isclose(km, 6371 * math.pi / 180) and math.isclose(mi, 3959 * math.pi / 180) and zero == 0


SQUARE = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
HOLED = SQUARE + [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]


@pytest.mark.parametrize("x, y, boundary, rings, expected", [(2, 2, False, SQUARE, True), (5, 2, False, SQUARE, False), (4, 2, False, SQUARE, False), (4, 2, True, SQUARE, True), (0, 0, True, SQUARE, True), (2, 2, False, HOLED, False), (0.5, 2, False, HOLED, True)])
def test_contains(spark, x, y, boundary, rings, expected):
    df = spark.createDataFrame([(rings,)], "rings array<array<array<double>>>")
    assert df.select(geo.contains(F.col("rings"), F.lit(float(x)), F.lit(float(y)), boundary)).first()[0] is expected


def test_simplify(spark):
    ring = [[0.0, 0.0], [0.0001, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    tight = [[0.0, 0.0], [0.0001, 0.0], [0.0002, 0.0], [0.0001, 0.0001], [0.0, 0.0]]
    df = spark.createDataFrame([(ring,), (tight,)], "r array<array<double>>")
    got = [r[0] for r in df.select(geo.simplify_ring(F.col("r"), 0.001)).collect()]
    assert got[0] == ring[:1] + ring[2:] and got[1] == tight


def test_clean_rings(spark):
    df = spark.createDataFrame([([[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], [[0.0, 0.0]]],), ([[[0.0, 0.0]]],)], "r array<array<array<double>>>")
    got = [r[0] for r in df.select(geo.clean_rings(F.col("r"))).collect()]
    assert got == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], None]
