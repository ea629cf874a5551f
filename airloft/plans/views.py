"""Views of the domain derived from the given tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_precision


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(u: Column) -> tuple[Column, Column]:
    """A made-up but fixed position for an integer key."""
    lat = 26.0 + F.pmod(u * u * 31 + u * 7919, F.lit(1009)).cast("double") / 101.0
    lon = -106.0 + F.pmod(u * u * 17 + u * 104729, F.lit(1013)).cast("double") / 84.0
    return lat, lon


def events(spark, sf_dir) -> DataFrame:
    lat, lon = place(F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("sensor_id"), "user_id", "ts", "event_type", "value", "props", lat.alias("lat"), lon.alias("lon"))


def v_sensor(spark, sf_dir) -> DataFrame:
    lat, lon = place(F.col("user_id"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("sensor_id"), lat.alias("lat"), lon.alias("lon"))


def v_sensor_day(spark, sf_dir) -> DataFrame:
    ok = events(spark, sf_dir).where(F.col("value").between(0, 200))
    return ok.groupBy("sensor_id", "lat", "lon", F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("pm25"))


def v_tract(spark, sf_dir) -> DataFrame:
    lat, lon = place(F.col("c_custkey") + 500000)
    c = table(spark, sf_dir, "customer")
    ej = F.greatest(F.lit(0.0), F.col("c_acctbal")) / 100.0
    return c.select(F.concat(F.lit("48"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("GEOID"), lat.alias("lat"), lon.alias("lon"), ej.alias("ejf"), F.col("c_nationkey").alias("county"), "c_acctbal", "c_mktsegment")


def v_smoke(spark, sf_dir) -> DataFrame:
    """(poly, date, density, rings): a quad for each nation and day of January 2024."""
    return smoke_shapes(spark, sf_dir).drop("x", "y", "w")


def in_diamond(edge: bool = False) -> Column:
    """Whether a point (lat, lon) lies inside a diamond (x, y, w), or on its edge, by its formula: corners are rounded."""
    far = F.abs(F.col("lon") - F.col("x")) + F.abs(F.col("lat") - F.col("y"))
    return far <= F.col("w") if edge else far < F.col("w")


def smoke_shapes(spark, sf_dir) -> DataFrame:
    """v_smoke with the centre (x, y) and half the width (w) of each quad."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d"))
    y, x = place(F.col("k") * 31 + F.col("d"))
    w = 0.5 + (F.col("k") % 3).cast("double")
    density = F.element_at(F.array(*[F.lit(s) for s in ("Light", "Medium", "Heavy", "")]), (F.col("k") % 4 + 1).cast("int"))
    at = lambda dx, dy: F.array(F.col("x") + dx * F.col("w"), F.col("y") + dy * F.col("w"))
    base = n.select("k", "d", y.alias("y"), x.alias("x"), w.alias("w"), density.alias("density"))
    ring = F.array(at(-1, 0), at(0, -1), at(1, 0), at(0, 1), at(-1, 0))
    return base.select((F.col("k") * 100 + F.col("d")).alias("poly"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "density", F.array(ring).alias("rings"), "x", "y", "w")


def v_plume(spark, sf_dir) -> DataFrame:
    """(plume, date, tier, rings, x, y, w): a diamond for each supplier, from a twentieth of a degree to six degrees across."""
    y, x = place(F.col("s_suppkey") * 13)
    w = F.lit(0.05) * F.pow(F.lit(2.0), F.pmod(F.col("s_suppkey"), F.lit(8)).cast("double"))
    base = table(spark, sf_dir, "supplier").select("s_suppkey", y.alias("y"), x.alias("x"), w.alias("w"))
    at = lambda dx, dy: F.array(F.col("x") + dx * F.col("w"), F.col("y") + dy * F.col("w"))
    ring = F.array(at(-1, 0), at(0, -1), at(1, 0), at(0, 1), at(-1, 0))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("s_suppkey"), F.lit(29)).cast("int"))
    return base.select(F.col("s_suppkey").alias("plume"), day.alias("date"), (1 + F.pmod(F.col("s_suppkey"), F.lit(3))).cast("int").alias("tier"), F.array(ring).alias("rings"), "x", "y", "w")


def r6(c: Column | str) -> Column:
    return display_precision(F.col(c) if isinstance(c, str) else c)


# The same in SQL.


def sql_r6(expr: str) -> str:
    return f"round(({expr}) + 1.37e-8, 6)"


def sql_place(u: str) -> tuple[str, str]:
    return (
        f"(26.0::DOUBLE + CAST((({u}) * ({u}) * 31 + ({u}) * 7919) % 1009 AS DOUBLE) / 101.0::DOUBLE)",
        f"(-106.0::DOUBLE + CAST((({u}) * ({u}) * 17 + ({u}) * 104729) % 1013 AS DOUBLE) / 84.0::DOUBLE)",
    )


def sql_km(a: str, b: str, c: str, d: str, radius: str = "6371.0::DOUBLE") -> str:
    x = f"least(greatest(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"(2 * {radius} * asin(sqrt({x})))"


_LAT, _LON = sql_place("user_id")
_TLAT, _TLON = sql_place("c_custkey + 500000")
_SLAT, _SLON = sql_place("k * 31 + d")
_PLAT, _PLON = sql_place("s_suppkey * 13")
SQL = {
    "ev": f"ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS sensor_id, user_id, ts, event_type, value, props, {_LAT} AS lat, {_LON} AS lon FROM events)",
    "v_sensor": f"v_sensor AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id, {_LAT} AS lat, {_LON} AS lon FROM events)",
    "v_sensor_day": f"v_sensor_day AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, {_LAT} AS lat, {_LON} AS lon, CAST(ts AS DATE) AS date, avg(value) AS pm25 FROM events WHERE value BETWEEN 0 AND 200 GROUP BY ALL)",
    "v_tract": f"v_tract AS (SELECT '48' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS GEOID, {_TLAT} AS lat, {_TLON} AS lon, greatest(0.0::DOUBLE, c_acctbal) / 100.0::DOUBLE AS ejf, c_nationkey AS county, c_acctbal, c_mktsegment FROM customer)",
    "v_plume": f"v_plume AS (SELECT s_suppkey AS plume, DATE '2024-01-01' + CAST(s_suppkey % 29 AS INT) AS date, CAST(1 + s_suppkey % 3 AS INT) AS tier, {_PLAT} AS y, {_PLON} AS x, 0.05::DOUBLE * pow(2.0::DOUBLE, CAST(s_suppkey % 8 AS DOUBLE)) AS w FROM supplier)",
    "v_smoke": f"v_smoke AS (SELECT k * 100 + d AS poly, DATE '2024-01-01' + CAST(d AS INT) AS date, ['Light', 'Medium', 'Heavy', ''][CAST(k % 4 + 1 AS INT)] AS density, {_SLON} AS x, {_SLAT} AS y, 0.5::DOUBLE + CAST(k % 3 AS DOUBLE) AS w FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, unnest(range(0, 30)) AS d FROM nation))",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views (space-separated) in front; body may go on with more."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (", " if body.lstrip()[:1] == "," else " ") + body.lstrip().lstrip(",")
