"""Queries over scalar and geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, features, geometry as geo, scalars as sc
from ..operators import clean
from .registry import query
from .views import events, r6, sql_km, sql_r6, table, v_sensor, v_sensor_day, v_smoke, v_tract, with_views

_PAD = "CASE WHEN length({0}) < {1} THEN lpad({0}, {1}, '0') ELSE {0} END"
_ODD = "CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_custkey || '.0' WHEN 2 THEN 'n/a' WHEN 3 THEN '48' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') ELSE NULL END"


def _odd_keys(df):
    k = F.col("c_custkey")
    text = k.cast("string")
    odd = F.when(k % 5 == 0, text).when(k % 5 == 1, F.concat(text, F.lit(".0"))).when(k % 5 == 2, "n/a").when(k % 5 == 3, F.concat(F.lit("48"), F.lpad(text, 11, "0")))
    return df.withColumn("raw", odd)


@query(
    "scalar_keys",
    f"""
    WITH k AS (SELECT c_custkey, c_nationkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' County' ELSE ' COUNTY' END AS nm, {_ODD} AS raw FROM customer),
    n AS (SELECT *, CAST(CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT) AS VARCHAR) AS d FROM k),
    g AS (SELECT *, {_PAD.format("d", 11)} AS geoid FROM n)
    SELECT c_custkey, geoid, substr(geoid, 1, 5) AS county, right(geoid, 6) AS suffix, d AS canon,
           {_PAD.format("CAST(c_nationkey AS VARCHAR)", 2)} || {_PAD.format("CAST(c_custkey % 1000 AS VARCHAR)", 3)} || {_PAD.format("CAST(c_custkey AS VARCHAR)", 6)} AS fips,
           regexp_replace(nm, '(?i) County$', '') AS name, coalesce(starts_with(geoid, '000'), false) AS low
    FROM g
    """,
)
def scalar_keys(spark, sf_dir):
    df = _odd_keys(table(spark, sf_dir, "customer")).withColumn("geoid", sc.normalize_geoid(F.col("raw")))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " County").otherwise(" COUNTY"))
    return df.select(
        "c_custkey", "geoid", sc.county_of(F.col("geoid")).alias("county"), sc.tract_suffix(F.col("geoid")).alias("suffix"), sc.canon_id(F.col("raw")).alias("canon"),
        sc.fips_key(F.col("c_nationkey"), F.col("c_custkey") % 1000, F.col("c_custkey")).alias("fips"), sc.strip_county(name).alias("name"), F.coalesce(sc.has_prefix(F.col("geoid"), "000"), F.lit(False)).alias("low"),
    )


@query(
    "scalar_parse_latlon",
    with_views(
        "v_sensor",
        f"""
        , t AS (SELECT sensor_id, CASE CAST(sensor_id AS BIGINT) % 4 WHEN 0 THEN CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR)
                       WHEN 1 THEN 'lat,' || CAST(lon AS VARCHAR) WHEN 2 THEN '12' ELSE '60,' || CAST(lon AS VARCHAR) END AS t, lat, lon FROM v_sensor)
        SELECT sensor_id,
               CASE CAST(sensor_id AS BIGINT) % 4 WHEN 1 THEN 'number' WHEN 2 THEN 'format' WHEN 3 THEN 'bounds'
                    ELSE CASE WHEN NOT (lat BETWEEN 25.5 AND 36.6 AND lon BETWEEN -107 AND -93) THEN 'bounds' END END AS error,
               CASE WHEN CAST(sensor_id AS BIGINT) % 4 = 0 AND lat BETWEEN 25.5 AND 36.6 AND lon BETWEEN -107 AND -93 THEN {sql_r6("lat")} END AS lat
        FROM t
        """,
    ),
)
def scalar_parse_latlon(spark, sf_dir):
    k = F.col("sensor_id").cast("long") % 4
    lat, lon = F.col("lat").cast("string"), F.col("lon").cast("string")
    text = F.when(k == 0, F.concat(lat, F.lit(", "), lon)).when(k == 1, F.concat(F.lit("lat,"), lon)).when(k == 2, "12").otherwise(F.concat(F.lit("60,"), lon))
    p = v_sensor(spark, sf_dir).select("sensor_id", sc.parse_latlon(text).alias("p"))
    return p.select("sensor_id", F.col("p.error").alias("error"), r6("p.lat").alias("lat"))


@query(
    "scalar_time",
    f"""
    WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, month(ts) AS m FROM events)
    SELECT event_id, d AS day, strftime(d, '%Y%m%d') AS ymd, d AS back, d AS epoch, m AS month, CAST(hour(ts) AS INT) AS hour,
           CAST((isodow(ts) - 1) AS INT) AS dow, CAST(dayofyear(ts) AS INT) AS doy,
           {sql_r6("sin(2 * pi() * m / 12)")} AS month_sin, {sql_r6("cos(2 * pi() * m / 12)")} AS month_cos, {sql_r6("sin(2 * pi() * dayofyear(ts) / 365)")} AS doy_sin,
           CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Spring' WHEN m IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
    FROM e
    """,
    dates=("day", "back", "epoch"),
)
def scalar_time(spark, sf_dir):
    ts, day = F.col("ts"), F.col("ts").cast("date")
    m = F.month("ts")
    ms, mc = sc.cyclic(m, 12)
    return table(spark, sf_dir, "events").select(
        "event_id", sc.to_day(ts.cast("string")).alias("day"), sc.ymd(day).alias("ymd"), sc.from_ymd(sc.ymd(day)).alias("back"), sc.epoch_day(F.unix_seconds(ts.cast("timestamp"))).alias("epoch"),
        m.alias("month"), F.hour(ts).alias("hour"), sc.weekday(ts).alias("dow"), F.dayofyear(ts).alias("doy"),
        r6(ms).alias("month_sin"), r6(mc).alias("month_cos"), r6(sc.cyclic(F.dayofyear(ts), 365)[0]).alias("doy_sin"), sc.season(m).alias("season"),
    )


@query(
    "scalar_units",
    f"""
    SELECT event_id, {sql_r6("value * 9 / 5 + 32")} AS f, {sql_r6("value * 2.23694::DOUBLE")} AS mph, {sql_r6("value / 3.6::DOUBLE")} AS ms, {sql_r6("value * 10")} AS hpa,
           CASE WHEN event_id % 7 <> 0 THEN {sql_r6("value")} END AS seen, {sql_r6("ln(1 + greatest(value, 0))")} AS fit, {sql_r6("greatest(0, exp(least(value, 5)) - 1)")} AS orig,
           {sql_r6("value * event_id % 50 / 100.0::DOUBLE")} AS inter, {sql_r6("(value * 0.4::DOUBLE + 0.3::DOUBLE * 5) / 100")} AS urban
    FROM events WHERE value IS NOT NULL
    """,
)
def scalar_units(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        "event_id", r6(sc.c_to_f(v)).alias("f"), r6(sc.ms_to_mph(v)).alias("mph"), r6(sc.kmh_to_ms(v)).alias("ms"), r6(sc.kpa_to_hpa(v)).alias("hpa"),
        r6(sc.null_if_sentinel(F.when(F.col("event_id") % 7 == 0, -999.0).otherwise(v))).alias("seen"), r6(sc.fit_scale(F.greatest(v, F.lit(0.0)))).alias("fit"),
        r6(sc.orig_scale(F.least(v, F.lit(5.0)))).alias("orig"), r6(v * F.col("event_id") % 50 / 100.0).alias("inter"), r6(sc.urban_index(v, F.lit(5.0), F.lit(None).cast("double"))).alias("urban"),
    )


@query(
    "scalar_distance",
    with_views(
        "v_sensor",
        f"""
        SELECT sensor_id, {sql_r6(sql_km("lat", "lon", "31.0::DOUBLE", "-97.0::DOUBLE"))} AS km, {sql_r6(sql_km("lat", "lon", "31.0::DOUBLE", "-97.0::DOUBLE", "3959.0::DOUBLE"))} AS mi,
               {sql_r6("least(" + ", ".join(sql_km("lat", "lon", f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in sc.COAST) + ")")} AS coast,
               {sql_r6("least(" + ", ".join(sql_km("lat", "lon", f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in sc.METROS) + ")")} AS metro,
               CAST(round_even(lat / 0.5, 0) AS INT) AS cy, CAST(round_even(lon / 0.5, 0) AS INT) AS cx,
               {sql_r6("abs(lon + 94)")} AS coast_proxy, {sql_r6("abs(lat - 26)")} AS border_proxy, lat BETWEEN 25.5 AND 36.6 AND lon BETWEEN -107 AND -93 AS inside
        FROM v_sensor
        """,
    ),
)
def scalar_distance(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    at = (F.lit(31.0), F.lit(-97.0))
    return v_sensor(spark, sf_dir).select(
        "sensor_id", r6(sc.haversine_km(lat, lon, *at)).alias("km"), r6(sc.haversine_mi(lat, lon, *at)).alias("mi"), r6(sc.min_dist(lat, lon, sc.COAST)).alias("coast"), r6(sc.min_dist(lat, lon, sc.METROS)).alias("metro"),
        sc.cell_index(lat, 0.5).alias("cy"), sc.cell_index(lon, 0.5).alias("cx"), r6(sc.coast_proxy(lon)).alias("coast_proxy"), r6(sc.border_proxy(lat)).alias("border_proxy"), sc.in_box(lat, lon).alias("inside"),
    )


def _sql_band(pm: str, values) -> str:
    return f"CASE WHEN {pm} <= 9 THEN {values[0]} WHEN {pm} <= 13 THEN {values[1]} WHEN {pm} <= 17 THEN {values[2]} ELSE {values[3]} END"


def _sql_color(pm: str) -> str:
    out, low = [], 0.0
    for _, top, _, (a, b), _ in bands.BANDS:
        part = f"least(({pm} - {low}::DOUBLE) / {bands.HIGH_SPAN if top is None else top - low}::DOUBLE, 1.0::DOUBLE)"
        out.append(" || ".join(["'#'", *(f"lpad(lower(to_hex(CAST(floor({a >> s & 255} + ({(b >> s & 255) - (a >> s & 255)}) * {part} + 0.5) AS BIGINT))), 2, '0')" for s in (16, 8, 0))]))
        low = top
    return _sql_band(pm, out)


def _sql_aqi(pm: str) -> str:
    c, out = f"greatest(0.0::DOUBLE, floor({pm} * 10) / 10)", []
    for lo, hi, a, b in bands.AQI_STEPS:
        start = f"CASE WHEN {c} >= {lo}::DOUBLE THEN {lo}::DOUBLE ELSE 0.0::DOUBLE END"
        out.append(f"WHEN {c} <= {hi}::DOUBLE THEN CAST(round_even({b - a} / ({hi}::DOUBLE - ({start})) * ({c} - ({start})) + {a}, 0) AS INT)")
    return f"CASE {' '.join(out)} ELSE 500 END"


_NAMES = [f"'{n}'" for n in bands.NAMES]
_RANGES = [f"'{b[2]}'" for b in bands.BANDS]


@query(
    "scalar_bands",
    with_views("v_sensor_day", f"SELECT sensor_id, date, {_sql_aqi('pm25')} AS aqi, {_sql_band('pm25', _NAMES)} AS category, {_sql_band('pm25', _RANGES)} AS aqi_range, {_sql_color('pm25')} AS color FROM v_sensor_day"),
    dates=("date",),
)
def scalar_bands(spark, sf_dir):
    pm = F.col("pm25")
    out = v_sensor_day(spark, sf_dir).select("sensor_id", "date", bands.epa_aqi(pm).alias("aqi"), bands.pm_band(pm).alias("b"), bands.pm_color(pm).alias("color"))
    return out.select("sensor_id", "date", "aqi", F.col("b.category").alias("category"), F.col("b.aqi_range").alias("aqi_range"), "color")


@query(
    "scalar_labels",
    with_views(
        "v_smoke",
        """
        , t AS (SELECT poly, density, x, y FROM v_smoke)
        SELECT poly, CASE WHEN density = '' THEN 0 WHEN density = 'Light' THEN 1 WHEN density = 'Medium' THEN 2 ELSE 3 END AS tier,
               CASE WHEN y < 25.84 THEN 'Mexico' WHEN x < -103.043 THEN 'New Mexico'
                    WHEN (y > 36.5 AND x BETWEEN -103.043 AND -94.43) OR (y BETWEEN 33.5 AND 37.0 AND x BETWEEN -100.0 AND -94.43) THEN 'Oklahoma'
                    WHEN x > -94.43 AND y >= 33.0 THEN 'Arkansas' WHEN x > -94.04 AND y < 33.0 THEN 'Louisiana' WHEN x > -97 AND y < 27 THEN 'Gulf of Mexico'
                    ELSE 'Outside TX (unclassified)' END AS label
        FROM t
        """,
    ),
)
def scalar_labels(spark, sf_dir):
    d = v_smoke(spark, sf_dir).withColumn("b", geo.bbox(F.col("rings")))
    y, x = (F.col("b.ymin") + F.col("b.ymax")) / 2, (F.col("b.xmin") + F.col("b.xmax")) / 2
    return d.select("poly", bands.density_tier(F.col("density")).alias("tier"), bands.outside_label(y, x).alias("label"))


@query(
    "geometry_bounds",
    with_views("v_smoke", f"SELECT {sql_r6('min(x - w)')} AS xmin, {sql_r6('min(y - w)')} AS ymin, {sql_r6('max(x + w)')} AS xmax, {sql_r6('max(y + w)')} AS ymax FROM v_smoke"),
)
def geometry_bounds(spark, sf_dir):
    b = geo.bounds(v_smoke(spark, sf_dir))
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query(
    "geometry_box_filter",
    with_views("v_smoke", "SELECT poly FROM v_smoke WHERE x + w >= -100 AND x - w <= -96 AND y + w >= 28 AND y - w <= 31"),
)
def geometry_box_filter(spark, sf_dir):
    return v_smoke(spark, sf_dir).where(geo.box_overlaps(geo.bbox(F.col("rings")), -100.0, 28.0, -96.0, 31.0)).select("poly")


@query(
    "geometry_simplify",
    with_views(
        "v_smoke",
        f"""
        , k AS (SELECT poly, CASE WHEN w * sqrt(2) <= 1.0 THEN 5 ELSE 5 END AS before, w FROM v_smoke)
        SELECT poly, CAST(5 AS INT) AS before, CAST(5 AS INT) AS after FROM k
        """,
    ),
)
def geometry_simplify(spark, sf_dir):
    """Quads have five points; a tolerance below their sides keeps them all."""
    p = v_smoke(spark, sf_dir).withColumn("rings", geo.clean_rings(F.col("rings")))
    s = geo.simplify_features(p.withColumn("old", F.col("rings")), 0.1)
    return s.select("poly", geo.vertex_count(F.col("old")).alias("before"), geo.vertex_count(F.col("rings")).alias("after"))


@query("geometry_vertex_report", with_views("v_smoke", "SELECT CAST(5 * count(*) AS BIGINT) AS before, CAST(5 * count(*) AS BIGINT) AS after, 0.0::DOUBLE AS removed_pct FROM v_smoke"))
def geometry_vertex_report(spark, sf_dir):
    p = v_smoke(spark, sf_dir)
    return geo.vertex_report(p, geo.simplify_features(p, 0.1))


@query(
    "display_and_precedence",
    with_views(
        "ev",
        f"""
        SELECT event_id, coalesce(round_even(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE CAST(CAST(floor(value) AS INT) AS VARCHAR) END AS DOUBLE), 1), 0.0) AS shown,
               {sql_r6("CASE WHEN event_id % 3 = 0 THEN 7.5 ELSE floor(value) END")} AS a, 2.0::DOUBLE AS b, 0.0::DOUBLE AS c
        FROM ev WHERE value IS NOT NULL
        """,
    ),
)
def display_and_precedence(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.floor("value").cast("string"))
    rows = events(spark, sf_dir).where("value IS NOT NULL").select("event_id", raw.alias("a"))
    out = clean.fill_by_precedence(rows.withColumn("shown", sc.display_float(F.col("a"))), ["a", "b", "c"], {"a": 7.5}, {"b": 2.0})
    return out.select("event_id", "shown", r6("a").alias("a"), "b", "c")


@query(
    "tract_lookup_by_key",
    with_views("v_tract", f"SELECT GEOID, {sql_r6('lat')} AS lat, {sql_r6('ejf')} AS ejf FROM v_tract WHERE GEOID = '48000000007'"),
)
def tract_lookup_by_key(spark, sf_dir):
    return clean.tract_by_id(v_tract(spark, sf_dir), "48000000007").select("GEOID", r6("lat").alias("lat"), r6("ejf").alias("ejf"))


@query(
    "feature_columns",
    f"""
    WITH e AS (SELECT event_id, ts - INTERVAL 6 HOURS AS t, value, event_id % 3 AS k FROM events WHERE value IS NOT NULL)
    SELECT event_id, CAST(hour(t) AS INT) AS hour, CAST(isodow(t) - 1 AS INT) AS dow, {sql_r6("cos(2 * pi() * (isodow(t) - 1) / 7)")} AS dow_cos, {sql_r6("sin(2 * pi() * dayofyear(t) / 365)")} AS doy_sin,
           {sql_r6("value * 50 / 100")} AS temp_humidity, {sql_r6("CASE k WHEN 0 THEN value WHEN 1 THEN value / 3.6::DOUBLE ELSE value / 2.23694::DOUBLE END * value / 100")} AS wind_temp
    FROM e
    """,
)
def feature_columns(spark, sf_dir):
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumns({"temperature": F.col("value"), "humidity": F.lit(50.0), "unit": F.when(k == 0, "m/s").when(k == 1, "km/h").otherwise("mph")})
    out = features.interactions(features.time_parts(e.withColumn("wind", features.wind_ms(F.col("value"), F.col("unit"))), "ts", "America/Chicago"))
    return out.select("event_id", "hour", "dow", r6("dow_cos").alias("dow_cos"), r6("doy_sin").alias("doy_sin"), r6("temp_humidity").alias("temp_humidity"), r6("wind_temp").alias("wind_temp"))
