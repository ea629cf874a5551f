"""Queries over aggregates, windows, interpolation, models and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg, interpolate as itp, joins, modelling as ml, placement as pl, windows as win
from ..sources.io import shared_folder, written
from .registry import query
from .views import events, r6, sql_km, sql_r6, table, v_sensor, v_sensor_day, v_tract, with_views

R = sql_r6


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# Aggregates


@query("sensor_stats", with_views("v_sensor_day", f"SELECT sensor_id, {R('stddev_samp(pm25)')} AS std, {R('median(pm25)')} AS median, count(pm25) AS n FROM v_sensor_day GROUP BY 1"))
def sensor_stats(spark, sf_dir):
    return rounded(agg.sensor_stats(v_sensor_day(spark, sf_dir)), "std", "median")


@query("climatology", with_views("v_sensor_day", f"SELECT sensor_id, {R('arg_min(lat, date)')} AS lat, {R('arg_min(lon, date)')} AS lon, {R('avg(pm25)')} AS mean, count(*) AS n FROM v_sensor_day GROUP BY 1"))
def climatology(spark, sf_dir):
    return rounded(agg.climatology(v_sensor_day(spark, sf_dir)), "lat", "lon", "mean")


def _oof(spark, sf_dir):
    """Out-of-fold rows with a few made-up models."""
    d = v_sensor_day(spark, sf_dir).withColumn("u", F.col("sensor_id").cast("long"))
    day = F.dayofmonth("date")
    return d.select("sensor_id", "date", "lat", "lon", F.col("pm25").alias("y"), (F.col("u") % 5 != 0).alias("valid"), (F.col("pm25") * 0.8 + day).alias("p_a"), (F.col("pm25") * 0.5 + F.col("u") % 17).alias("p_b"), (20.0 + day + F.col("u") % 7).alias("p_c"), F.concat(F.lit("48"), F.lpad((F.col("u") % 11).cast("string"), 9, "0")).alias("GEOID"))


_OOF = "oof AS (SELECT sensor_id, date, lat, lon, pm25 AS y, CAST(sensor_id AS BIGINT) % 5 <> 0 AS valid, pm25 * 0.8::DOUBLE + day(date) AS p_a, pm25 * 0.5::DOUBLE + CAST(sensor_id AS BIGINT) % 17 AS p_b, CAST(20 + day(date) + CAST(sensor_id AS BIGINT) % 7 AS DOUBLE) AS p_c, '48' || lpad(CAST(CAST(sensor_id AS BIGINT) % 11 AS VARCHAR), 9, '0') AS GEOID FROM v_sensor_day)"


@query("residual_by_sensor", with_views("v_sensor_day", f", {_OOF} SELECT sensor_id, {R('avg(y - p_a)')} AS resid, count(*) AS n FROM oof GROUP BY 1"))
def residual_by_sensor(spark, sf_dir):
    return rounded(agg.residual_by_sensor(_oof(spark, sf_dir).withColumn("p", F.col("p_a"))).select("sensor_id", "resid", "n"), "resid")


@query("residual_by_tract", with_views("v_sensor_day", f", {_OOF} SELECT GEOID, round(avg(abs(y - p_a)), 4) AS residual FROM oof WHERE valid GROUP BY 1"))
def residual_by_tract(spark, sf_dir):
    return agg.residual_by_tract(_oof(spark, sf_dir).withColumn("p", F.col("p_a")))


@query("daily_mean", with_views("ev", f"SELECT sensor_id, CAST(ts AS DATE) AS date, {R('avg(value)')} AS value FROM ev GROUP BY 1, 2"), dates=("date",))
def daily_mean(spark, sf_dir):
    return rounded(agg.daily_mean(events(spark, sf_dir), "sensor_id", "ts", ["value"]), "value")


@query("today_mean", with_views("v_sensor_day", f"SELECT sensor_id, {R('''coalesce(avg(CASE WHEN date = DATE '2024-01-15' THEN pm25 END), avg(pm25))''')} AS pm25 FROM v_sensor_day GROUP BY 1"))
def today_mean(spark, sf_dir):
    return rounded(agg.today_mean(v_sensor_day(spark, sf_dir), "2024-01-15", "sensor_id", "pm25"), "pm25")


@query("coverage_share", f"SELECT 'value' AS col, {R('count(value) / count(*)')} AS filled, {R('count(*) FILTER (WHERE value > 0) / count(*)')} AS positive FROM events UNION ALL SELECT 'user_id', {R('count(user_id) / count(*)')}, {R('count(*) FILTER (WHERE user_id > 0) / count(*)')} FROM events")
def coverage_share(spark, sf_dir):
    return rounded(agg.coverage_share(table(spark, sf_dir, "events"), ["value", "user_id"]), "filled", "positive")


@query("pearson", with_views("v_sensor_day", f", {_OOF} SELECT {R('corr(y, p_c)')} AS r FROM oof"))
def pearson(spark, sf_dir):
    return rounded(agg.pearson(_oof(spark, sf_dir), "y", "p_c"), "r")


@query("percentiles", with_views("v_tract", "SELECT " + ", ".join(f"{R(f'quantile_cont(ejf, {p / 100})')} AS p{p}" for p in (25, 50, 75, 95, 99)) + " FROM v_tract"))
def percentiles(spark, sf_dir):
    out = agg.percentiles(v_tract(spark, sf_dir), "ejf", (25, 50, 75, 95, 99))
    return rounded(out, *out.columns)


_METRIC = "count(*) AS n, {0} AS rmse, {1} AS mae, {2} AS r2".format(R("sqrt(avg((p_a - y) * (p_a - y)))"), R("avg(abs(p_a - y))"), R("1 - sum((p_a - y) * (p_a - y)) / (sum(y * y) - sum(y) * sum(y) / count(*))"))


@query("regression_metrics", with_views("v_sensor_day", f", {_OOF} SELECT {_METRIC} FROM oof"))
def regression_metrics(spark, sf_dir):
    return rounded(agg.regression_metrics(_oof(spark, sf_dir), "y", "p_a"), "rmse", "mae", "r2")


@query("metrics_by_site", with_views("v_sensor_day", f", {_OOF} SELECT GEOID, {_METRIC} FROM oof GROUP BY 1 HAVING count(*) >= 3"))
def metrics_by_site(spark, sf_dir):
    return rounded(agg.metrics_by(_oof(spark, sf_dir), "GEOID", 3, "y", "p_a"), "rmse", "mae", "r2")


@query(
    "region_summary",
    with_views("v_sensor_day", f", m AS (SELECT CAST(CAST(sensor_id AS BIGINT) % 9 AS BIGINT) AS region, avg(pm25) / 3 AS m, count(*) AS n FROM v_sensor_day GROUP BY 1) SELECT region, {R('m')} AS mean_pm25, n, CASE WHEN m <= 9 THEN 'Good' WHEN m <= 13 THEN 'Moderate' WHEN m <= 17 THEN 'Elevated' ELSE 'High' END AS category FROM m"),
)
def region_summary(spark, sf_dir):
    d = v_sensor_day(spark, sf_dir).withColumn("region", F.col("sensor_id").cast("long") % 9).withColumn("pm25", F.col("pm25") / 3)
    return rounded(agg.region_summary(d, "region").drop("aqi"), "mean_pm25")


@query("mad_by", with_views("v_sensor_day", f", m AS (SELECT sensor_id, median(pm25) AS med FROM v_sensor_day GROUP BY 1) SELECT sensor_id, {R('any_value(med)')} AS med, {R('median(abs(pm25 - med))')} AS mad FROM v_sensor_day JOIN m USING (sensor_id) GROUP BY 1"))
def mad_by(spark, sf_dir):
    return rounded(agg.mad_by(v_sensor_day(spark, sf_dir), "sensor_id", "pm25"), "med", "mad")


@query("profile", with_views("v_sensor_day", "SELECT count(*) AS rows, count(DISTINCT sensor_id) AS keys, min(date) AS first, max(date) AS last, CAST(date_diff('day', min(date), max(date)) + 1 AS INT) AS days FROM v_sensor_day"), dates=("first", "last"))
def profile(spark, sf_dir):
    return agg.profile(v_sensor_day(spark, sf_dir))


@query("pull_cost", "SELECT event_type AS kind, count(*) AS calls, sum(event_id % 90) AS rows, sum(2 + 2 * (1 + user_id % 4) * (event_id % 90)) AS points FROM events GROUP BY 1")
def pull_cost(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (1 + F.col("user_id") % 4).alias("fields"), (F.col("event_id") % 90).alias("rows"))
    return agg.pull_cost(log)


@query("gram_by_fold", with_views("v_sensor_day", f", {_OOF} SELECT CAST(sensor_id AS BIGINT) % 5 AS fold, count(*) AS n, {R('sum(p_a)')} AS s_p_a, {R('sum(p_a * p_c) / 1000')} AS s_p_a_p_c, {R('sum(p_c * y) / 1000')} AS s_p_c_y FROM oof GROUP BY 1"))
def gram_by_fold(spark, sf_dir):
    g = agg.gram(_oof(spark, sf_dir).withColumn("fold", F.col("sensor_id").cast("long") % 5), ["p_a", "p_c"], "y", "fold")
    return g.select("fold", "n", r6("s_p_a").alias("s_p_a"), r6(F.col("s_p_a_p_c") / 1000).alias("s_p_a_p_c"), r6(F.col("s_p_c_y") / 1000).alias("s_p_c_y"))


# Windows, ordering and top-k


@query(
    "robust_z",
    with_views("v_sensor_day", ", m AS (SELECT sensor_id, median(pm25) AS med FROM v_sensor_day GROUP BY 1), a AS (SELECT d.*, med FROM v_sensor_day d JOIN m USING (sensor_id)), b AS (SELECT *, median(abs(pm25 - med)) OVER (PARTITION BY sensor_id) AS mad FROM a) SELECT sensor_id, date FROM b WHERE abs(pm25 - med) / (1.4826::DOUBLE * CASE WHEN mad > 0 THEN mad ELSE coalesce((SELECT median(mad) FROM b WHERE mad > 0), 1) END) < 1.5"),
    dates=("date",),
)
def robust_z(spark, sf_dir):
    return win.robust_z(v_sensor_day(spark, sf_dir), "sensor_id", "pm25", 1.5).select("sensor_id", "date")


@query("min_rows", with_views("v_sensor_day", "SELECT sensor_id, date FROM v_sensor_day WHERE sensor_id IN (SELECT sensor_id FROM v_sensor_day GROUP BY 1 HAVING count(*) >= 27)"), dates=("date",))
def min_rows(spark, sf_dir):
    return win.min_rows(v_sensor_day(spark, sf_dir), "sensor_id", 27).select("sensor_id", "date")


@query("loo_day_mean", with_views("v_sensor_day", f", dy AS (SELECT date, sum(pm25) AS s, count(*) AS c FROM v_sensor_day GROUP BY 1) SELECT sensor_id, date, {R('(s - pm25) / greatest(c - 1, 1)')} AS loo_mean FROM v_sensor_day JOIN dy USING (date)"), dates=("date",))
def loo_day_mean(spark, sf_dir):
    d = v_sensor_day(spark, sf_dir)
    return rounded(joins.loo_day_mean(d, d).select("sensor_id", "date", "loo_mean"), "loo_mean")


@query(
    "top_per_cell",
    with_views("v_tract", ", b AS (SELECT min(lat) s, max(lat) n, min(lon) w, max(lon) e FROM v_tract), c AS (SELECT GEOID AS id, ejf, least(greatest(CAST(trunc((lat - s) / greatest(n - s, 0.01) * 20) AS INT), 0), 19) * 20 + least(greatest(CAST(trunc((lon - w) / greatest(e - w, 0.01) * 20) AS INT), 0), 19) AS cell FROM v_tract, b) SELECT cell, id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ejf DESC, id) AS r FROM c) WHERE r = 1"),
)
def top_per_cell(spark, sf_dir):
    t = v_tract(spark, sf_dir).withColumnRenamed("GEOID", "id")
    return win.top_per_cell(t, "ejf").select("cell", "id")


@query("keep_first_ranked", with_views("ev", ", f AS (SELECT sensor_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS r FROM ev) WHERE r = 1) SELECT sensor_id, event_id, CAST(row_number() OVER (ORDER BY event_id) AS INT) AS rank FROM f"))
def keep_first_ranked(spark, sf_dir):
    from ..operators.clean import one_per

    return win.add_rank(one_per(events(spark, sf_dir), "sensor_id", ["ts", "event_id"]).select("sensor_id", "event_id"), ["event_id"])


@query(
    "date_chunks",
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 200 AS b FROM orders), k AS (SELECT *, unnest(range(0, 3)) AS i FROM o) SELECT o_orderkey, a + CAST(i * 90 AS INT) AS chunk_start, least(a + CAST(i * 90 + 90 AS INT), b) AS chunk_end FROM k WHERE a + CAST(i * 90 AS INT) < b",
    dates=("chunk_start", "chunk_end"),
)
def date_chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a")).withColumn("b", F.date_add("a", 200))
    return win.date_chunks(o, "a", "b", 90).select("o_orderkey", "chunk_start", "chunk_end")


@query("within_budget", "SELECT c_custkey, running FROM (SELECT c_custkey, sum(100 + c_custkey % 50) OVER (ORDER BY c_mktsegment, c_custkey ROWS UNBOUNDED PRECEDING) AS running FROM customer) WHERE running + 5000 <= 60000")
def within_budget(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("cost", 100 + F.col("c_custkey") % 50)
    return win.within_budget(c, ["c_mktsegment", "c_custkey"], "cost", 60000).select("c_custkey", "running")


@query("tail_holdout", "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER () AS n FROM events) SELECT event_id, r <= least(floor(n * 0.1), 50000) AS holdout FROM k")
def tail_holdout(spark, sf_dir):
    return win.tail_holdout(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "holdout")


_FOLDS = (
    ", g AS (SELECT sensor_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sensor_id) AS r FROM v_sensor_day GROUP BY 1), "
    "rec AS (SELECT CAST(0 AS BIGINT) AS r, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS held, CAST(-1 AS BIGINT) AS fold UNION ALL "
    "SELECT g.r, list_transform(held, lambda x, i: x + CASE WHEN i = list_position(held, list_min(held)) THEN g.n ELSE 0 END), CAST(list_position(held, list_min(held)) - 1 AS BIGINT) FROM rec JOIN g ON g.r = rec.r + 1) "
    "SELECT CAST(fold AS INT) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS sensors FROM rec JOIN g USING (r) GROUP BY 1"
)


@query("group_folds", with_views("v_sensor_day", _FOLDS).replace("WITH", "WITH RECURSIVE", 1))
def group_folds(spark, sf_dir):
    """Whole sensors in five folds, with the rows of each."""
    d = v_sensor_day(spark, sf_dir)
    return d.join(win.group_folds(d, "sensor_id"), "sensor_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sensor_id").alias("sensors"))


_SCEN = (("base", 0.0, 1.0), ("hot", 5.0, 1.0), ("cold", -5.0, 1.0), ("humid", 0.0, 1.2), ("dry", 0.0, 0.8), ("windy", 2.0, 0.9), ("calm", -2.0, 1.1))


@query("scenario_spread", with_views("v_sensor_day", f", s(name, d, f) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in _SCEN)}) SELECT sensor_id AS id, {R('stddev_pop(greatest(0, pm25 * f + d))')} AS spread FROM (SELECT sensor_id, avg(pm25) AS pm25 FROM v_sensor_day GROUP BY 1) q, s GROUP BY 1"))
def scenario_spread(spark, sf_dir):
    m = v_sensor_day(spark, sf_dir).groupBy(F.col("sensor_id").alias("id")).agg(F.avg("pm25").alias("pm25"))
    scen = spark.createDataFrame(list(_SCEN), "name string, d double, f double")
    return rounded(ml.sensitivity(m, scen, F.greatest(F.lit(0.0), F.col("pm25") * F.col("f") + F.col("d"))), "spread")


@query("pull_order", with_views("v_sensor", "SELECT sensor_id, CAST(sensor_id AS BIGINT) % 3 = 0 AS is_known FROM v_sensor"))
def pull_order(spark, sf_dir):
    s = v_sensor(spark, sf_dir).withColumn("date_created", F.col("lat"))
    return win.pull_order(s, s.where(F.col("sensor_id").cast("long") % 3 == 0)).select("sensor_id", "is_known")


@query("sample_outside", with_views("v_sensor", "SELECT sensor_id FROM v_sensor WHERE CAST(sensor_id AS BIGINT) % 2 = 0 ORDER BY sensor_id LIMIT 30"))
def sample_outside(spark, sf_dir):
    return win.sample_outside(v_sensor(spark, sf_dir).withColumn("in_tx", F.col("sensor_id").cast("long") % 2 != 0)).select("sensor_id")


@query("choose_best", with_views("v_sensor_day", f", {_OOF}, c AS (SELECT GEOID AS name, 1 - avg(abs(y - p_a)) / 100 AS r2 FROM oof GROUP BY 1) SELECT name, {R('r2')} AS r2 FROM c ORDER BY (name = '48000000003' AND (SELECT max(r2) FROM c) - r2 < 0.001) DESC, r2 DESC, name LIMIT 1"))
def choose_best(spark, sf_dir):
    c = _oof(spark, sf_dir).groupBy(F.col("GEOID").alias("name")).agg((1 - F.avg(F.abs(F.col("y") - F.col("p_a"))) / 100).alias("r2"))
    return rounded(win.choose_best(c, "48000000003"), "r2")


_CLOSE = sql_km("pts.lat", "pts.lon", "x.lat", "x.lon", "3959.0::DOUBLE")
_GREEDY = (
    "rec AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(id VARCHAR, lat DOUBLE, lon DOUBLE, s DOUBLE)[]) AS p UNION ALL "
    f"SELECT pts.r, CASE WHEN len(p) < 25 AND len(list_filter(p, lambda x: {_CLOSE} < 8)) = 0 THEN list_append(p, {{'id': pts.id, 'lat': pts.lat, 'lon': pts.lon, 's': pts.s}}) ELSE p END "
    "FROM rec JOIN pts ON pts.r = rec.r + 1 WHERE len(p) < 25), "
    "top AS (SELECT arg_max(p, r) AS p FROM rec), picks AS (SELECT unnest(p) AS x, CAST(generate_subscripts(p, 1) AS INT) AS pick FROM top)"
)


@query("spaced_top_k", with_views("v_tract", f", pts AS (SELECT GEOID AS id, lat, lon, ejf AS s, row_number() OVER (ORDER BY ejf DESC, GEOID) AS r FROM v_tract), {_GREEDY} SELECT x.id AS id, x.lat AS lat, x.lon AS lon, {R('x.s')} AS ejf, pick FROM picks").replace("WITH", "WITH RECURSIVE", 1))
def spaced_top_k(spark, sf_dir):
    t = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon", "ejf")
    return rounded(win.spaced_top_k(t, "ejf", 25, 8.0), "ejf")


# Interpolation


def _residuals(spark, sf_dir):
    r = agg.residual_by_sensor(_oof(spark, sf_dir).withColumn("p", F.col("p_a")))
    return r.select(F.col("sensor_id").alias("id"), "lat", "lon", "resid")


_RES = f"{_OOF}, rs AS (SELECT sensor_id AS id, any_value(lat) AS lat, any_value(lon) AS lon, avg(y - p_a) AS resid FROM oof GROUP BY 1)"


def _sql_idw(targets: str, own: str, k: int, power: float, km: float) -> str:
    return (
        f"kd AS (SELECT t.id, s.resid, {sql_km('t.lat', 't.lon', 's.lat', 's.lon')} AS km, s.id AS sid FROM {targets} t JOIN rs s ON {own}), "
        f"kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, sid) AS r FROM kd) WHERE r <= {k} AND km < {km}), "
        f"iw AS (SELECT id, coalesce(avg(CASE WHEN km < 1e-6 THEN resid END), sum(resid / pow(km, {power})) FILTER (WHERE km >= 1e-6) / sum(1 / pow(km, {power})) FILTER (WHERE km >= 1e-6)) AS c FROM kn GROUP BY 1)"
    )


@query("idw_tracts", with_views("v_sensor_day v_tract", f", {_RES}, tt AS (SELECT GEOID AS id, lat, lon FROM v_tract), {_sql_idw('tt', 'true', 8, 2.0, 150)} SELECT tt.id, {R('coalesce(c, 0)')} AS corr FROM tt LEFT JOIN iw USING (id)"))
def idw_tracts(spark, sf_dir):
    t = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon")
    return rounded(itp.idw(t, _residuals(spark, sf_dir)), "corr")


@query("kriging_sensors")
def kriging_sensors(spark, sf_dir):
    r = _residuals(spark, sf_dir)
    return rounded(itp.kriging(r, r, exclude_self=True), "corr")


_TWO = (
    f", {_RES}, kd AS (SELECT t.id, s.id AS sid, s.lat, s.lon, s.resid, {sql_km('t.lat', 't.lon', 's.lat', 's.lon')} AS km FROM rs t JOIN rs s ON s.id <> t.id), "
    "kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, sid) AS r FROM kd), "
    f"kp AS (SELECT a.id, a.km AS h1, b.km AS h2, a.resid AS x1, b.resid AS x2, {sql_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS h FROM kn a JOIN kn b ON a.id = b.id AND a.r = 1 AND b.r = 2), "
    "kc AS (SELECT *, pow((x1 - x2) / 2, 2) AS v FROM kp), "
    "ke AS (SELECT *, v + 1e-6 AS a, v * exp(-3 * h / 60) AS b, v * exp(-3 * h1 / 60) AS r1, v * exp(-3 * h2 / 60) AS r2 FROM kc), "
    "kw AS (SELECT *, (r1 - r2) / (a - b) AS d, (r1 + r2 - 2 / 1e-6) / (a + b - 2 / 1e-6) AS t FROM ke) "
)


@query("kriging_two", with_views("v_sensor_day", _TWO + "SELECT id, round(CASE WHEN h1 > 180 AND h2 > 180 THEN 0 ELSE (t + d) / 2 * x1 + (t - d) / 2 * x2 END + 1.37e-5, 3) AS corr FROM kw"))
def kriging_two(spark, sf_dir):
    """Kriging with two neighbours, whose system has a closed form."""
    r = _residuals(spark, sf_dir)
    return itp.kriging(r, r, k=2, exclude_self=True).withColumn("corr", F.round(F.col("corr") + 1.37e-5, 3))


_RIDGE = (
    f", {_RES}, t AS (SELECT count(*) AS n, sum(lat) AS sx, sum(lon) AS sy, sum(resid) AS sv, sum(lat * lat) AS xx, sum(lat * lon) AS xy, sum(lon * lon) AS yy, sum(lat * resid) AS xv, sum(lon * resid) AS yv FROM rs), "
    "m AS (SELECT rs.*, t.*, n - 1 AS k, (sx - lat) / (n - 1) AS mx, (sy - lon) / (n - 1) AS my, (sv - resid) / (n - 1) AS mv FROM rs, t), "
    "e AS (SELECT *, xx - lat * lat - k * mx * mx + 2 AS a, xy - lat * lon - k * mx * my AS b, yy - lon * lon - k * my * my + 2 AS c, xv - lat * resid - k * mx * mv AS p, yv - lon * resid - k * my * mv AS q FROM m) "
)


@query("ridge_loo", with_views("v_sensor_day", _RIDGE + f"SELECT id, {R('mv + (lat - mx) * (c * p - b * q) / (a * c - b * b) + (lon - my) * (a * q - b * p) / (a * c - b * b)')} AS corr FROM e"))
def ridge_loo(spark, sf_dir):
    return rounded(itp.ridge_loo(_residuals(spark, sf_dir), ["lat", "lon"]), "corr")


@query("forest_loo")
def forest_loo(spark, sf_dir):
    return itp.forest_loo(_residuals(spark, sf_dir), ["lat", "lon"], trees=10, folds=3)


_EVAL = f"SELECT {R('1 - sum((h - y) * (h - y)) / (sum(y * y) - sum(y) * sum(y) / count(*))')} AS r2, {R('sqrt(avg((h - y) * (h - y)))')} AS rmse, {R('avg(abs(h - y))')} AS mae, {R('stddev_pop(c)')} AS corr_std, {R('corr(p_a, c)')} AS rho FROM hh"


@query(
    "evaluate_correction",
    with_views("v_sensor_day", f", {_RES}, {_sql_idw('rs', 's.id <> t.id', 8, 2.0, 150)}, cc AS (SELECT y, p_a, least(greatest(coalesce(iw.c, 0) * 0.5, -2), 2) AS c FROM oof LEFT JOIN iw ON iw.id = oof.sensor_id), hh AS (SELECT *, greatest(0, p_a + c) AS h FROM cc) {_EVAL}"),
)
def evaluate_correction(spark, sf_dir):
    r = _residuals(spark, sf_dir)
    rows = _oof(spark, sf_dir).select(F.col("sensor_id").alias("id"), "y", F.col("p_a").alias("p"))
    out = itp.evaluate_correction(rows, itp.idw(r, r, exclude_self=True), 0.5, 2.0)
    return rounded(out.select("r2", "rmse", "mae", "corr_std", "rho"), "r2", "rmse", "mae", "corr_std", "rho")


@query("deploy_gate")
def deploy_gate(spark, sf_dir):
    """The best of all STRATEGIES against the uncorrected predictions."""
    r = _residuals(spark, sf_dir)
    rows = _oof(spark, sf_dir).select(F.col("sensor_id").alias("id"), "y", F.col("p_a").alias("p"))
    base = agg.regression_metrics(rows).first()["r2"]
    return itp.deploy_gate(itp.search_corrections(rows, r), base).select("name", r6("gain").alias("gain"), "reason", "deploy")


@query(
    "apply_correction",
    with_views("v_sensor_day v_tract", f", {_RES}, tt AS (SELECT GEOID AS id, lat, lon FROM v_tract), {_sql_idw('tt', 'true', 8, 2.0, 150)} SELECT tt.id, round(coalesce(c, 0) * 0.5, 4) AS corr FROM tt LEFT JOIN iw USING (id)"),
)
def apply_correction(spark, sf_dir):
    t = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon")
    return itp.apply_correction(t, _residuals(spark, sf_dir), itp.STRATEGIES[2])


# Models


def _training(spark, sf_dir):
    d = v_sensor_day(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    return joins.loo_day_mean(d, d).select(F.concat_ws("/", "sensor_id", "date").alias("id"), "sensor_id", "lat", "lon", "loo_mean", sc.min_dist(lat, lon, sc.COAST).alias("coast"), F.dayofmonth("date").cast("double").alias("day"), F.col("pm25").alias("y"))


FEATURES = ["lat", "lon", "loo_mean", "coast", "day"]


@query("fit_and_score")
def fit_and_score(spark, sf_dir):
    """Test metrics of models fitted on a hashed split, and of their blend."""
    train, test = ml.hash_split(_training(spark, sf_dir), "id")
    models = ml.fit_models(train, FEATURES, "y", trees=8, depth=4, log=True)
    scored = ml.score(test, FEATURES, models, {"forest": 0.7, "boosted": 0.3}, log=True)
    return agg.regression_metrics(scored, "y", "pm25_pred")


@query("hash_split", with_views("v_sensor_day", "SELECT CASE WHEN CAST('0x' || substr(md5(sensor_id || '/' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 200 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM v_sensor_day GROUP BY 1"))
def hash_split(spark, sf_dir):
    train, test = ml.hash_split(_training(spark, sf_dir), "id")
    return train.agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n")).union(test.agg(F.lit("test"), F.count(F.lit(1))))


@query("spatial_holdout")
def spatial_holdout(spark, sf_dir):
    t = _training(spark, sf_dir).withColumn("city", F.concat(F.lit("city"), F.col("sensor_id").cast("long") % 9))
    return ml.spatial_holdout(t, "city", ["city1"], "city[23]", FEATURES, "y")


@query("inverse_mse_weights", with_views("v_sensor_day", f", {_OOF}, m AS (SELECT 'a' AS model, avg((p_a - y) * (p_a - y)) AS mse FROM oof UNION ALL SELECT 'b', avg((p_b - y) * (p_b - y)) FROM oof UNION ALL SELECT 'c', avg((p_c - y) * (p_c - y)) FROM oof) SELECT model, {R('mse')} AS mse, {R('1 / (mse + 1e-10) / (SELECT sum(1 / (mse + 1e-10)) FROM m)')} AS weight FROM m"))
def inverse_mse_weights(spark, sf_dir):
    return rounded(ml.inverse_mse_weights(_oof(spark, sf_dir), ["a", "b", "c"]), "mse", "weight")


@query("site_out_cv")
def site_out_cv(spark, sf_dir):
    """Metrics of models on sites that they never saw."""
    oof = ml.site_out_cv(_training(spark, sf_dir), FEATURES, "y", "sensor_id", shared_folder(spark, "folds"), 3)
    return agg.regression_metrics(oof, "y", "p_forest")


_FOLD_PM = {r: f"avg(CASE WHEN km <= {r} THEN b.pm25 END)" for r in (25, 50, 100)}
_FOLD_N = {r: f"count(CASE WHEN km <= {r} THEN b.pm25 END)" for r in (25, 50, 100)}
_FOLD_SQL = (
    ", d AS (SELECT *, CAST(sensor_id AS BIGINT) % 3 AS own FROM v_sensor_day), f AS (SELECT unnest([0, 1, 2]) AS fold), "
    "days AS (SELECT fold, date, sum(CASE WHEN own <> fold THEN pm25 ELSE 0 END) AS s, count(CASE WHEN own <> fold THEN pm25 END) AS c FROM d, f GROUP BY 1, 2), "
    f"p AS (SELECT a.sensor_id, a.date, b.own, b.pm25, {sql_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM d a JOIN d b ON a.date = b.date AND a.sensor_id <> b.sensor_id), "
    f"st AS (SELECT fold, b.sensor_id, b.date, {', '.join(f'{_FOLD_PM[r]} AS m{r}, {_FOLD_N[r]} AS n{r}' for r in (25, 50, 100))}, stddev_pop(CASE WHEN km <= 50 THEN b.pm25 END) AS dev FROM p b JOIN f ON b.own <> f.fold WHERE km <= 100 GROUP BY ALL), "
    "j AS (SELECT f.fold, d.sensor_id, d.date, d.own, (s - CASE WHEN d.own <> f.fold THEN d.pm25 ELSE 0 END) / greatest(c - CASE WHEN d.own <> f.fold THEN 1 ELSE 0 END, 1) AS loo, st.* EXCLUDE (fold, sensor_id, date) "
    "FROM d CROSS JOIN f JOIN days ON days.fold = f.fold AND days.date = d.date LEFT JOIN st ON st.fold = f.fold AND st.sensor_id = d.sensor_id AND st.date = d.date) "
)


@query(
    "fold_features",
    with_views("v_sensor_day", _FOLD_SQL + f"SELECT CAST(fold AS INT) AS held_out, own AS fold, sensor_id, date, {R('loo')} AS loo_mean, {R('coalesce(m25, m50, loo)')} AS nbr_pm25_25km, {R('coalesce(m50, loo)')} AS nbr_pm25_50km, {R('coalesce(m100, m50, loo)')} AS nbr_pm25_100km, CAST(coalesce(n25, 0) AS INT) AS nbr_count_25km, CAST(coalesce(n50, 0) AS INT) AS nbr_count_50km, CAST(coalesce(n100, 0) AS INT) AS nbr_count_100km, round(coalesce(dev, 0) + 1.37e-5, 3) AS nbr_std_50km FROM j"),
    dates=("date",),
)
def fold_features(spark, sf_dir):
    """All rows as each of three folds of sensors sees them, with that fold's readings taken out."""
    d = v_sensor_day(spark, sf_dir)
    folds = v_sensor(spark, sf_dir).select("sensor_id", (F.col("sensor_id").cast("long") % 3).alias("fold"))
    parts = joins.fold_sums(d, folds)
    out = [joins.fold_features(parts, f).withColumn("held_out", F.lit(f)) for f in range(3)]
    rows = out[0].unionByName(out[1]).unionByName(out[2]).drop("lat", "lon", "pm25")
    return rounded(rows, "loo_mean", *[f"nbr_pm25_{r}km" for r in (25, 50, 100)]).withColumn("nbr_std_50km", F.round(F.col("nbr_std_50km") + 1.37e-5, 3))


NEIGHBOR_FEATURES = ["lat", "lon", "loo_mean", "coast", "doy", *[f"nbr_pm25_{r}km" for r in (25, 50, 100)], *[f"nbr_count_{r}km" for r in (25, 50, 100)], "nbr_std_50km"]


@query("site_out_cv_rebuilt")
def site_out_cv_rebuilt(spark, sf_dir):
    """The same with neighbour features and day means rebuilt for each fold without its sensors."""
    d = v_sensor_day(spark, sf_dir).withColumn("coast", sc.min_dist(F.col("lat"), F.col("lon"), sc.COAST)).withColumn("doy", F.dayofyear("date").cast("double"))
    oof = ml.site_out_neighbors_cv(d, NEIGHBOR_FEATURES, shared_folder(spark, "folds"), 3)
    return agg.regression_metrics(oof, "pm25", "p_forest")


@query("blend_weights")
def blend_weights(spark, sf_dir):
    return ml.blend_weights(_oof(spark, sf_dir), ["a", "b", "c"])[0]


@query("blend_report")
def blend_report(spark, sf_dir):
    return ml.blend_weights(_oof(spark, sf_dir), ["a", "b", "c"])[1]


_MANY = [f"m{i}" for i in range(20)]


@query("blend_optimality", "SELECT 'm' || CAST(range AS VARCHAR) AS model, TRUE AS optimal FROM range(20)")
def blend_optimality(spark, sf_dir):
    """Whether the weights of a convex blend of twenty models meet the conditions of the optimum."""
    made = {f"p_m{i}": F.col(f"p_{'abc'[i % 3]}") * (0.6 + i / 20) + F.pmod(F.xxhash64("sensor_id", "date", F.lit(i)), F.lit(100)) / 10 for i in range(20)}
    oof = written(_oof(spark, sf_dir).withColumns(made))
    weights = ml.blend_weights(oof, _MANY)[0].where("blend = 'convex'")
    slack = ml.optimality(oof, weights, _MANY)
    return slack.select("model", (F.when(F.col("weight") > 1e-9, F.abs("slack") < 1e-6).otherwise(F.col("slack") > -1e-6) & (F.col("weight") >= 0)).alias("optimal"))


_CAL = (
    f", {_OOF}, b AS (SELECT CAST(sensor_id AS BIGINT) % 3 AS fold, CAST(floor(p_a / 0.5::DOUBLE) AS BIGINT) AS bin, y, p_a AS p FROM oof), "
    "g AS (SELECT f.fold, b.bin, sum(CASE WHEN b.fold <> f.fold THEN y ELSE 0 END) AS s, count(CASE WHEN b.fold <> f.fold THEN 1 END) AS n FROM b, (SELECT DISTINCT fold FROM b) f GROUP BY 1, 2), "
    "c AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM g WHERE n > 0 WINDOW w AS (PARTITION BY fold ORDER BY bin)), "
    "sp AS (SELECT i.fold, j.bin AS first, i.bin AS last, (i.cs - j.cs + j.s) / (i.cn - j.cn + j.n) AS mean FROM c i JOIN c j ON i.fold = j.fold AND j.bin <= i.bin), "
    "le AS (SELECT fold, last AS bin, min(mean) OVER (PARTITION BY fold, first ORDER BY last ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM sp), "
    "ft AS (SELECT fold, bin, max(least) AS cal FROM le GROUP BY 1, 2), "
    "fl AS (SELECT g.fold, g.bin, coalesce(last_value(cal IGNORE NULLS) OVER (PARTITION BY g.fold ORDER BY g.bin ROWS UNBOUNDED PRECEDING), first_value(cal IGNORE NULLS) OVER (PARTITION BY g.fold ORDER BY g.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cal FROM g LEFT JOIN ft ON ft.fold = g.fold AND ft.bin = g.bin) "
)


@query("calibrate_binned", with_views("v_sensor_day", _CAL + f"SELECT b.fold, b.bin, count(*) AS n, {R('any_value(cal)')} AS cal, {R('avg(y)')} AS y FROM b JOIN fl ON fl.fold = b.fold AND fl.bin = b.bin GROUP BY 1, 2"))
def calibrate_binned(spark, sf_dir):
    """Calibrated value of each bin of predictions in each fold, fitted on the other folds, with what was read there."""
    rows = _oof(spark, sf_dir).select((F.col("sensor_id").cast("long") % 3).alias("fold"), "y", F.col("p_a").alias("p"))
    out = ml.calibrate_binned_cv(rows).withColumn("bin", F.floor(F.col("p") / 0.5).cast("long"))
    return rounded(out.groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("cal").alias("cal"), F.avg("y").alias("y")), "cal", "y")


@query("calibrate_cv")
def calibrate_cv(spark, sf_dir):
    """Metrics before and after calibration on sites that it has not seen."""
    out = written(ml.calibrate_cv(_oof(spark, sf_dir).withColumn("p", F.col("p_a")), folds=3))
    parts = [agg.regression_metrics(out, "y", c).withColumn("stage", F.lit(stage)) for stage, c in (("before", "p"), ("after", "cal"))]
    return parts[0].unionByName(parts[1])


@query("cluster_distance")
def cluster_distance(spark, sf_dir):
    t = v_tract(spark, sf_dir).select("GEOID", "lat", "lon")
    return ml.cluster_distance(t, ml.fit_clusters(v_sensor(spark, sf_dir), 8)).select("GEOID", "cluster", r6("cluster_dist").alias("cluster_dist"))


@query("metrics_report")
def metrics_report(spark, sf_dir):
    o = _oof(spark, sf_dir)
    return ml.metrics_report({m: agg.regression_metrics(o, "y", f"p_{m}") for m in ("a", "b")})


@query(
    "metrics_report_read",
    with_views(
        "v_sensor_day",
        f", {_OOF}, a AS (SELECT {_METRIC} FROM oof), b AS (SELECT {_METRIC.replace('p_a', 'p_b')} FROM oof), "
        "r AS (SELECT 'a' AS section, * FROM a UNION ALL SELECT 'b', * FROM b) "
        "SELECT section, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM r UNION ALL SELECT section, 'rmse', rmse FROM r UNION ALL SELECT section, 'mae', mae FROM r UNION ALL SELECT section, 'r2', r2 FROM r",
    ),
)
def metrics_report_read(spark, sf_dir):
    """The report's JSON read back as rows."""
    sections = metrics_report(spark, sf_dir).select(F.explode(F.from_json("json", "map<string,string>")).alias("section", "text"))
    rows = sections.select("section", F.explode(F.from_json("text", "map<string,double>")).alias("metric", "value"))
    return rows.withColumn("value", r6("value"))


# Placement


def _sites(spark, sf_dir):
    """Tracts with a reading each, and the sensors that exist."""
    t = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon", "ejf", (8 + F.substring("GEOID", 3, 9).cast("long") % 13).cast("double").alias("pm25"))
    return t, v_sensor(spark, sf_dir).where(F.col("sensor_id").cast("long") % 5 == 0).select("lat", "lon")


_SITES = "t AS (SELECT GEOID AS id, lat, lon, ejf, CAST(8 + CAST(substr(GEOID, 3, 9) AS BIGINT) % 13 AS DOUBLE) AS pm25 FROM v_tract), e AS (SELECT lat, lon FROM v_sensor WHERE CAST(sensor_id AS BIGINT) % 5 = 0)"
_MI = sql_km("t.lat", "t.lon", "e.lat", "e.lon", "3959.0::DOUBLE")
_SCORES = (
    f"{_SITES}, d AS (SELECT t.id, any_value(t.ejf) AS ejf, any_value(t.pm25) AS pm25, min({_MI}) AS dist FROM t, e GROUP BY 1), "
    "q AS (SELECT quantile_cont(dist, 0.95) AS qd, quantile_cont(ejf, 0.99) AS qe, quantile_cont(pm25, 0.95) AS qp, avg(pm25) AS mu, stddev_pop(pm25) AS sd FROM d), "
    "sc AS (SELECT id, least(greatest(dist / greatest(qd, 1), 0), 1.5) / 1.5 AS cov, least(abs(pm25 - mu) / (3 * sd), 1) AS err, least(greatest(ejf / greatest(qe, 1), 0), 1) AS ej, least(greatest(pm25 / greatest(qp, 1), 0), 1.2) / 1.2 AS sev FROM d, q), "
    "cs AS (SELECT *, 0.3::DOUBLE * cov + 0.2::DOUBLE * err + 0.3::DOUBLE * ej + 0.2::DOUBLE * sev AS comp FROM sc)"
)


@query("placement_scores", with_views("v_tract v_sensor", f", {_SCORES} SELECT id, {R('cov')} AS coverage_need, {R('err')} AS prediction_error, {R('ej')} AS ej_priority, {R('sev')} AS pm25_severity, {R('comp')} AS composite FROM cs"))
def placement_scores(spark, sf_dir):
    cols = ("coverage_need", "prediction_error", "ej_priority", "pm25_severity", "composite")
    return rounded(pl.placement_scores(*_sites(spark, sf_dir)).select("id", *cols), *cols)


@query("spread_need", with_views("v_tract v_sensor", f", {_SITES} SELECT id, {R('least(abs(pm25 - (SELECT avg(pm25) FROM t)) / (3 * (SELECT stddev_pop(pm25) FROM t)), 1)')} AS need FROM t"))
def spread_need(spark, sf_dir):
    return rounded(pl.spread_need(_sites(spark, sf_dir)[0], "pm25").select("id", "need"), "need")


def _pool(spark, sf_dir, n=120):
    return pl.diverse_candidates(written(pl.placement_scores(*_sites(spark, sf_dir))), n)


_CELLS = (
    ", g AS (SELECT cs.id, comp, cov, comp + 0.3::DOUBLE * cov AS s, lat, lon FROM cs JOIN t USING (id)), b AS (SELECT min(lat) s0, max(lat) n0, min(lon) w0, max(lon) e0 FROM g), "
    "k AS (SELECT g.*, least(greatest(CAST(trunc((lat - s0) / greatest(n0 - s0, 0.01) * 20) AS INT), 0), 19) * 20 + least(greatest(CAST(trunc((lon - w0) / greatest(e0 - w0, 0.01) * 20) AS INT), 0), 19) AS cell FROM g, b), "
    "c0 AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cell ORDER BY s DESC, id) AS r FROM k) WHERE r = 1), "
    "c1 AS (SELECT id FROM c0 UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY s DESC, id DESC) AS r FROM k WHERE id NOT IN (SELECT id FROM c0)) WHERE r <= greatest(0, 120 - (SELECT count(*) FROM c0))), "
    "c2 AS (SELECT id FROM c1 UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY cov DESC, id DESC) AS r FROM k WHERE id NOT IN (SELECT id FROM c1)) WHERE r <= greatest(0, 140 - (SELECT count(*) FROM c1)))"
)


@query("diverse_candidates", with_views("v_tract v_sensor", f", {_SCORES}{_CELLS} SELECT id, {R('comp')} AS composite FROM c2 JOIN cs USING (id)"))
def diverse_candidates(spark, sf_dir):
    return rounded(_pool(spark, sf_dir).select("id", "composite"), "composite")


@query(
    "linear_terms",
    with_views("v_tract v_sensor", f", {_SCORES} SELECT id, {R('-(comp + 0.5 * (SELECT max(comp) FROM cs) * cov)')} AS q FROM cs"),
)
def linear_terms(spark, sf_dir):
    return rounded(pl.interaction_terms(pl.placement_scores(*_sites(spark, sf_dir)))[0], "q")


_PAIR_MI = sql_km("a.lat", "a.lon", "b.lat", "b.lon", "3959.0::DOUBLE")
_TERMS = (
    f"{_SCORES}, cl AS (SELECT cs.*, t.lat, t.lon FROM cs JOIN t USING (id)), pr AS (SELECT a.id AS i, b.id AS j, (a.cov + b.cov) / 2 AS need, {_PAIR_MI} AS dist FROM cl a JOIN cl b ON a.id < b.id), "
    "qq AS (SELECT i, j, dist, (SELECT max(comp) FROM cs) * CASE WHEN dist < 8 THEN 1 - dist / 8 ELSE -0.35::DOUBLE * exp(-0.5 * pow((dist - 18) / 12, 2)) * greatest(need, 0.3) END AS q FROM pr WHERE dist < 35)"
)


@query("pair_terms", with_views("v_tract v_sensor", f", {_TERMS} SELECT i, j, {R('dist')} AS dist, {R('q')} AS q FROM qq WHERE abs(q) > 1e-10"))
def pair_terms(spark, sf_dir):
    return rounded(pl.interaction_terms(pl.placement_scores(*_sites(spark, sf_dir)))[1], "dist", "q")


@query(
    "selection_objective",
    with_views("v_tract v_sensor", f", {_TERMS}, se AS (SELECT CAST(CAST(substr(id, 3, 9) AS BIGINT) % 7 AS BIGINT) AS selection_id, id FROM t), o1 AS (SELECT selection_id, sum(-(comp + 0.5 * (SELECT max(comp) FROM cs) * cov)) AS a FROM se JOIN cs USING (id) GROUP BY 1), o2 AS (SELECT x.selection_id, sum(q) AS b FROM qq JOIN se x ON x.id = qq.i JOIN se z ON z.id = qq.j AND z.selection_id = x.selection_id GROUP BY 1) SELECT selection_id, {R('a + coalesce(b, 0)')} AS value FROM o1 LEFT JOIN o2 USING (selection_id)"),
)
def selection_objective(spark, sf_dir):
    scored = written(pl.placement_scores(*_sites(spark, sf_dir)))
    chosen = scored.select((F.substring("id", 3, 9).cast("long") % 7).alias("selection_id"), "id")
    return rounded(pl.selection_objective(chosen, scored), "value")


@query(
    "spacing_objective",
    with_views("v_tract v_sensor", f", {_TERMS}, se AS (SELECT CAST(CAST(substr(id, 3, 9) AS BIGINT) % 7 AS BIGINT) AS selection_id, id FROM t), o1 AS (SELECT selection_id, sum(comp) AS a FROM se JOIN cs USING (id) GROUP BY 1), o2 AS (SELECT x.selection_id, sum(-0.5 * (1 - dist / 8)) AS b FROM pr JOIN se x ON x.id = pr.i JOIN se z ON z.id = pr.j AND z.selection_id = x.selection_id WHERE dist < 8 GROUP BY 1) SELECT selection_id, {R('a + coalesce(b, 0)')} AS value FROM o1 LEFT JOIN o2 USING (selection_id)"),
)
def spacing_objective(spark, sf_dir):
    scored = written(pl.placement_scores(*_sites(spark, sf_dir)))
    chosen = scored.select((F.substring("id", 3, 9).cast("long") % 7).alias("selection_id"), "id")
    return rounded(pl.spacing_objective(chosen, scored), "value")


@query(
    "select_spaced",
    with_views("v_tract v_sensor", f", {_SCORES}{_CELLS}, pts AS (SELECT id, lat, lon, comp AS s, row_number() OVER (ORDER BY comp DESC, id) AS r FROM c2 JOIN cs USING (id) JOIN t USING (id)), {_GREEDY} SELECT x.id AS id, {R('x.s')} AS composite, pick FROM picks").replace("WITH", "WITH RECURSIVE", 1),
)
def select_spaced(spark, sf_dir):
    scored = written(pl.placement_scores(*_sites(spark, sf_dir)))
    return rounded(pl.select_spaced(pl.diverse_candidates(scored, 120), scored, 25).select("id", "composite", "pick"), "composite")


_COVER = (
    f"{_SITES}, ns AS (SELECT lat, lon FROM v_sensor WHERE CAST(sensor_id AS BIGINT) % 11 = 3), al AS (SELECT * FROM e UNION ALL SELECT * FROM ns), "
    f"d0 AS (SELECT t.id, min({_MI}) AS d0 FROM t, e GROUP BY 1), d1 AS (SELECT t.id, min({_MI}) AS d1 FROM t, al e GROUP BY 1), dd AS (SELECT t.id, ejf, d0, d1 FROM t JOIN d0 USING (id) JOIN d1 USING (id))"
)
_COVER_COLS = f"count(*) AS total, count(*) FILTER (WHERE d1 <= 10) AS covered, count(*) FILTER (WHERE d1 <= 10) - count(*) FILTER (WHERE d0 <= 10) AS new_covered, {R('100.0::DOUBLE * count(*) FILTER (WHERE d1 <= 10) / count(*)')} AS pct, {R('avg(d1)')} AS avg_miles"


def _picked(spark, sf_dir):
    return v_sensor(spark, sf_dir).where(F.col("sensor_id").cast("long") % 11 == 3).select("lat", "lon")


@query("coverage", with_views("v_tract v_sensor", f", {_COVER} SELECT {_COVER_COLS}, {R('max(d1)')} AS max_miles, {R('median(d1)')} AS median_miles FROM dd"))
def coverage(spark, sf_dir):
    tracts, old = _sites(spark, sf_dir)
    out = agg.coverage(tracts, _picked(spark, sf_dir), old).drop("existing_covered")
    return rounded(out, "pct", "avg_miles", "max_miles", "median_miles")


@query(
    "coverage_by_quartile",
    with_views("v_tract v_sensor", f", {_COVER}, qs AS (SELECT quantile_cont(ejf, 0.25) a, quantile_cont(ejf, 0.5) b, quantile_cont(ejf, 0.75) c FROM t WHERE ejf > 0) SELECT CASE WHEN ejf < a THEN 'Q1' WHEN ejf < b THEN 'Q2' WHEN ejf < c THEN 'Q3' ELSE 'Q4' END AS quartile, {_COVER_COLS} FROM dd, qs WHERE ejf < 101 GROUP BY 1"),
)
def coverage_by_quartile(spark, sf_dir):
    tracts, old = _sites(spark, sf_dir)
    return rounded(agg.coverage_by_quartile(tracts, _picked(spark, sf_dir), old), "pct", "avg_miles")


_COVER_TAIL = _COVER[len(_SITES) :]


@query(
    "compare_coverage",
    with_views(
        "v_tract v_sensor",
        f", {_SCORES}, pts AS (SELECT id, lat, lon, comp AS s, row_number() OVER (ORDER BY comp DESC, id) AS r FROM cs JOIN t USING (id)), {_GREEDY}{_COVER_TAIL}, "
        f"al2 AS (SELECT * FROM e UNION ALL SELECT x.lat, x.lon FROM picks), d2 AS (SELECT t.id, min({_MI}) AS d1 FROM t, al2 e GROUP BY 1), both_ AS (SELECT 'fixed' AS method, d0, d1 FROM dd UNION ALL SELECT 'spaced', d0.d0, d2.d1 FROM d0 JOIN d2 USING (id)) "
        "SELECT method, count(*) AS total, count(*) FILTER (WHERE d1 <= 10) AS covered, count(*) FILTER (WHERE d1 <= 10) - count(*) FILTER (WHERE d0 <= 10) AS new_covered FROM both_ GROUP BY 1",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def compare_coverage(spark, sf_dir):
    tracts, old = _sites(spark, sf_dir)
    best = win.spaced_top_k(written(pl.placement_scores(tracts, old)), "composite", 25)
    return pl.compare_coverage(tracts, {"fixed": _picked(spark, sf_dir), "spaced": best}, old).select("method", "total", "covered", "new_covered")


@query("tract_uncertainty", with_views("v_sensor_day v_tract", f", {_OOF}, r AS (SELECT GEOID, round(avg(abs(y - p_a)), 4) AS residual FROM oof WHERE valid GROUP BY 1) SELECT t.GEOID, coalesce(r.residual, 0) AS residual FROM v_tract t LEFT JOIN r USING (GEOID)"))
def tract_uncertainty(spark, sf_dir):
    r = agg.residual_by_tract(_oof(spark, sf_dir).withColumn("p", F.col("p_a")))
    return pl.tract_uncertainty(v_tract(spark, sf_dir).select("GEOID"), r)
