"""Queries over streams of the event table, and the user-facing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.scalars import cell_index
from ..operators import aggregates as agg, joins
from ..operators.clean import tract_by_id
from ..streaming import live
from ..sources.io import _versions as published_versions, load_or_none, shared_folder, written
from .registry import query
from .views import events, place, r6, sql_km, sql_r6, table, v_sensor_day, v_smoke, v_tract, with_views

R = sql_r6


def stream_events(spark, sf_dir) -> DataFrame:
    """The event table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    lat, lon = place(F.col("user_id"))
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
    return rows.select("event_id", F.col("user_id").cast("string").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm25"), lat.alias("lat"), lon.alias("lon"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is; append mode gives all rows, complete mode the last result, update mode all changes with the number of their batch."""
    spark = df.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(*df.columns, *["batch"] * (mode == "update"))


@query("stream_daily_mean", f"SELECT sensor_id, date, {R('mean')} AS mean FROM (SELECT CAST(user_id AS VARCHAR) AS sensor_id, CAST(ts AS DATE) AS date, avg(value) AS mean FROM events GROUP BY 1, 2) WHERE date + 1 <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)", dates=("date",))
def stream_daily_mean(spark, sf_dir):
    """Days come out once the watermark has closed them."""
    return drain(live.stream_daily_mean(stream_events(spark, sf_dir), "sensor_id"), "daily").withColumn("mean", r6("mean"))


@query("closed_days", f"SELECT sensor_id, date, {R('mean')} AS mean FROM (SELECT CAST(user_id AS VARCHAR) AS sensor_id, CAST(ts AS DATE) AS date, avg(value) AS mean FROM events GROUP BY 1, 2) WHERE date < (SELECT CAST(max(ts) - INTERVAL 6 HOURS AS DATE) FROM events)", dates=("date",))
def closed_days(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("pm25", F.col("value"))
    return live.closed_days(e, "sensor_id").withColumn("mean", r6("mean"))


@query("stream_latest", f"SELECT sensor_id, ts, {R('pm25')} AS pm25 FROM (SELECT CAST(user_id AS VARCHAR) AS sensor_id, ts, value AS pm25, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1".replace("sensor_id, ts,", "sensor_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,", 1))
def stream_latest(spark, sf_dir):
    s = stream_events(spark, sf_dir).select("sensor_id", "ts", "event_id", "pm25")
    return drain(live.latest_per_sensor(s), "latest", "complete").select("sensor_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r6("pm25").alias("pm25"))


@query(
    "stream_rolling_24h",
    f'SELECT sensor_id, w AS "end", {R("avg(value)")} AS mean, count(value) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS sensor_id, value, unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 24 HOURS, INTERVAL 6 HOURS)) AS w FROM events) GROUP BY 1, 2',
)
def stream_rolling_24h(spark, sf_dir):
    changes = drain(live.rolling_24h(stream_events(spark, sf_dir), slide="6 hours", delay="40 days"), "rolling", "update")
    out = changes.groupBy("sensor_id", "end").agg(F.max_by(F.struct("mean", "n"), "batch").alias("m")).select("sensor_id", "end", "m.mean", "m.n")
    return out.withColumn("mean", r6("mean")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id, strftime(ts, '%Y-%m-%d') AS date FROM events")
def stream_dedupe(spark, sf_dir):
    s = stream_events(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd")).select("sensor_id", "date", "ts")
    return drain(live.stream_dedupe(s, ["sensor_id", "date"], delay="2 days"), "dedupe").select("sensor_id", "date")


@query("stream_count", "SELECT CAST(time_bucket(INTERVAL 10 MINUTES, ts) + INTERVAL 10 MINUTES AS VARCHAR) AS \"end\", count(*) AS n FROM events GROUP BY 1")
def stream_count(spark, sf_dir):
    return drain(live.running_count(stream_events(spark, sf_dir)), "count", "complete").withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm:ss"))


@query("running_total", "SELECT CAST(w AS VARCHAR) AS \"end\", n, sum(n) OVER (ORDER BY w ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT time_bucket(INTERVAL 10 MINUTES, ts) + INTERVAL 10 MINUTES AS w, count(*) AS n FROM events GROUP BY 1)")
def running_total(spark, sf_dir):
    return live.running_count(events(spark, sf_dir)).withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm:ss"))


@query("fresh_readings", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def fresh_readings(spark, sf_dir):
    return live.drop_stale(events(spark, sf_dir), "24 hours").select("event_id")


@query("stream_snapshot", f"SELECT CAST(user_id AS VARCHAR) AS sensor_id, {R('value')} AS pm25 FROM events WHERE value BETWEEN 0 AND 200")
def stream_snapshot(spark, sf_dir):
    """Landed readings, quality-checked and published by a stream only if there are enough."""
    landed = shared_folder(spark, "landed")
    e = table(spark, sf_dir, "events")
    e.select(F.col("user_id").cast("string").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(30.0).alias("latitude"), F.lit(-97.0).alias("longitude"), F.lit(None).cast("double").alias("pm_24h"), F.col("value").alias("pm_now"), F.lit(100.0).alias("confidence")).write.json(landed)
    out = shared_folder(spark, "snapshot")
    q = live.stream_sensors(spark, landed).writeStream.option("checkpointLocation", shared_folder(spark, "snapshot-state")).trigger(availableNow=True).foreachBatch(live.publish_if_usable(out)).start()
    q.awaitTermination()
    return load_or_none(spark, out).select("sensor_id", r6("pm25").alias("pm25"))


@query("score_stream")
def score_stream(spark, sf_dir):
    """Tracts scored by the neighbours of each batch of live readings."""
    tracts = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon")
    s = stream_events(spark, sf_dir).where(F.col("pm25").between(0, 200)).select("sensor_id", "ts", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "pm25")
    out = shared_folder(spark, "scores")
    scorer = lambda df: df.select("id", F.col("nbr_pm25_50km").alias("pm25"), bands.epa_aqi(F.col("nbr_pm25_50km")).alias("aqi"))
    q = s.writeStream.option("checkpointLocation", shared_folder(spark, "scores-state")).trigger(availableNow=True).foreachBatch(live.score_batch(tracts, scorer, out, min_n=10)).start()
    q.awaitTermination()
    return load_or_none(spark, out).withColumn("pm25", r6("pm25"))


@query(
    "with_fallback",
    with_views("v_sensor_day", f", c AS (SELECT sensor_id, avg(pm25) AS m FROM v_sensor_day GROUP BY 1), k AS (SELECT c.sensor_id, CAST(c.sensor_id AS BIGINT) AS u, c.m, a.pm25 AS live, b.pm25 AS last FROM c LEFT JOIN v_sensor_day a ON a.sensor_id = c.sensor_id AND a.date = DATE '2024-01-12' LEFT JOIN v_sensor_day b ON b.sensor_id = c.sensor_id AND b.date = DATE '2024-01-11') SELECT sensor_id, CASE WHEN live IS NOT NULL THEN 'live' WHEN last IS NOT NULL THEN 'last' WHEN u % 2 = 0 THEN 'climatology' ELSE 'fill' END AS source, {R('coalesce(live, last, CASE WHEN u % 2 = 0 THEN m END, 8.5)')} AS pm25 FROM k"),
)
def with_fallback(spark, sf_dir):
    d = v_sensor_day(spark, sf_dir)
    clim = d.groupBy("sensor_id").agg(F.avg("pm25").alias("pm25"))
    day = lambda x: d.where(F.col("date") == F.lit(x).cast("date")).select("sensor_id", "pm25")
    out = live.with_fallback(clim.select("sensor_id"), day("2024-01-12"), day("2024-01-11"), clim.where(F.col("sensor_id").cast("long") % 2 == 0), 8.5)
    return out.withColumn("pm25", r6("pm25"))


@query(
    "rolling_24h",
    f'SELECT sensor_id, w AS "end", {R("avg(value)")} AS mean, count(value) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS sensor_id, value, unnest(generate_series(time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 24 HOURS, INTERVAL 15 MINUTES)) AS w FROM events) GROUP BY 1, 2',
)
def rolling_24h(spark, sf_dir):
    """A batch at the default slide: 96 panes a window."""
    out = live.rolling_24h(events(spark, sf_dir).withColumn("pm25", F.col("value")))
    return out.withColumn("mean", r6("mean")).withColumn("end", F.col("end").cast("timestamp_ntz"))


#: Days of January in the batches that land one after another; the last gap lets values expire.
_LANDED = ((1, 8), (9, 16), (17, 22), (28, 31))


@query(
    "stream_last_good",
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, user_id, ts, value FROM events WHERE value IS NOT NULL AND (day(ts) <= 22 OR day(ts) >= 28) AND (user_id % 3 = 0 OR user_id % 3 = 1 AND day(ts) <= 29 OR day(ts) <= 16) AND user_id % 11 <> 4), "
    "w AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM e), s AS (SELECT sensor_id, max(ts) AS t, arg_max(value, (ts, value)) AS v FROM e GROUP BY 1), "
    "c AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, user_id, avg(value) AS m FROM events GROUP BY 1, 2), "
    "j AS (SELECT c.*, v, t + INTERVAL 1 DAY >= w AS live, t + INTERVAL 5 DAYS >= w AS good FROM c LEFT JOIN s USING (sensor_id), w) "
    f"SELECT sensor_id, CASE WHEN live THEN 'live' WHEN good THEN 'last' WHEN user_id % 2 = 0 AND m IS NOT NULL THEN 'climatology' ELSE 'fill' END AS source, {R('CASE WHEN good THEN v WHEN user_id % 2 = 0 THEN coalesce(m, 8.5) ELSE 8.5 END')} AS pm25 FROM j",
)
def stream_last_good(spark, sf_dir):
    """Best value of every sensor after batches that land one after another, with a gap: live, last good, climatology or fill."""
    e = events(spark, sf_dir).withColumn("pm25", F.col("value"))
    u, day = F.col("user_id"), F.dayofmonth("ts")
    kept = e.where(((u % 3 == 0) | ((u % 3 == 1) & (day <= 29)) | (day <= 16)) & (u % 11 != 4)).select("sensor_id", F.col("ts").cast("timestamp").alias("ts"), "pm25")
    folder, state, out = (shared_folder(spark, n) for n in ("landing", "good-state", "good"))
    for i, (first, last) in enumerate(_LANDED):
        kept.where(F.dayofmonth("ts").between(first, last)).write.mode("append").parquet(folder)
        changes = live.last_good(spark.readStream.schema(kept.schema).parquet(folder), "1 day", "5 days")

        def write(batch: DataFrame, number: int, i=i) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/cycle={i}/batch={number}")

        changes.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    status = live.settled(spark.read.parquet(out).drop("cycle"), "batch")
    clim = e.groupBy("sensor_id", "user_id").agg(F.avg("pm25").alias("pm25"))
    found = live.from_status(clim.select("sensor_id"), status, clim.where(u % 2 == 0).select("sensor_id", "pm25"), 8.5)
    return found.withColumn("pm25", r6("pm25"))


@query("score_stream_models", "SELECT count(*) AS tracts, CAST(0 AS BIGINT) AS differing, CAST(1 AS BIGINT) AS versions FROM customer")
def score_stream_models(spark, sf_dir):
    """Tracts scored by saved models on the neighbours of a stream; the scores that differ from a batch run, and the versions after the batch was replayed."""
    from ..operators import modelling as ml

    d = v_sensor_day(spark, sf_dir)
    near = [*[f"nbr_pm25_{r}km" for r in (25, 50, 100)], *[f"nbr_count_{r}km" for r in (25, 50, 100)], "nbr_std_50km", "lat", "lon"]
    rows = written(joins.neighbor_features(d, d))
    models, out = shared_folder(spark, "models"), shared_folder(spark, "model-scores")
    ml.save_models(spark, models, ml.fit_models(rows, near, "pm25", trees=6, depth=4), {"forest": 0.6, "boosted": 0.4}, near)
    tracts = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon")
    s = stream_events(spark, sf_dir).where(F.col("pm25").between(0, 200)).select("sensor_id", "ts", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "pm25")
    cycle = live.score_batch(tracts, live.model_scorer(spark, models), out, min_n=10)

    def twice(batch: DataFrame, number: int) -> None:
        cycle(batch, number)
        cycle(batch, number)  # as after a failure between the write and the commit

    s.writeStream.option("checkpointLocation", shared_folder(spark, "model-state")).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    e = events(spark, sf_dir).where(F.col("value").between(0, 200)).select("sensor_id", "ts", "lat", "lon", F.col("value").alias("pm25"))
    batch = ml.score_with(joins.point_neighbors(tracts, live.latest_per_sensor(e), min_n=10), ml.load_models(spark, models))
    both = load_or_none(spark, out).select("id", F.col("pm25_pred").alias("a")).join(batch.select("id", F.col("pm25_pred").alias("b")), "id", "full_outer")
    differing = F.count_if(F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-6, F.lit(True)))
    return both.agg(F.count(F.lit(1)).alias("tracts"), differing.alias("differing"), F.lit(len(published_versions(spark, out))).cast("long").alias("versions"))


@query("batch_provenance", "SELECT count(*) AS rows, count(DISTINCT user_id) AS sensors, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT user_id) >= 20 AS usable FROM events")
def batch_provenance(spark, sf_dir):
    out = live.batch_provenance(events(spark, sf_dir))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


# Reports


def predictions(spark, sf_dir) -> DataFrame:
    """One row a tract: live neighbours' mean with its AQI, band, range, colour and message."""
    snap = v_sensor_day(spark, sf_dir).where("date = DATE '2024-01-10'").select("lat", "lon", "pm25")
    t = v_tract(spark, sf_dir).select(F.col("GEOID").alias("id"), "lat", "lon", "ejf", "county")
    near = joins.point_neighbors(t, snap, min_n=10).withColumn("pm25", r6("nbr_pm25_50km"))
    b = bands.pm_band(F.col("pm25"))
    return near.select("id", "lat", "lon", "ejf", "county", "pm25", bands.epa_aqi(F.col("pm25")).alias("aqi"), b["category"].alias("category"), b["aqi_range"].alias("aqi_range"), bands.pm_color(F.col("pm25")).alias("color"), b["health_msg"].alias("health_msg"))


_PRED = f"sn AS (SELECT lat, lon, pm25 FROM v_sensor_day WHERE date = DATE '2024-01-10'), pd AS (SELECT GEOID AS id, county, avg(CASE WHEN {sql_km('t.lat', 't.lon', 's.lat', 's.lon')} <= 50 THEN s.pm25 END) AS near, avg(s.pm25) AS every, count(*) AS n FROM v_tract t, sn s GROUP BY 1, 2 HAVING count(*) >= 10), pr AS (SELECT id, county, {R('coalesce(near, every)')} AS pm25 FROM pd)"


@query("statewide_predictions", with_views("v_sensor_day v_tract", f", {_PRED} SELECT id, pm25, CASE WHEN pm25 <= 9 THEN 'Good' WHEN pm25 <= 13 THEN 'Moderate' WHEN pm25 <= 17 THEN 'Elevated' ELSE 'High' END AS category FROM pr"))
def statewide_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", "pm25", "category")


@query("city_predictions", with_views("v_sensor_day v_tract", f", {_PRED} SELECT county AS region, {R('avg(pm25)')} AS mean_pm25, count(*) AS n FROM pr GROUP BY 1"))
def city_predictions(spark, sf_dir):
    out = agg.region_summary(predictions(spark, sf_dir).withColumnRenamed("county", "region"), "region")
    return out.select("region", r6("mean_pm25").alias("mean_pm25"), "n")


@query("county_reports")
def county_reports(spark, sf_dir):
    """One JSON text a county: its summary and its tracts, as the API returns them."""
    return agg.pack_report(predictions(spark, sf_dir), "county", ["id", "pm25", "aqi", "category", "color", "aqi_range", "health_msg"])


@query(
    "county_reports_read",
    with_views(
        "v_sensor_day v_tract",
        f", {_PRED} SELECT county, {R('avg(pm25) OVER (PARTITION BY county)')} AS mean, count(*) OVER (PARTITION BY county) AS n, id, pm25, CASE WHEN pm25 <= 9 THEN 'Good' WHEN pm25 <= 13 THEN 'Moderate' WHEN pm25 <= 17 THEN 'Elevated' ELSE 'High' END AS category FROM pr",
    ),
)
def county_reports_read(spark, sf_dir):
    """The reports' JSON read back, a row a tract."""
    shape = "summary struct<mean:double,n:long>, tracts array<struct<id:string,pm25:double,category:string>>"
    read = county_reports(spark, sf_dir).select("county", F.from_json("json", shape).alias("r"))
    rows = read.select("county", "r.summary.mean", "r.summary.n", F.explode("r.tracts").alias("t"))
    return rows.select("county", r6("mean").alias("mean"), "n", "t.id", "t.pm25", "t.category")


@query(
    "tract_detail",
    with_views(
        "v_sensor_day v_tract",
        f", {_PRED}, c AS (SELECT CAST(round_even(lat, 0) AS INT) AS cy, CAST(round_even(lon, 0) AS INT) AS cx, avg(pm25) AS value FROM v_sensor_day WHERE CAST(sensor_id AS BIGINT) % 3 = 0 GROUP BY 1, 2), "
        "t AS (SELECT * FROM v_tract WHERE GEOID = '48000000007'), "
        "n AS (SELECT arg_min(c.value, ((c.cy - t.lat) * (c.cy - t.lat) + (c.cx - t.lon) * (c.cx - t.lon), c.cy, c.cx)) AS v FROM t, c) "
        f"SELECT t.GEOID AS id, pr.pm25, CASE WHEN pr.pm25 <= 9 THEN 'Good' WHEN pr.pm25 <= 13 THEN 'Moderate' WHEN pr.pm25 <= 17 THEN 'Elevated' ELSE 'High' END AS category, {R('coalesce(c.value, n.v, 1.5)')} AS cell_value "
        "FROM t JOIN pr ON pr.id = t.GEOID CROSS JOIN n LEFT JOIN c ON c.cy = round_even(t.lat, 0) AND c.cx = round_even(t.lon, 0)",
    ),
)
def tract_detail(spark, sf_dir):
    """One tract by key: its prediction and the value of its cell, or of the nearest cell that has one."""
    d = v_sensor_day(spark, sf_dir).where(F.col("sensor_id").cast("long") % 3 == 0)
    cells = d.groupBy(cell_index(F.col("lat"), 1.0).alias("cy"), cell_index(F.col("lon"), 1.0).alias("cx")).agg(F.avg("pm25").alias("value"))
    one = tract_by_id(v_tract(spark, sf_dir), "48000000007").select(F.col("GEOID").alias("id"), "lat", "lon")
    filled = joins.cell_or_nearest(one, cells, 1.5).select("id", r6("value").alias("cell_value"))
    return filled.join(predictions(spark, sf_dir).select("id", "pm25", "category"), "id")


@query("tract_geometry", with_views("v_smoke", "SELECT CAST(poly AS VARCHAR) AS geoid, CAST(5 AS INT) AS vertices FROM v_smoke WHERE starts_with(CAST(poly AS VARCHAR), '12')"))
def tract_geometry(spark, sf_dir):
    """Polygons of one county by key prefix, simplified for display."""
    from ..functions.geometry import simplify_features, vertex_count
    from ..functions.scalars import has_prefix

    p = v_smoke(spark, sf_dir).withColumn("geoid", F.col("poly").cast("string")).where(has_prefix(F.col("geoid"), "12"))
    return simplify_features(p, 0.01).select("geoid", vertex_count(F.col("rings")).alias("vertices"))


@query("smoke_layer", with_views("v_smoke", "SELECT coalesce(nullif(density, ''), 'blank') AS density, count(*) AS n FROM v_smoke WHERE date = (SELECT max(date) FROM v_smoke WHERE date BETWEEN DATE '2024-01-28' AND DATE '2024-01-31') AND x + w >= -107 AND x - w <= -93 AND y + w >= 25.5 AND y - w <= 36.6 GROUP BY 1"))
def smoke_layer(spark, sf_dir):
    """Polygons of the latest day near the region, by density."""
    from ..functions.geometry import bbox, box_overlaps
    from ..sources.io import latest_day

    day = latest_day(v_smoke(spark, sf_dir), "2024-01-31", 3).where(box_overlaps(bbox(F.col("rings")), -107.0, 25.5, -93.0, 36.6))
    return day.groupBy(F.coalesce(F.nullif("density", F.lit("")), F.lit("blank")).alias("density")).agg(F.count(F.lit(1)).alias("n"))
