"""Work that starts again: validation over a half-finished folder, publishing of replayed batches, state with expiry."""

import random

import pytest
from pyspark.sql import functions as F

from airloft.operators import joins, modelling as ml
from airloft.sources import io
from airloft.streaming import live


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(8)
    rows = [(f"s{i}", 30 + rng.random(), -97 + rng.random(), f"2024-0{1 + d // 20}-{1 + d % 20:02d}", rng.uniform(0, 40)) for i in range(9) for d in range(25) if rng.random() < 0.8]
    return io.written(spark.createDataFrame(rows, "sensor_id string, lat double, lon double, date string, pm25 double").withColumn("date", F.col("date").cast("date")))


FEATURES = ["lat", "lon", "loo_mean", "nbr_pm25_50km", "nbr_count_25km"]


def test_fold_features_equal_a_full_recompute(spark, readings):
    """Neighbours of two months, with the fold's sensors really taken out of the pool."""
    folds = readings.select("sensor_id", F.pmod(F.substring("sensor_id", 2, 1).cast("int"), F.lit(3)).alias("fold")).distinct()
    parts = joins.fold_sums(readings, folds)
    for f in range(3):
        pool = readings.join(folds.where(F.col("fold") != f), "sensor_id", "left_semi")
        want = {(r["sensor_id"], r["date"]): r for r in joins.neighbor_features(pool, pool).collect()}
        got = {(r["sensor_id"], r["date"]): r for r in joins.fold_features(parts, f).where(F.col("fold") != f).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            for c in (*[f"nbr_pm25_{x}km" for x in (25, 50, 100)], *[f"nbr_count_{x}km" for x in (25, 50, 100)], "nbr_std_50km"):
                assert got[k][c] == pytest.approx(r[c], abs=1e-6), (f, k, c)


def test_validation_makes_only_what_is_missing(spark, readings, tmp_path, monkeypatch):
    fits, fit = [], ml.fit_models

    def counted(*args, **kwargs):
        fits.append(1)
        if len(fits) == 3:
            raise RuntimeError("lost")
        return fit(*args, **kwargs)

    monkeypatch.setattr(ml, "fit_models", counted)
    with pytest.raises(RuntimeError):
        ml.site_out_neighbors_cv(readings, FEATURES, str(tmp_path / "cv"), 3)
    assert len(fits) == 3
    out = ml.site_out_neighbors_cv(readings, FEATURES, str(tmp_path / "cv"), 3)
    assert len(fits) == 4 and out.count() == readings.count()
    first = sorted(map(tuple, out.select("sensor_id", "date", "p_forest").collect()))
    again = ml.site_out_neighbors_cv(readings, FEATURES, str(tmp_path / "cv"), 3)
    assert len(fits) == 4 and sorted(map(tuple, again.select("sensor_id", "date", "p_forest").collect())) == first


def test_a_batch_is_published_once(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(30)
    assert io.publish(df, path, 4) and not io.publish(df, path, 4) and io.publish(df.limit(3), path, 5)
    assert len(io._versions(spark, path)) == 2 and io.load_or_none(spark, path).count() == 3
    for n in range(6, 12):
        io.publish(df.limit(n), path, n, keep=3)
    assert len(io._versions(spark, path)) == 3 and io.load_or_none(spark, path).count() == 11


def test_models_are_saved_whole(spark, readings, tmp_path):
    path = str(tmp_path / "models")
    assert ml.load_models(spark, path) is None
    models = ml.fit_models(readings, ["lat", "lon"], "pm25", trees=3, depth=3)
    ml.save_models(spark, path, models, {"forest": 1.0, "boosted": 0.0}, ["lat", "lon"], {"lat": 30.0})
    models["forest"].save(f"{path}/version=000000000009-half/forest")  # a set that was never finished
    found = ml.load_models(spark, path)
    assert found["weights"] == {"forest": 1.0, "boosted": 0.0} and found["fill"] == {"lat": 30.0}
    a = ml.score_with(readings, found).agg(F.sum("pm25_pred")).first()[0]
    b = ml.score(readings, ["lat", "lon"], models, found["weights"]).agg(F.sum("pm25_pred")).first()[0]
    assert a == pytest.approx(b)


def test_last_good_values_expire(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    form = "sensor_id string, ts timestamp, pm25 double"
    cycles = [
        [("a", "10:00:00", 1.0), ("b", "10:05:00", 2.0), ("a", "09:59:00", 9.0)],
        [("c", "11:30:00", 3.0)],  # a and b are past an hour
        [("b", "12:00:00", 4.0), ("c", "13:20:00", None)],
        [("c", "14:00:00", 5.0)],  # a is past three hours
    ]
    seen = []
    for i, rows in enumerate(cycles):
        spark.createDataFrame([(k, f"2024-01-01 {t}", v) for k, t, v in rows], "sensor_id string, ts string, pm25 double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(landing)
        stream = live.last_good(spark.readStream.schema(form).parquet(landing), "1 hour", "3 hours", delay="1 minute")

        def write(batch, number, i=i):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        status = live.settled(spark.read.parquet(out), "batch")
        seen.append({r["sensor_id"]: (r["source"], r["pm25"]) for r in status.collect()})
    assert seen[0] == {"a": ("live", 1.0), "b": ("live", 2.0)}
    assert seen[1] == {"a": ("last", 1.0), "b": ("last", 2.0), "c": ("live", 3.0)}
    assert seen[3] == {"a": ("expired", None), "b": ("last", 4.0), "c": ("live", 5.0)}
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sensor_id string")
    found = live.from_status(keys, status, spark.createDataFrame([("a", 7.0)], "sensor_id string, pm25 double"), 8.5)
    assert {r["sensor_id"]: (r["source"], r["pm25"]) for r in found.collect()} == {"a": ("climatology", 7.0), "b": ("last", 4.0), "c": ("live", 5.0), "d": ("fill", 8.5)}


def test_panes_give_the_windows(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", f"2024-01-0{rng.randrange(1, 6)} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", rng.choice([None, rng.random()])) for i in range(60)]
    df = spark.createDataFrame(rows, "sensor_id string, ts string, pm25 double").withColumn("ts", F.col("ts").cast("timestamp"))
    want = df.groupBy("sensor_id", F.window("ts", "24 hours", "3 hours").alias("w")).agg(F.avg("pm25").alias("mean"), F.count("pm25").alias("n")).select("sensor_id", F.col("w.end").alias("end"), "mean", "n")
    tidy = lambda x: sorted((r["sensor_id"], str(r["end"]), None if r["mean"] is None else round(r["mean"], 9), r["n"]) for r in x.collect())
    assert tidy(live.rolling_24h(df, slide="3 hours")) == tidy(want)
