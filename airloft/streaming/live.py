"""Structured Streaming forms of the live feeds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clean import live_qc
from ..operators.joins import point_neighbors
from ..operators.modelling import load_models, score_with
from ..sources.io import publish, written

LIVE_SCHEMA = "sensor_id string, ts timestamp, latitude double, longitude double, pm_24h double, pm_now double, confidence double"


def stream_sensors(spark: SparkSession, path: str, form: str = "json", schema: str = LIVE_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Readings of landed files as a stream, quality-checked like the batch reading."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return live_qc(reader.load(path))


def drop_stale(df: DataFrame, max_age: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Batch: rows no older than max_age before the newest. Stream: late rows beyond max_age fall behind the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, max_age)
    newest = df.agg(F.max(ts).alias("m")).scalar()
    return df.where(F.col(ts) >= newest - F.expr(f"INTERVAL {max_age}"))


def latest_per_sensor(df: DataFrame, key: str = "sensor_id", ts: str = "ts") -> DataFrame:
    """The newest reading of each key; update or complete mode on a stream. Ties go to the greatest values."""
    rest = [c for c in df.columns if c not in (key, ts)]
    best = df.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in (ts, *rest)])


def rolling_24h(df: DataFrame, key: str = "sensor_id", ts: str = "ts", col: str = "pm25", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, end, mean, n) of the 24 hours before each step of the slide.

    Readings are summed by panes of one slide; an end combines the panes of its 24
    hours, so no reading is copied. On a stream (update mode) each key's state
    holds its panes, until the watermark is past all ends that need them, and the
    ends that a batch changes come out. Readings behind the watermark are left out.
    """
    step, day = _seconds(slide), 86_400
    pane = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (step * 1_000_000)) + 1) * step  # the first end that holds the reading
    if not df.isStreaming:
        panes = df.groupBy(key, pane.alias("end")).agg(F.sum(col).alias("s"), F.count(col).alias("n"))
        following = F.coalesce(F.lead("end").over(Window.partitionBy(key).orderBy("end")), F.col("end") + day)
        ends = panes.withColumn("to", F.least(following, F.col("end") + day) - step).withColumn("at", F.explode(F.sequence("end", "to", F.lit(step))))
        own = F.col("at") == F.col("end")
        frame = Window.partitionBy(key).orderBy("at").rangeBetween(step - day, 0)
        rows = ends.withColumns({"s": F.when(own, F.col("s")), "n": F.when(own, F.col("n")).otherwise(0)}).withColumns({"s": F.sum("s").over(frame), "n": F.sum("n").over(frame)})
        return rows.select(key, F.timestamp_seconds("at").alias("end"), F.try_divide("s", "n").alias("mean"), "n")

    def combine(keys, batches, state: GroupState):
        held = {int(e): (s, n) for e, s, n in zip(*state.get)} if state.exists else {}
        changed: set[int] = set()
        for rows in batches:
            sums = rows.groupby("pane")["value"].agg(["sum", "count"])
            for end, total, n in zip(sums.index, sums["sum"], sums["count"]):
                old = held.get(int(end), (0.0, 0))
                held[int(end)] = (old[0] + float(total), old[1] + int(n))
                changed.update(range(int(end), int(end) + day, step))
        past = state.getCurrentWatermarkMs() / 1000 - day
        order = sorted(held)
        out = []
        for end in sorted(changed):
            near = [held[e] for e in order[bisect_left(order, end - day + step) : bisect_right(order, end)]]
            n = sum(x[1] for x in near)
            out.append((keys[0], pd.Timestamp(end, unit="s"), sum(x[0] for x in near) / n if n else None, n))
        kept = {e: x for e, x in held.items() if e > past - day}  # a late reading may still change ends that reach back a day
        state.update((list(kept), [x[0] for x in kept.values()], [x[1] for x in kept.values()]))
        yield pd.DataFrame(out, columns=[key, "end", "mean", "n"])

    rows = df.withWatermark(ts, delay).select(key, ts, pane.alias("pane"), F.col(col).cast("double").alias("value"))
    kind = dict(df.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(combine, f"{key} {kind}, end timestamp, mean double, n long", "ends array<long>, sums array<double>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def _seconds(interval: str) -> int:
    """Seconds of an interval such as '15 minutes'."""
    return int(pd.Timedelta(interval).total_seconds())


def stream_daily_mean(df: DataFrame, key, ts: str = "ts", col: str = "pm25", delay: str = "2 hours") -> DataFrame:
    """(key, date, mean) by whole days; on a stream in append mode a day comes out once it is closed."""
    key = [key] if isinstance(key, str) else list(key)
    at = df.withWatermark(ts, delay) if df.isStreaming else df
    out = at.groupBy(*key, F.window(ts, "1 day").alias("w")).agg(F.avg(col).alias("mean"))
    return out.select(*key, F.col("w.start").cast("date").alias("date"), "mean")


def closed_days(df: DataFrame, key, ts: str = "ts", col: str = "pm25", delay: str = "6 hours") -> DataFrame:
    """Daily means without the day still open: by watermark on a stream, by the newest row in a batch."""
    out = stream_daily_mean(df, key, ts, col, delay)
    if df.isStreaming:
        return out
    newest = df.agg((F.max(ts) - F.expr(f"INTERVAL {delay}")).cast("date").alias("m")).scalar()
    return out.where(F.col("date") < newest)


def stream_dedupe(df: DataFrame, keys, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """One row a key, the first to arrive within the delay; any one in a batch."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def publish_if_usable(path: str, min_n: int = 20, keep: int = 8):
    """A foreachBatch function: batches of min_n rows or more become the newest version of the table at `path`, once each; see load_or_none."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(min_n).count() >= min_n:
            publish(batch, path, number, keep)

    return run


def last_good(df: DataFrame, live_for: str = "1 hour", good_for: str = "1 day", key: str = "sensor_id", ts: str = "ts", col: str = "pm25", delay: str = "10 minutes") -> DataFrame:
    """Changes (key, source, value, ts) of each key's best value on a stream (update mode).

    A reading is live until the watermark has passed it by live_for, then the
    last good value until good_for, and then it expires: its state is dropped
    and the value is null. Timers in the state bring this about without new
    readings of the key. Of a key's readings the newest counts, of equal times
    the greatest value.
    """
    live_ms, good_ms = _seconds(live_for) * 1000, _seconds(good_for) * 1000

    def turn(keys, batches, state: GroupState):
        now = state.getCurrentWatermarkMs()
        value, at, was = state.get if state.exists else (None, -1, "")
        if not state.hasTimedOut:
            for rows in batches:
                rows = rows.dropna(subset=["value"])
                if len(rows):
                    best = rows.sort_values(["at", "value"]).iloc[-1]
                    if (int(best["at"]), float(best["value"])) > (at, -1e308 if value is None else value):
                        at, value = int(best["at"]), float(best["value"])
        if at < 0:
            return
        source = "live" if at + live_ms >= now else "last" if at + good_ms >= now else "expired"
        if source == "expired":
            if state.exists:
                state.remove()
            value = None
        else:
            state.update((value, at, source))
            state.setTimeoutTimestamp(max(at + (live_ms if source == "live" else good_ms), now + 1))
        yield pd.DataFrame([(keys[0], source, value, pd.Timestamp(at, unit="ms"))], columns=[key, "source", col, ts])

    rows = df.withWatermark(ts, delay).select(key, ts, F.unix_millis(F.col(ts)).alias("at"), F.col(col).cast("double").alias("value"))
    kind = dict(df.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(turn, f"{key} {kind}, source string, {col} double, {ts} timestamp", "value double, at long, source string", "update", GroupStateTimeout.EventTimeTimeout)


def settled(changes: DataFrame, order: str, key: str = "sensor_id") -> DataFrame:
    """The last change of each key, by a column that numbers the batches."""
    rest = [c for c in changes.columns if c not in (key, order)]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "ts")).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def from_status(keys: DataFrame, status: DataFrame, climatology: DataFrame, fill: float, key: str = "sensor_id", col: str = "pm25") -> DataFrame:
    """keys with the value and source of last_good's status; of its climatology, else the fill, where that has expired or never was."""
    pick = lambda name: status.where(F.col("source") == name).select(key, col)
    return with_fallback(keys, pick("live"), pick("last"), climatology, fill, key, col)


def with_fallback(keys: DataFrame, live: DataFrame, last: DataFrame, climatology: DataFrame, fill: float, key: str = "sensor_id", col: str = "pm25") -> DataFrame:
    """keys with the first value there is and its source: live, last, climatology or fill."""
    out = keys
    names = ("live", "last", "climatology")
    for name, df in zip(names, (live, last, climatology)):
        out = out.join(df.select(key, F.col(col).alias(f"_{name}")), key, "left")
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names], F.lit("fill"))
    return out.withColumn("source", source).withColumn(col, F.coalesce(*[F.col(f"_{n}") for n in names], F.lit(float(fill)))).drop(*[f"_{n}" for n in names])


def score_batch(tracts: DataFrame, scorer, path: str, min_n: int = 20, keep: int = 8):
    """A foreachBatch function: neighbours of each tract in the batch, scored and published once; small batches leave the last result."""

    def run(batch: DataFrame, number: int) -> None:
        latest = latest_per_sensor(batch.select("sensor_id", "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "pm25"))
        found = written(point_neighbors(tracts, latest, min_n=min_n))
        if found.limit(1).count():
            publish(scorer(found), path, number, keep)

    return run


def model_scorer(spark: SparkSession, path: str, prepare=lambda df: df):
    """A scorer that loads the newest complete set of models at `path` in every cycle, so a new set takes effect without a restart; prepare adds the features that neighbours don't give."""

    def run(found: DataFrame) -> DataFrame:
        held = load_models(spark, path)
        if held is None:
            raise ValueError(f"no complete set of models at {path}")
        return score_with(prepare(found), held)

    return run


def running_count(df: DataFrame, every: str = "10 minutes", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(end, n) events of each step; a batch also gets the running total."""
    at = df.withWatermark(ts, delay) if df.isStreaming else df
    out = at.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("end"), "n")
    if df.isStreaming:
        return out
    return out.withColumn("total", F.sum("n").over(Window.orderBy("end").rowsBetween(Window.unboundedPreceding, 0)))  # one row a step


def batch_provenance(batch: DataFrame, ts: str = "ts", key: str = "sensor_id", min_n: int = 20) -> DataFrame:
    """One row: rows, sensors, first and last time, and whether the snapshot is usable."""
    return batch.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("sensors"), F.min(ts).alias("first"), F.max(ts).alias("last"), (F.countDistinct(key) >= min_n).alias("usable"))
