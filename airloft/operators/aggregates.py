"""Aggregations: sensor statistics, summaries, metrics, coverage and Gram matrices."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band_name, epa_aqi
from ..functions.scalars import null_nan
from ..sources.io import written
from .joins import dist_to_set
from .quantiles import quantiles


def sensor_stats(df: DataFrame, key: str = "sensor_id", col: str = "pm25") -> DataFrame:
    """Sample deviation, exact median and count by sensor."""
    stats = df.groupBy(key).agg(F.stddev_samp(col).alias("std"), F.count(col).alias("n"))
    return stats.join(quantiles(df, {"median": (F.col(col), 0.5)}, key), key).select(key, "std", "median", "n")


def climatology(df: DataFrame, order: str = "date") -> DataFrame:
    """First position, mean and count by sensor."""
    first = F.min_by(F.struct("lat", "lon"), order)
    return df.groupBy("sensor_id").agg(first.alias("_p"), F.avg("pm25").alias("mean"), F.count("pm25").alias("n")).select("sensor_id", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), "mean", "n")


def residual_by_sensor(df: DataFrame, order: str = "date") -> DataFrame:
    """Mean of y - p by sensor, with its first position and number of rows."""
    first = F.min_by(F.struct("lat", "lon"), order)
    out = df.groupBy("sensor_id").agg(first.alias("_p"), F.avg(F.col("y") - F.col("p")).alias("resid"), F.count(F.lit(1)).alias("n"))
    return out.select("sensor_id", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), "resid", "n")


def residual_by_tract(oof: DataFrame) -> DataFrame:
    """Mean absolute residual by GEOID over rows that were evaluated, to four places."""
    return oof.where("valid").groupBy("GEOID").agg(F.bround(F.avg(F.abs(F.col("y") - F.col("p"))), 4).alias("residual"))


def daily_mean(df: DataFrame, key, ts: str, cols) -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key, F.col(ts).cast("date").alias("date")).agg(*[F.avg(c).alias(c) for c in cols])


def today_mean(df: DataFrame, today, key, col: str, date: str = "date") -> DataFrame:
    """Mean of today's values, of all where today has none."""
    return df.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col(date) == F.lit(today).cast("date"), F.col(col))), F.avg(col)).alias(col))


def category_counts(df: DataFrame, col: str, domain) -> DataFrame:
    """(cat, n, pct) of every category of the domain, zero ones too; shares in whole percent, half up."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(domain)], "ord int, cat string")
    counts = df.groupBy(F.col(col).alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    out = names.join(counts, "cat", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("pct", F.when(total > 0, F.floor(100.0 * F.col("n") / total + 0.5)).otherwise(0).cast("int")).select("ord", "cat", "n", "pct")


def coverage_share(df: DataFrame, cols) -> DataFrame:
    """(col, filled, positive): shares of rows with a value, and with one above 0."""
    parts = [F.struct(F.lit(c).alias("col"), F.avg(null_nan(F.col(c).cast("double")).isNotNull().cast("double")).alias("filled"), (F.count_if(F.col(c) > 0) / F.count(F.lit(1))).alias("positive")) for c in cols]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def pearson(df: DataFrame, a: str, b: str, eps: float = 1e-9) -> DataFrame:
    """One row r; 0 where either hardly varies."""
    flat = (F.coalesce(F.stddev_pop(a), F.lit(0.0)) <= eps) | (F.coalesce(F.stddev_pop(b), F.lit(0.0)) <= eps)
    return df.agg(F.when(flat, 0.0).otherwise(F.corr(a, b)).alias("r"))


def percentiles(df: DataFrame, col: str, ps, by=()) -> DataFrame:
    """Exact, linearly interpolated percentiles as columns p25, p50, ..."""
    return quantiles(df, {f"p{p}": (F.col(col), p / 100.0) for p in ps}, by)


def _metrics(y: str, p: str) -> list[Column]:
    err, n = F.col(p) - F.col(y), F.count(F.lit(1))
    spread = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return [n.alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.when(spread > 0, 1 - F.sum(err * err) / spread).alias("r2")]


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """n, rmse, mae, r2 in one pass; rows with a null in either are left out."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(*_metrics(y, p))


def metrics_by(df: DataFrame, key, min_n: int = 3, y: str = "y", p: str = "p") -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*key).agg(*_metrics(y, p)).where(F.col("n") >= min_n)


def region_summary(preds: DataFrame, region) -> DataFrame:
    """Mean of each region with the AQI and band of that mean."""
    out = preds.groupBy(region).agg(F.avg("pm25").alias("mean_pm25"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("aqi", epa_aqi(F.col("mean_pm25"))).withColumn("category", band_name(F.col("mean_pm25")))


def mad_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Median and median absolute deviation by key."""
    med = quantiles(df, {"med": (F.col(col), 0.5)}, key)
    mad = quantiles(df.join(med, key), {"mad": (F.abs(F.col(col) - F.col("med")), 0.5)}, key)
    return med.join(mad, key)


def profile(df: DataFrame, key: str = "sensor_id", date: str = "date") -> DataFrame:
    span = F.datediff(F.max(date), F.min(date)) + 1
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.min(date).alias("first"), F.max(date).alias("last"), span.alias("days"))


def coverage(tracts: DataFrame, selected: DataFrame, existing: DataFrame, miles: float = 10.0) -> DataFrame:
    """One row: tracts within reach of old and new sensors; new_covered is the difference of two counts."""
    d = written(_distances(tracts, selected, existing))
    n = F.count(F.lit(1))
    covered, before = F.count_if(F.col("dist") <= miles), F.count_if(F.col("dist_old") <= miles)
    row = d.agg(
        n.alias("total"), covered.alias("covered"), before.alias("existing_covered"), (covered - before).alias("new_covered"),
        (100.0 * covered / n).alias("pct"), F.avg("dist").alias("avg_miles"), F.max("dist").alias("max_miles"),
    )
    return row.join(F.broadcast(quantiles(d, {"median_miles": (F.col("dist"), 0.5)})), F.lit(True))  # one row each


def _distances(tracts: DataFrame, selected: DataFrame, existing: DataFrame) -> DataFrame:
    """Tracts with the miles to the nearest of all sensors and of the old ones."""
    old = dist_to_set(tracts, existing.select("lat", "lon"), None, miles=True).withColumnRenamed("dist", "dist_old")
    both = existing.select("lat", "lon").union(selected.select("lat", "lon"))
    return dist_to_set(old, both, None, miles=True)


def coverage_by_quartile(tracts: DataFrame, selected: DataFrame, existing: DataFrame, miles: float = 10.0) -> DataFrame:
    """The same by quartile of ejf; bounds come from scores above 0, zeros count in the first, 101 and more nowhere."""
    d = _distances(tracts, selected, existing)
    ej = F.coalesce("ejf", F.lit(0.0))
    positive = F.when(F.col("ejf") > 0, F.col("ejf"))
    cuts = quantiles(tracts, {f"q{i}": (positive, i / 4) for i in (1, 2, 3)}).first()
    q = F.array(*[F.lit(25.0 * i if cuts[f"q{i}"] is None else cuts[f"q{i}"]) for i in (1, 2, 3)])
    named = d.withColumn("_q", q).withColumn("quartile", F.when(ej < F.col("_q")[0], "Q1").when(ej < F.col("_q")[1], "Q2").when(ej < F.col("_q")[2], "Q3").when(ej < 101, "Q4"))
    n, covered, before = F.count(F.lit(1)), F.count_if(F.col("dist") <= miles), F.count_if(F.col("dist_old") <= miles)
    return named.where("quartile IS NOT NULL").groupBy("quartile").agg(n.alias("total"), covered.alias("covered"), (covered - before).alias("new_covered"), (100.0 * covered / n).alias("pct"), F.avg("dist").alias("avg_miles"))


def pull_cost(log: DataFrame, base: int = 2) -> DataFrame:
    """(kind, calls, rows, points) of a pull log (kind, fields, rows): a call costs base + base * fields * rows."""
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.sum("rows").alias("rows"), F.sum(base + base * F.col("fields") * F.col("rows")).alias("points"))


def gram(df: DataFrame, xs, y: str, fold: str | None = None) -> DataFrame:
    """Sums of products of all columns by fold: n, s_i, s_i_j; the whole is the sum of the folds."""
    cols = [*xs, y]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols]]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in combinations_with_replacement(cols, 2)]
    return df.groupBy(fold).agg(*aggs) if fold else df.agg(*aggs)


def pack_report(preds: DataFrame, region: str, columns) -> DataFrame:
    """(region, json): a region's mean and count with its rows as nested JSON; one region must fit a row."""
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    summary = F.struct(F.round(F.avg("pm25") + 1.37e-8, 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    packed = preds.groupBy(region).agg(summary.alias("summary"), rows.alias("tracts"))
    return packed.select(region, F.to_json(F.struct("summary", "tracts")).alias("json"))


def median_scalars(df: DataFrame, cols) -> DataFrame:
    """One row of medians over all rows, for backfill."""
    from .clean import medians

    return medians(df, cols)
