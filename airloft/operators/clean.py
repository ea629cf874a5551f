"""Projections, filters and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import REGION_BOX, in_box, null_nan, pad_key
from .quantiles import quantiles


def keep_rename(df: DataFrame, mapping: dict) -> DataFrame:
    """The columns of mapping that df has, under their new names."""
    return df.select(*[F.col(c).alias(new) for c, new in mapping.items() if c in df.columns])


def require(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def in_range(df: DataFrame, col: str, lo: float = 0.0, hi: float = 200.0) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def cap_rows(df: DataFrame, col: str, cap: float = 75.0) -> DataFrame:
    return df.where(F.col(col) <= cap)


def active_sensors(df: DataFrame, now: int, seen_days: int = 30, age_days: int = 60, box=REGION_BOX) -> DataFrame:
    """Public outdoor sensors seen lately and known for long enough, within the box; now in epoch seconds."""
    day = 86400
    return df.where(
        ~F.coalesce(F.col("private").cast("boolean"), F.lit(False))
        & (F.col("location_type") == 0)
        & (now - F.coalesce("last_seen", F.lit(0)) <= seen_days * day)
        & (now - F.coalesce("date_created", F.lit(0)) >= age_days * day)
        & in_box(F.col("latitude"), F.col("longitude"), box)
    )


def live_qc(df: DataFrame, confidence: float = 50, lo: float = 0.0, hi: float = 200.0) -> DataFrame:
    """Readings (latitude, longitude, pm25): the daily mean, else the current value, of trusted sensors."""
    pm = F.coalesce(null_nan(F.col("pm_24h")), null_nan(F.col("pm_now")))
    good = (F.coalesce("confidence", F.lit(0)) >= confidence) & pm.between(lo, hi) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.withColumn("pm25", pm).where(good)


def in_set_or_like(df: DataFrame, col: str, values, pattern: str) -> DataFrame:
    """Rows whose value is listed, or that match the pattern whatever their case."""
    return df.where(F.col(col).isin(list(values)) | F.lower(col).rlike(pattern.lower()))


def tract_by_id(df: DataFrame, geoid) -> DataFrame:
    return df.where(F.col("GEOID") == pad_key(F.lit(str(geoid)), 11))


def tag_membership(df: DataFrame, members: DataFrame, key: str = "sensor_id") -> DataFrame:
    """in_tx of the membership table, true where it says nothing."""
    known = members.groupBy(key).agg(F.min("in_tx").alias("_in"))
    return df.drop("in_tx").join(known, key, "left").withColumn("in_tx", F.coalesce("_in", F.lit(True))).drop("_in")


def add_missing(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns}) if set(defaults) - set(df.columns) else df


def conformance(df: DataFrame, expected) -> DataFrame:
    """(col, present, filled): is an expected column there, and how many rows have a value in it."""
    have = set(df.columns)
    parts = [F.struct(F.lit(c).alias("col"), F.lit(c in have).alias("present"), (F.count(c) if c in have else F.lit(0).cast("long")).alias("filled")) for c in expected]
    return df.agg(F.count(F.lit(1)), F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")

def fill_by_precedence(df: DataFrame, features, shared: dict, fill: dict) -> DataFrame:
    """Each feature from the row, else a value shared by all rows, else the training fill, else 0."""

    def value(name: str) -> Column:
        own = [null_nan(F.col(name).try_cast("double"))] if name in df.columns else []
        return F.coalesce(*own, F.lit(shared.get(name)).cast("double"), F.lit(fill.get(name)).cast("double"), F.lit(0.0))

    return df.withColumns({f: value(f) for f in features})


def drop_bad_sensors(df: DataFrame, std: float = 1.0, med: float = 15.0, n: int = 200, key: str = "sensor_id", col: str = "pm25") -> DataFrame:
    """Without sensors that hardly vary (sample deviation), run high or have few readings."""
    middle = quantiles(df, {"_m": (F.col(col), 0.5)}, key)
    stats = df.groupBy(key).agg(F.stddev_samp(col).alias("_s"), F.count(col).alias("_n")).join(middle, key)
    bad = stats.where((F.col("_s") < std) | (F.col("_m") > med) | (F.col("_n") < n))
    return df.join(bad, key, "left_anti")


def medians(df: DataFrame, cols) -> DataFrame:
    """One row of exact medians, NaN skipped."""
    return quantiles(df, {c: (F.col(c), 0.5) for c in cols})


def fill_median(df: DataFrame, cols) -> DataFrame:
    """Nulls and NaN become the column's median, taken before any fill."""
    middle = medians(df, cols).first().asDict()
    return df.withColumns({c: F.coalesce(null_nan(F.col(c).cast("double")), F.lit(middle[c])) for c in cols})


def feature_fill(df: DataFrame, features, zero=("hms_smoke",)) -> DataFrame:
    """(feature, fill): medians, 0 for features whose absence means none."""
    present = [f for f in features if f in df.columns]
    found = [f for f in present if f not in zero]
    row = (medians(df, found) if found else df.agg(F.count(F.lit(1)))).select(*[F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f in found else F.lit(0.0).alias(f) for f in present])
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in present]), F.array(*present))).alias("feature", "fill"))


def flag_present(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    known = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def missing_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Distinct keys of a that b lacks."""
    key = [key] if isinstance(key, str) else list(key)
    return a.select(*key).distinct().join(b, key, "left_anti")


key_minus = missing_keys


def distinct_keys(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).distinct()


def keep_first(df: DataFrame, key, priority) -> DataFrame:
    """One row a key: the first in order of `priority` (columns or names)."""
    from pyspark.sql import Window

    key = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*key).orderBy(*([priority] if isinstance(priority, (str, Column)) else priority))
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


one_per = keep_first


def union_distinct(dfs, key) -> DataFrame:
    """Union in which earlier frames win."""
    from ..sources.io import union_all

    return keep_first(union_all([df.withColumn("_from", F.lit(i)) for i, df in enumerate(dfs)]), key, "_from").drop("_from")


def merge_sparse(dfs, key) -> DataFrame:
    """Frames with few keys each, aligned on the union of their keys; columns of the others are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.join(df, key, "full_outer")
    return out


def roles(df: DataFrame, heldout: Column) -> tuple[DataFrame, DataFrame]:
    """(targets, pool): held-out rows are no targets but stay in the pool."""
    return df.where(~heldout), df


def qc_ledger(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, removed): rows that each rule would remove after those before it; rules map a name to what is kept."""
    kept, parts = F.lit(True), []
    for name, rule in rules.items():
        ok = F.coalesce(rule, F.lit(False))
        parts.append(F.struct(F.lit(name).alias("rule"), F.count_if(kept & ~ok).alias("removed")))
        kept = kept & ok
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
