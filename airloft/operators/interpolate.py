"""Spatial interpolation of residuals, and the choice of a correction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import written
from .aggregates import gram
from .joins import knn
from .windows import top_strategies

COINCIDENT_KM = 1e-6
#: Neighbours of a kriging system.
KRIGING_K = 25


def idw(targets: DataFrame, sources: DataFrame, k: int = 8, power: float = 2.0, max_km: float = 150.0, exclude_self: bool = False) -> DataFrame:
    """(id, corr): inverse-distance mean of the k nearest residuals (id, lat, lon, resid) nearer than max_km.

    Sources at the target itself replace the others by their mean; 0 where no
    source is near.
    """
    return _idw(targets, knn(targets.select("id", "lat", "lon"), _sources(sources), k, max_km, exclude_self), power)


def _sources(sensors: DataFrame) -> DataFrame:
    """Sources of knn joins, with their places under names of their own."""
    return sensors.select("id", "lat", "lon", "resid", F.col("lat").alias("slat"), F.col("lon").alias("slon"))


def _idw(targets: DataFrame, near: DataFrame, power: float) -> DataFrame:
    """idw from the neighbours (id, km, resid) themselves."""
    w = F.when(F.col("km") >= COINCIDENT_KM, 1 / F.pow("km", F.lit(power)))
    same = F.avg(F.when(F.col("km") < COINCIDENT_KM, F.col("resid")))
    corr = near.groupBy("id").agg(F.coalesce(same, F.sum(w * F.col("resid")) / F.sum(w)).alias("corr"))
    return targets.select("id").join(corr, "id", "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))


def kriging(targets: DataFrame, sources: DataFrame, range_km: float = 60.0, nugget: float = 0.1, k: int = KRIGING_K, exclude_self: bool = False) -> DataFrame:
    """(id, corr): local ordinary kriging with an exponential variogram over the k nearest residuals.

    0 where all of them are beyond three ranges. Each target's system has
    k + 1 unknowns; those of an Arrow batch are solved together.
    """
    return _kriging(targets, knn(targets.select("id", "lat", "lon"), _sources(sources), k, None, exclude_self), range_km, nugget)


def _kriging(targets: DataFrame, near: DataFrame, range_km: float, nugget: float) -> DataFrame:
    """kriging from the neighbours (id, rank, km, slat, slon, resid) themselves."""
    rows = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "km", "slat", "slon", "resid"))).alias("s"))
    rows = rows.select("id", *[F.col(f"s.{c}").alias(c) for c in ("km", "slat", "slon", "resid")])

    @F.pandas_udf("double")
    def solve(km: pd.Series, lat: pd.Series, lon: pd.Series, resid: pd.Series) -> pd.Series:
        """All systems of a batch at once; shorter ones are filled up with unknowns of their own that come out as 0."""
        lens = km.map(len).to_numpy()
        most = int(lens.max(initial=0))
        there = np.arange(most) < lens[:, None]
        padded = lambda c: np.stack([np.pad(np.asarray(v, float), (0, most - len(v))) for v in c]) if len(c) else np.zeros((0, most))
        h, y, x, r = padded(km), padded(lat), padded(lon), padded(resid)
        n = np.maximum(lens, 1)
        mean = r.sum(axis=1) / n
        spread = (np.where(there, r - mean[:, None], 0.0) ** 2).sum(axis=1) / n
        covariance = lambda d, s: s * np.exp(-3.0 * d / max(range_km, 1.0))
        both = there[:, :, None] & there[:, None, :]
        p, q = np.radians(y), np.radians(x)
        a = np.sin((p[:, :, None] - p[:, None, :]) / 2) ** 2 + np.cos(p)[:, :, None] * np.cos(p)[:, None, :] * np.sin((q[:, :, None] - q[:, None, :]) / 2) ** 2
        system = np.zeros((len(h), most + 1, most + 1))
        system[:, :most, :most] = np.where(both, covariance(2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1))), spread[:, None, None]), 0.0)
        system[:, :most, most] = system[:, most, :most] = there
        system += 1e-6 * np.eye(most + 1)
        system[:, np.arange(most), np.arange(most)] += ~there
        right = np.concatenate([np.where(there, covariance(h, spread[:, None]), 0.0), np.ones((len(h), 1))], axis=1)
        try:
            weights = np.linalg.solve(system, right[:, :, None])[:, :most, 0]
        except np.linalg.LinAlgError:  # some system is singular: the least weights that fit best
            weights = np.stack([np.linalg.lstsq(m, v, rcond=None)[0][:most] for m, v in zip(system, right)])
        near = (there & (h <= 3 * range_km)).any(axis=1)
        return pd.Series(np.where(near, (weights * r).sum(axis=1), 0.0))

    corr = rows.select("id", solve("km", "slat", "slon", "resid").alias("corr"))
    return targets.select("id").join(corr, "id", "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))


def ridge_loo(sensors: DataFrame, feats, alpha: float = 2.0, y: str = "resid") -> DataFrame:
    """(id, corr): for each sensor the prediction of a ridge fit on all the others.

    One fit on all rows serves: leaving a row out changes its residual by the
    factor 1 / (1 - leverage), also with a penalty. Sums of products give the fit,
    of as many unknowns as features; the intercept is not penalised. 0 for a
    lone sensor.
    """
    names = list(feats)
    total = gram(sensors, names, y).first().asDict()
    n = total["n"] or 0
    if n < 2:
        return sensors.select("id", F.lit(0.0).alias("corr"))
    key = lambda a, b: f"s_{a}_{b}" if f"s_{a}_{b}" in total else f"s_{b}_{a}"
    mean, my = np.array([total[f"s_{a}"] / n for a in names]), total[f"s_{y}"] / n
    xx = np.array([[total[key(a, b)] for b in names] for a in names]) - n * np.outer(mean, mean) + alpha * np.eye(len(names))
    inverse = np.linalg.inv(xx)
    beta = inverse @ (np.array([total[key(a, y)] for a in names]) - n * mean * my)
    off = [F.col(a) - float(m) for a, m in zip(names, mean)]
    fitted = sum((c * float(w) for c, w in zip(off, beta)), F.lit(float(my)))
    leverage = sum((a * b * float(inverse[i, j]) for i, a in enumerate(off) for j, b in enumerate(off)), F.lit(1.0 / n))
    return sensors.select("id", (F.col(y) - (F.col(y) - fitted) / (1 - leverage)).alias("corr"))


def forest_loo(sensors: DataFrame, feats, folds: int = 5, y: str = "resid", trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """(id, corr): forest predictions of sensors held out in whole folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from .windows import group_folds

    rows = written(VectorAssembler(inputCols=list(feats), outputCol="features").transform(sensors.join(group_folds(sensors, "id", folds), "id")))
    least, out = min(30, max(1, rows.count() // 10)), None
    for f in range(folds):
        model = RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(rows.where(F.col("fold") != f))
        part = model.transform(rows.where(F.col("fold") == f)).select("id", F.col("prediction").alias("corr"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_correction(rows: DataFrame, corr: DataFrame, shrink: float = 1.0, cap: float | None = None) -> DataFrame:
    """One row r2, rmse, mae, corr_std, corr_min, corr_max, rho of rows (id, y, p) corrected by (id, corr).

    Corrections are shrunk, capped in size and the sum floored at 0; rho is
    their correlation with the predictions, 0 where they hardly vary.
    """
    return rows.join(corr, "id", "left").withColumn("_c", _applied(F.coalesce("corr", F.lit(0.0)), shrink, cap)).agg(*_figures())


def _applied(corr: Column, shrink: float = 1.0, cap: float | None = None) -> Column:
    """A correction after shrinking and cap."""
    c = corr * shrink
    return c if cap is None else F.least(F.greatest(c, F.lit(-float(cap))), F.lit(float(cap)))


def _figures() -> list[Column]:
    """The aggregates of evaluate_correction over rows (y, p, _c)."""
    err, n = F.greatest(F.lit(0.0), F.col("p") + F.col("_c")) - F.col("y"), F.count(F.lit(1))
    spread = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n
    rho = F.when(F.stddev_pop("_c") > 1e-9, F.try_divide(F.covar_pop("p", "_c"), F.stddev_pop("p") * F.stddev_pop("_c"))).otherwise(0.0)
    return [
        (1 - F.sum(err * err) / spread).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        F.stddev_pop("_c").alias("corr_std"), F.min("_c").alias("corr_min"), F.max("_c").alias("corr_max"), rho.alias("rho"),
    ]


#: The searched strategies: kind and parameters are columns, not names to be parsed.
STRATEGIES = (
    *({"kind": "idw", "k": k, "power": p, "max_km": d, "shrink": s, "cap": c} for k, p, d, s, c in ((5, 2.0, 100.0, 1.0, None), (8, 2.0, 150.0, 1.0, None), (8, 2.0, 150.0, 0.5, None), (8, 2.0, 150.0, 0.5, 2.0), (12, 1.0, 200.0, 0.5, None), (12, 3.0, 200.0, 0.5, None), (20, 2.0, 300.0, 0.3, 2.0))),
    *({"kind": "kriging", "range_km": r, "nugget": g, "shrink": s, "cap": c} for r, g, s, c in ((30.0, 0.1, 1.0, None), (60.0, 0.1, 1.0, None), (60.0, 0.5, 0.5, None), (100.0, 0.5, 0.5, 2.0), (150.0, 1.0, 0.5, 2.0))),
    *({"kind": kind, "shrink": s, "cap": c} for kind in ("ridge", "forest") for s, c in ((1.0, None), (0.5, None), (0.5, 2.0))),
)


def correction(targets: DataFrame, sensors: DataFrame, config: dict, feats=("lat", "lon"), exclude_self: bool = False) -> DataFrame:
    """(id, corr) of one strategy before shrinking; ridge and forest predict held-out sensors only."""
    if config["kind"] == "idw":
        return idw(targets, sensors, config["k"], config["power"], config["max_km"], exclude_self)
    if config["kind"] == "kriging":
        return kriging(targets, sensors, config["range_km"], config["nugget"], exclude_self=exclude_self)
    return ridge_loo(sensors, feats) if config["kind"] == "ridge" else forest_loo(sensors, feats)


def search_corrections(rows: DataFrame, sensors: DataFrame, configs=STRATEGIES, feats=("lat", "lon")) -> DataFrame:
    """(name, config, r2, ...) of each strategy, each sensor corrected from the others.

    One neighbour join of the most neighbours that any strategy takes, at any
    distance, serves all. Strategies that differ only in shrinking and cap
    share one correction, and all corrections meet the rows in one join.
    """
    import json

    sensors = written(sensors)
    places, kinds, parts, tried = sensors.select("id", "lat", "lon"), {}, [], []
    most = max((c["k"] if c["kind"] == "idw" else KRIGING_K for c in configs if c["kind"] in ("idw", "kriging")), default=0)
    near = written(knn(places, _sources(sensors), most, None, exclude_self=True)) if most else None
    for i, config in enumerate(configs):
        kind = tuple(sorted((k, v) for k, v in config.items() if k not in ("shrink", "cap")))
        if kind not in kinds:
            kinds[kind] = f"c{len(kinds)}"
            if config["kind"] == "idw":
                made = _idw(places, near.where((F.col("rank") <= config["k"]) & (F.col("km") < config["max_km"])), config["power"])
            elif config["kind"] == "kriging":
                made = _kriging(places, near.where(F.col("rank") <= KRIGING_K), config["range_km"], config["nugget"])
            else:
                made = correction(sensors, sensors, config, feats)
            parts.append(made.select("id", F.lit(kinds[kind]).alias("kind"), "corr"))
        applied = _applied(F.coalesce(kinds[kind], F.lit(0.0)), config.get("shrink", 1.0), config.get("cap"))
        one = F.struct(F.lit(f"{config['kind']}-{i}").alias("name"), F.lit(json.dumps(config)).alias("config"), applied.alias("_c"))
        tried.append(one)
    made = reduce(DataFrame.unionByName, parts).groupBy("id").pivot("kind", list(kinds.values())).agg(F.first("corr"))
    each = rows.join(made, "id", "left").select("y", "p", F.inline(F.array(*tried)))
    return each.groupBy("name", "config").agg(*_figures())


def deploy_gate(results: DataFrame, base_r2: float, gain: float = 0.01, rho: float = 0.3) -> DataFrame:
    """The best strategy with gain, deploy and reason: no_improvement, over_correction or accepted."""
    best = top_strategies(results, 1).withColumn("gain", F.col("r2") - base_r2)
    reason = F.when(F.col("gain") < gain, "no_improvement").when(F.abs("rho") > rho, "over_correction").otherwise("accepted")
    return best.withColumn("reason", reason).withColumn("deploy", F.col("reason") == "accepted")


def apply_correction(tracts: DataFrame, sensors: DataFrame, config: dict) -> DataFrame:
    """(id, corr) of all tracts to four places by a distance-based strategy."""
    c = _applied(F.col("corr"), config.get("shrink", 1.0), config.get("cap"))
    return correction(tracts, sensors, config).withColumn("corr", F.bround(c, 4))
