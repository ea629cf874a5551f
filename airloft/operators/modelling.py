"""Models on assembled features, grouped validation, blends and calibration."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fit_scale, orig_scale
from ..sources.io import _versions, load_or_none, publish, written
from .aggregates import gram, regression_metrics
from .clean import in_set_or_like
from .joins import fold_features, fold_sums
from .windows import group_folds, scenario_std

SEED = 42


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def fit_models(df: DataFrame, features, target: str, trees: int = 40, depth: int = 6, log: bool = False) -> dict:
    """A forest and boosted trees by name; log fits log1p of the target."""
    rows = assemble(df.withColumn("_y", fit_scale(F.col(target)) if log else F.col(target)), features)
    makers = {
        "forest": RandomForestRegressor(labelCol="_y", numTrees=trees, maxDepth=depth, seed=SEED),
        "boosted": GBTRegressor(labelCol="_y", maxIter=max(5, trees // 4), maxDepth=max(2, depth - 2), seed=SEED),
    }
    return {name: m.fit(rows) for name, m in makers.items()}


def predict(df: DataFrame, features, models: dict, log: bool = False) -> DataFrame:
    """df with p_<name> of each model, floored at 0."""
    out = assemble(df, features)
    for name, model in models.items():
        p = orig_scale(F.col("prediction")) if log else F.greatest(F.lit(0.0), F.col("prediction"))
        out = model.transform(out).withColumn(f"p_{name}", p).drop("prediction")
    return out.drop("features")


def hash_split(df: DataFrame, key, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the MD5 of the key's text: the same rows in every run and engine."""
    key = [key] if isinstance(key, str) else list(key)
    digest = F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    test = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < int(share * 1000)
    return df.where(~test), df.where(test)


def spatial_holdout(df: DataFrame, col: str, cities, pattern: str, features, target: str) -> DataFrame:
    """(model, n, rmse, mae, r2) on the rows of some cities of models that never saw them."""
    test = in_set_or_like(df, col, cities, pattern)
    train = df.join(test.select("id"), "id", "left_anti")
    scored = predict(test, features, fit_models(train, features, target))
    parts = [regression_metrics(scored, target, f"p_{m}").withColumn("model", F.lit(m)) for m in ("forest", "boosted")]
    return reduce(DataFrame.unionByName, parts)


def inverse_mse_weights(df: DataFrame, models, y: str = "y", eps: float = 1e-10) -> DataFrame:
    """(model, mse, weight): weights in proportion to 1 / (mse + eps)."""
    parts = [F.struct(F.lit(m).alias("model"), F.avg(F.pow(F.col(f"p_{m}") - F.col(y), 2)).alias("mse")) for m in models]
    rows = df.agg(F.array(*parts).alias("r")).withColumn("s", F.aggregate("r", F.lit(0.0), lambda a, x: a + 1 / (x["mse"] + eps)))
    return rows.select(F.explode("r").alias("x"), "s").select("x.model", "x.mse", (1 / (F.col("x.mse") + eps) / F.col("s")).alias("weight"))


def site_out_cv(df: DataFrame, features, target: str, key: str, path: str, folds: int = 5) -> DataFrame:
    """Out-of-fold predictions with whole sites held out; finished folds are read from `path`, not fitted again."""
    rows = _kept(df.sparkSession, f"{path}/rows", lambda: df.join(group_folds(df, key, folds), key))
    return _by_fold(df.sparkSession, path, features, target, folds, lambda f: rows)


def site_out_neighbors_cv(df: DataFrame, features, path: str, folds: int = 5, radii=(25, 50, 100)) -> DataFrame:
    """The same over rows (sensor_id, lat, lon, date, pm25, ...) with neighbour features and day means rebuilt for each fold without its sensors.

    features may name what fold_features makes. Folds, sums of neighbours and
    finished folds are kept under `path`: a run that starts again there makes
    only what is missing.
    """
    spark = df.sparkSession
    assigned = _kept(spark, f"{path}/folds", lambda: group_folds(df, "sensor_id", folds))
    parts = {name: _kept(spark, f"{path}/{name}", lambda name=name: _once(made, df, assigned, radii)[name]) for made in [{}] for name in ("rows", "held", "days")}
    return _by_fold(spark, path, features, "pm25", folds, lambda f: fold_features(parts, f, radii))


def _once(made: dict, df: DataFrame, assigned: DataFrame, radii) -> dict:
    """The sums of folds, made at the first call."""
    if not made:
        made |= fold_sums(df, assigned, radii)
    return made


def _kept(spark, path: str, make) -> DataFrame:
    """The complete table at path, made first if there is none."""
    found = load_or_none(spark, path)
    if found is None:
        publish(make(), path)
        found = load_or_none(spark, path)
    return found


def _by_fold(spark, path: str, features, target: str, folds: int, rows_of) -> DataFrame:
    """Predictions of each fold by models of the others; rows_of gives the rows (fold, ...) for a fold."""

    def predicted(f: int) -> DataFrame:
        rows = written(rows_of(f))
        models = fit_models(rows.where(F.col("fold") != f), features, target, trees=10, depth=4)
        return predict(rows.where(F.col("fold") == f), features, models)

    return reduce(DataFrame.unionByName, [_kept(spark, f"{path}/fold={f}", lambda f=f: predicted(f)) for f in range(folds)])


def active_set(a: np.ndarray, b: np.ndarray, summed: bool) -> np.ndarray:
    """Weights >= 0, of sum 1 if `summed`, that minimise w'aw - 2 b'w.

    Weights in use are solved for together; a step that would make one
    negative ends there and drops it. Then the unused weight whose growth lowers
    the value fastest comes in, until none does. Each pass solves one system, so
    tens of models are no matter.
    """
    k = len(b)
    scale = max(1e-300, float(np.abs(b).max(initial=0)), float(np.abs(a).max(initial=0)))
    used, w = np.zeros(k, bool), np.zeros(k)
    if summed:
        used[np.argmin(np.diag(a) - 2 * b)] = True
        w[used] = 1.0

    def solved() -> np.ndarray:
        s, out = np.flatnonzero(used), np.zeros(k)
        m = len(s)
        system, right = np.zeros((m + summed, m + summed)), np.ones(m + summed)
        system[:m, :m], right[:m] = a[np.ix_(s, s)] / scale, b[s] / scale
        system[m:, :m], system[:m, m:] = 1.0, 1.0
        out[s] = np.linalg.lstsq(system, right, rcond=None)[0][:m]
        return out

    for _ in range(50 * k):
        gain = (b - a @ w) / scale
        level = float((gain[used] * w[used]).sum()) if summed else 0.0  # at the optimum the gain of all weights in use
        gain[used] = -np.inf
        if used.all() or gain.max() <= level + 1e-12:
            break
        used[np.argmax(gain)] = True
        while True:
            goal = solved()
            if (goal[used] > 0).all():
                w = goal
                break
            falling = used & (goal <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(falling, w / np.maximum(w - goal, 1e-300), np.inf))
            w = w + min(1.0, step) * (goal - w)
            used &= ~(falling & (w <= 1e-14))
            w[~used] = 0.0
            if not used.any():
                break
    return w


def _best_convex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = active_set(a, b, True).clip(0)
    return w / w.sum()


def _best_nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same without the sum, then scaled to 1."""
    w = active_set(a, b, False).clip(0)
    return w / w.sum() if w.sum() > 0 else np.full(len(b), 1.0 / len(b))


def optimality(oof: DataFrame, weights: DataFrame, models, y: str = "y") -> DataFrame:
    """(model, weight, slack): of convex blends; optimal weights have slack 0 where they are used, and none below 0.

    slack is how much faster than the blend's own weights a model's growth would
    raise the mean squared error.
    """
    w = {r["model"]: r["weight"] for r in weights.collect()}  # a row a model
    err = sum((F.col(f"p_{m}") * w[m] for m in models), F.lit(0.0)) - F.col(y)
    blend = sum((F.col(f"p_{m}") * w[m] for m in models), F.lit(0.0))
    parts = [F.struct(F.lit(m).alias("model"), F.lit(w[m]).alias("weight"), F.avg(err * (F.col(f"p_{m}") - blend)).alias("slack")) for m in models]
    return oof.dropna(subset=[*[f"p_{m}" for m in models], y]).agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def blend_weights(oof: DataFrame, models, y: str = "y", key: str = "sensor_id", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(weights, report): blends of a few models from one pass of Gram sums by fold of whole sites.

    weights has (blend, model, weight); report has (blend, r2, grouped), where
    grouped blends are scored on folds whose rows their weights never saw.
    """
    cols = [f"p_{m}" for m in models]
    valid = oof.dropna(subset=[*cols, y])
    rows = gram(valid.join(group_folds(valid, key, folds), key), cols, y, "fold").collect()  # a row a fold
    name = lambda p, q: f"s_{p}_{q}" if f"s_{p}_{q}" in rows[0] else f"s_{q}_{p}"
    take = lambda r, c: (np.array([[r[name(p, q)] for q in c] for p in c]), np.array([r[name(p, y)] for p in c]), r[f"s_{y}_{y}"], r[f"s_{y}"], r["n"])
    add = lambda parts: tuple(sum(x) for x in zip(*parts))

    def r2(loss: float, whole) -> float:
        return float(1 - loss / (whole[2] - whole[3] ** 2 / whole[4]))

    weights, report = [], []

    def blend(label: str, c, solve, grouped: bool) -> None:
        parts = [take(r, c) for r in rows]
        whole = add(parts)
        w = solve(whole[0], whole[1])
        loss = lambda v, p: float(p[2] - 2 * v @ p[1] + v @ p[0] @ v)
        report.append((label, r2(loss(w, whole), whole), False))
        if grouped and len(parts) > 1:
            held = sum(loss(solve(whole[0] - p[0], whole[1] - p[1]), p) for p in parts)
            report.append((label, r2(held, whole), True))
        weights.extend((label, x[2:], float(v)) for x, v in zip(c, w))

    blend("convex", cols, _best_convex, True)
    blend("nonnegative", cols, _best_nonnegative, True)
    blend("equal", cols, lambda a, b: np.full(len(b), 1.0 / len(b)), False)
    for i, c in enumerate(cols):
        blend(f"single_{models[i]}", [c], lambda a, b: np.ones(1), False)
        if len(cols) > 2:
            blend(f"drop_{models[i]}", [x for x in cols if x != c], _best_convex, True)
    spark = oof.sparkSession
    return spark.createDataFrame(weights, "blend string, model string, weight double"), spark.createDataFrame(report, "blend string, r2 double, grouped boolean")


def calibrate_cv(oof: DataFrame, y: str = "y", p: str = "p", key: str = "sensor_id", folds: int = 5) -> DataFrame:
    """oof with cal: a monotone fit on the other folds' rows, constant beyond its range."""
    rows = oof.join(group_folds(oof, key, folds), key)
    parts = []
    for f in range(folds):
        model = IsotonicRegression(labelCol=y, featuresCol=p, predictionCol="cal").fit(rows.where(F.col("fold") != f))
        parts.append(model.transform(rows.where(F.col("fold") == f)))
    return reduce(DataFrame.unionByName, parts)


def isotonic_bins(bins: DataFrame, by: str, bin: str = "bin") -> DataFrame:
    """(by, bin, cal): monotone fit to bins (by, bin, s, n) of sums and counts, by the min-max formula.

    A bin's value is the largest, over bins not after it, of the smallest mean of
    the bins from there to one not before it. Bins are few, and each is paired with
    the later ones of its group only. Bins without rows take the value before
    them, or the first one.
    """
    so_far = Window.partitionBy(by).orderBy(bin)
    full = bins.where("n > 0").withColumns({"_s": F.sum("s").over(so_far), "_n": F.sum("n").over(so_far)})
    start = full.select(by, F.col(bin).alias("_from"), (F.col("_s") - F.col("s")).alias("_s0"), (F.col("_n") - F.col("n")).alias("_n0"))
    spans = full.select(by, bin, "_s", "_n").join(start, by).where(F.col("_from") <= F.col(bin)).withColumn("_mean", (F.col("_s") - F.col("_s0")) / (F.col("_n") - F.col("_n0")))
    least = F.min("_mean").over(Window.partitionBy(by, "_from").orderBy(bin).rowsBetween(0, Window.unboundedFollowing))
    fit = spans.withColumn("_least", least).groupBy(by, bin).agg(F.max("_least").alias("_cal"))
    up, down = so_far.rowsBetween(Window.unboundedPreceding, 0), so_far.rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last("_cal", True).over(up), F.first("_cal", True).over(down))
    return bins.select(by, bin).join(fit, [by, bin], "left").select(by, bin, filled.alias("cal"))


def calibrate_binned_cv(rows: DataFrame, y: str = "y", p: str = "p", width: float = 0.5) -> DataFrame:
    """rows (fold, y, p, ...) with cal: a monotone fit on the bins of the other folds, each `width` wide in p.

    One pass sums all bins by fold; a fold's fit is made of the sums of the others.
    """
    binned = rows.withColumn("bin", F.floor(F.col(p) / width).cast("long"))
    own = written(binned.groupBy("fold", "bin").agg(F.sum(y).alias("s"), F.count(y).alias("n")))
    folds, whole = own.select("fold").distinct(), own.groupBy("bin").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    every = folds.crossJoin(whole).join(own, ["fold", "bin"], "left")  # folds x bins, both few
    others = every.select("fold", "bin", (F.col("_s") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"))
    return binned.join(isotonic_bins(written(others), "fold"), ["fold", "bin"], "left").drop("bin")


def score(df: DataFrame, features, models: dict, weights: dict, fill: dict | None = None, log: bool = False) -> DataFrame:
    """df with pm25_pred: the weighted sum of the models that have weight, floored at 0."""
    from .clean import fill_by_precedence

    active = {n: m for n, m in models.items() if weights.get(n, 0.0) > 0}
    ready = fill_by_precedence(df, features, {}, fill or {})
    out = predict(ready, features, active, log)
    total = sum(weights[n] for n in active) or 1.0
    blended = sum((F.col(f"p_{n}") * (weights[n] / total) for n in active), F.lit(0.0))
    return out.withColumn("pm25_pred", F.greatest(F.lit(0.0), blended)).drop(*[f"p_{n}" for n in active])


def save_models(spark, path: str, models: dict, weights: dict, features, fill: dict | None = None, log: bool = False) -> None:
    """Adds a version of a set of fitted models with what scoring needs; it counts once its description is complete."""
    held = _versions(spark, path)
    folder = f"{path}/version={max(held, default=0) + 1:012d}-{uuid.uuid4().hex[:8]}"
    for name, model in models.items():
        model.save(f"{folder}/{name}")
    facts = {"models": {n: type(m).__name__ for n, m in models.items()}, "weights": weights, "features": list(features), "fill": fill or {}, "log": log}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{folder}/about")


def load_models(spark, path: str) -> dict | None:
    """The newest complete set: models, weights, features, fill, log; None if there is none."""
    held = _versions(spark, path, done="about/_SUCCESS")
    if not held:
        return None
    folder = held[max(held)]
    facts = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    kinds = {c.__name__: c for c in (RandomForestRegressionModel, GBTRegressionModel)}
    return facts | {"models": {n: kinds[k].load(f"{folder}/{n}") for n, k in facts["models"].items()}}


def score_with(df: DataFrame, found: dict) -> DataFrame:
    """df with pm25_pred by a loaded set of models."""
    return score(df, found["features"], found["models"], found["weights"], found["fill"], found["log"])


def sensitivity(df: DataFrame, scenarios: DataFrame, predict_expr, key: str = "id") -> DataFrame:
    """(key, spread) of a scoring expression over perturbed inputs."""
    return scenario_std(df, scenarios, predict_expr, key)


def fit_clusters(df: DataFrame, k: int = 8, seed: int = SEED) -> KMeansModel:
    return KMeans(k=k, seed=seed).fit(assemble(df, ["lat", "lon"]))


def cluster_distance(df: DataFrame, model: KMeansModel) -> DataFrame:
    """df with cluster and cluster_dist (in degrees) of the nearest of a fitted model's centres."""
    return centre_distance(df, model.clusterCenters())


def centre_distance(df: DataFrame, centres) -> DataFrame:
    """The same for a few (lat, lon) centres; ties to the first."""
    away = [F.struct(F.sqrt(F.pow(F.col("lat") - float(c[0]), 2) + F.pow(F.col("lon") - float(c[1]), 2)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    best = F.least(*away) if len(away) > 1 else away[0]
    return df.withColumn("_b", best).withColumn("cluster", F.col("_b.i")).withColumn("cluster_dist", F.col("_b.d")).drop("_b")


def metrics_report(parts: dict) -> DataFrame:
    """One row json: sections of one-row metric frames as nested JSON."""
    out = None
    for section, df in parts.items():
        long = df.select(F.lit(section).alias("section"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    sections = out.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return sections.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("m").alias("j")))))).alias("json"))
