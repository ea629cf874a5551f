"""Window-style operators, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KM_RADIUS, MILES_RADIUS, haversine_mi, null_nan
from ..sources.io import written
from .quantiles import quantiles


def robust_z(df: DataFrame, key: str, col: str, z: float = 20.0) -> DataFrame:
    """Rows whose distance to the key's median is below z robust deviations.

    A deviation of 0 counts as the median over rows of the positive ones, or
    as 1 if there is none. Two grouped medians are joined back, so no task
    holds a sensor's rows.
    """
    from .aggregates import mad_by

    stats = mad_by(df.withColumn(col, null_nan(F.col(col))), key, col)
    joined = df.join(stats, key)
    spare = quantiles(joined.where("mad > 0"), {"m": (F.col("mad"), 0.5)}).first()["m"]
    mad = F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0 if spare is None else spare)
    return joined.where(F.abs(F.col(col) - F.col("med")) / (1.4826 * mad) < z).drop("med", "mad")


def min_rows(df: DataFrame, key: str, n: int = 60) -> DataFrame:
    """Rows of keys that have n rows or more."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(enough, key, "left_semi")


def top_per_cell(df: DataFrame, score: str, cells: int = 20, id_col: str = "id") -> DataFrame:
    """The row of highest score in each cell of a cells x cells grid over the box of all rows; ties to the smaller id."""
    box = df.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    bin_ = lambda x, lo, hi: F.least(F.greatest(((x - lo) / F.greatest(hi - lo, F.lit(0.01)) * cells).cast("int"), F.lit(0)), F.lit(cells - 1))
    keyed = df.join(F.broadcast(box), F.lit(True)).withColumn("cell", bin_(F.col("lat"), F.col("s"), F.col("n")) * cells + bin_(F.col("lon"), F.col("w"), F.col("e"))).drop("s", "n", "w", "e")
    best = Window.partitionBy("cell").orderBy(F.desc(score), id_col)
    return keyed.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def in_order(df: DataFrame, order, cost: str | None = None) -> DataFrame:
    """df with _rank (1, 2, ...) and, of a cost, its _running sum in an order without ties.

    Rows are dealt to ranges of the order and written; a range's rows and cost
    shift what is counted within the next ones, so no task holds all rows.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    value = F.col(cost) if cost else F.lit(0)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_c")])
    inside = Window.partitionBy("_part").orderBy(*order)
    running = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_c")
    out = dealt.join(F.broadcast(starts), "_part").withColumn("_rank", F.row_number().over(inside) + F.col("_n")).withColumn("_running", running)
    return out.drop("_part", "_n", "_c", *([] if cost else ["_running"]))


def add_rank(df: DataFrame, order) -> DataFrame:
    """rank 1, 2, ... in an order without ties."""
    return in_order(df, order).withColumn("rank", F.col("_rank").cast("int")).drop("_rank")


def date_chunks(df: DataFrame, start: str, end: str, days: int = 720) -> DataFrame:
    """Half-open windows (chunk_start, chunk_end) of at most `days` days that cover start to end."""
    first = F.explode(F.expr(f"CASE WHEN {start} < {end} THEN sequence(CAST({start} AS date), date_sub({end}, 1), INTERVAL {days} DAYS) END"))
    return df.withColumn("chunk_start", first).withColumn("chunk_end", F.least(F.date_add("chunk_start", days), F.col(end).cast("date")))


def within_budget(df: DataFrame, order, cost: str, budget: float, reserve: float = 5000) -> DataFrame:
    """Items, in an order without ties, while the running cost and the reserve fit the budget."""
    out = in_order(df, order, cost).withColumn("running", F.col("_running")).drop("_rank", "_running")
    return out.where(F.col("running") + reserve <= budget)


def tail_holdout(df: DataFrame, order, frac: float = 0.1, cap: int = 50_000) -> DataFrame:
    """df with holdout: the last rows in order (column names), a fraction of all and at most cap of them.

    The boundary is found by a bounded top-k, not by ordering all rows in one task.
    """
    n = df.count()
    k = min(cap, int(n * frac))
    if not k:
        return df.withColumn("holdout", F.lit(False))
    names = list(order)
    last = df.orderBy(*[F.desc(c) for c in names]).limit(k).agg(F.min(F.struct(*names)).alias("b")).scalar()
    return df.withColumn("holdout", F.struct(*names) >= last)


def group_folds(df: DataFrame, key: str, n: int = 5, most: int = 5000) -> DataFrame:
    """(key, fold): whole groups, largest first (ties by key), each to the lightest fold (ties to the first).

    Groups of one size are dealt by level: a fold of load l takes one of them at
    loads l, l + size, ..., so in the order of these loads folds take turns, and
    one more joins in where the lightest have come up to it. The driver holds the
    number of groups of each size, `most` sizes at a time, and at most n turns a
    size; each group finds its fold by its place in the order of all groups.
    """
    spark = df.sparkSession
    counts = in_order(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc(key)])
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    load, rank, turns, below = [0] * n, 1, [], None
    while True:
        part = (sizes if below is None else sizes.where(F.col("n") < below)).orderBy(F.desc("n")).limit(most).collect()
        for r in part:
            rows, load = _turns(load, r["n"], r["m"])
            for start, folds in rows:
                turns.append((r["n"], rank + start, folds))
            rank += r["m"]
        if len(part) < most:
            break
        below = part[-1]["n"]
    table = spark.createDataFrame(turns, "n long, _from long, _folds array<int>").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("_from", "_folds"))).alias("_turns"))
    turn = F.element_at(F.filter("_turns", lambda t: t["_from"] <= F.col("_rank")), -1)  # the last that has begun
    dealt = counts.join(F.broadcast(table), "n").withColumn("_t", turn)
    return dealt.select(key, F.get("_t._folds", ((F.col("_rank") - F.col("_t._from")) % F.size("_t._folds")).cast("int")).alias("fold"))


def _turns(load: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Turns (first item, folds in order) in which `count` items of one size go to the lightest fold each, and the loads after."""
    load, out, done = list(load), [], 0
    level = min(x // size for x in load)
    while done < count:
        now = sorted((x % size, f) for f, x in enumerate(load) if x // size == level)
        folds = [f for _, f in now]
        higher = [x // size for x in load if x // size > level]
        rounds = min(higher) - level if higher else -(-(count - done) // len(folds))
        taken = min(count - done, rounds * len(folds))
        out.append((done, folds))
        for i, f in enumerate(folds):
            load[f] += size * (taken // len(folds) + (i < taken % len(folds)))
        done, level = done + taken, level + rounds
    return out, load


def scenario_std(df: DataFrame, scenarios: DataFrame, score, key: str = "id") -> DataFrame:
    """(key, spread): population deviation of a row's scores over a few scenarios; score maps the joined columns to a Column."""
    met = df.crossJoin(F.broadcast(scenarios))  # a handful of scenarios
    return met.groupBy(key).agg(F.stddev_pop(score).alias("spread"))


def pull_order(sensors: DataFrame, known: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Sensors not yet known first, then the oldest."""
    from .clean import flag_present

    return flag_present(sensors, known, key, "is_known").orderBy("is_known", "date_created", key)


def top_strategies(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy(F.desc("r2"), "name").limit(n)


def sample_outside(df: DataFrame, n: int = 30, order=("sensor_id",)) -> DataFrame:
    return df.where("NOT in_tx").orderBy(*order).limit(n)


def choose_best(candidates: DataFrame, prefer: str, tol: float = 0.001) -> DataFrame:
    """The candidate (name, r2) of highest r2, or the preferred one if it is within tol."""
    best = candidates.agg(F.max("r2").alias("m")).scalar()
    near = (F.col("name") == prefer) & (best - F.col("r2") < tol)
    return candidates.orderBy(F.desc(near), F.desc("r2"), "name").limit(1)


def spaced_top_k(df: DataFrame, score: str, k: int = 25, miles: float = 8.0, kept=()) -> DataFrame:
    """Up to k rows by score, each at least `miles` from those before it and from `kept` (lat, lon) pairs; ties to the smaller id.

    What greedy picks among the best m rows are its first picks among all, so m
    grows until it holds k of them. Near pairs of the m rows are joined once; then in
    each round every row with no better undecided row near it is picked and the
    rows near it go, wherever they lie, so the rounds are few and k may be large.
    """
    from .joins import pairs, within

    spark, order, most = df.sparkSession, [F.desc(score), F.asc("id")], max(4 * k, 64)
    left = df.where(F.col(score).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if kept:
        taken = spark.createDataFrame([(float(a), float(b), float(a), float(b)) for a, b in kept], "lat double, lon double, _a double, _b double")
        met = within(left.select("id", "lat", "lon", F.col("lat").alias("_p"), F.col("lon").alias("_q")), taken, miles * KM_RADIUS / MILES_RADIUS * 1.001)
        left = left.join(met.where(haversine_mi(F.col("_p"), F.col("_q"), F.col("_a"), F.col("_b")) < miles).select("id"), "id", "left_anti")
    left = written(left)
    total = left.count()
    while True:
        best = written(left.orderBy(*order).limit(most))
        near = pairs(best.select("id", "lat", "lon"), miles).where(F.col("dist") < miles)
        first = best.select(F.col("id").alias("i"), F.col(score).alias("_s")), best.select(F.col("id").alias("j"), F.col(score).alias("_t"))
        ahead = (F.col("_s") > F.col("_t")) | ((F.col("_s") == F.col("_t")) & (F.col("i") < F.col("j")))
        pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
        edges = written(near.join(first[0], "i").join(first[1], "j").select(pick("i", "j").alias("up"), pick("j", "i").alias("down")))
        picked = written(_first_apart(best.select("id"), edges))
        if most >= total or picked.count() >= k:
            break
        most *= 4
    chosen = best.join(picked, "id", "left_semi").select(df.columns).orderBy(*order).limit(k)
    return chosen.withColumn("pick", F.row_number().over(Window.orderBy(*order)))  # k rows


def _first_apart(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of rows that greedy picks, of edges (up, down) between near rows, the better one up."""
    undecided, picked = rows, None
    while undecided.limit(1).count():
        ids = undecided.select("id")
        alive = edges.join(ids.withColumnRenamed("id", "up"), "up", "left_semi").join(ids.withColumnRenamed("id", "down"), "down", "left_semi")
        now = written(ids.join(alive.select(F.col("down").alias("id")).distinct(), "id", "left_anti"))
        gone = alive.join(now.withColumnRenamed("id", "up"), "up", "left_semi").select(F.col("down").alias("id")).distinct()
        undecided = written(ids.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        picked = now if picked is None else picked.unionByName(now)
    return rows.limit(0) if picked is None else picked
