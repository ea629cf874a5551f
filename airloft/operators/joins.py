"""Equi-joins of dataset assembly and spatial joins.

Spatial joins within a reach turn into equi-joins on grid cells: one side is
repeated into the cells around its own, and the distance is a filter on what
meets. No pair of far rows is ever formed. Nearest-neighbour joins are such joins
with a reach that widens for the rows that have not found enough, at every size.
"""

from __future__ import annotations

from math import degrees, pi, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox, contains
from ..functions.scalars import KM_RADIUS, MILES_RADIUS, cell_index, haversine_km, haversine_mi
from ..sources.io import written

#: Half of the way round: no two places are farther apart.
FARTHEST_KM = pi * KM_RADIUS * 1.001


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """value of the dimension by key; the default where it has none."""
    out = df.join(dim.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def build_tracts(centroids: DataFrame, ej: DataFrame, population: DataFrame) -> DataFrame:
    return centroids.join(ej, "GEOID", "left").join(population, "GEOID", "left")


def left_coalesce(df: DataFrame, other: DataFrame, on, cols) -> DataFrame:
    """Left join in which the other frame's values win where it has them."""
    on = [on] if isinstance(on, str) else list(on)
    right = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = df.join(right, on, "left")
    own = lambda c: [F.col(c)] if c in df.columns else []
    return out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), *own(c)) for c in cols}).drop(*[f"_new_{c}" for c in cols])


def attach(df: DataFrame, other: DataFrame, on, suffix: str) -> DataFrame:
    """Left join; columns that both have get the suffix on the right."""
    on = [on] if isinstance(on, str) else list(on)
    renamed = other.select(*on, *[F.col(c).alias(c + suffix if c in df.columns else c) for c in other.columns if c not in on])
    return df.join(renamed, on, "left")


def attach_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    return attach(df, weather, ["sensor_id", "date"], "_weather")


def attach_tract(df: DataFrame, tracts: DataFrame) -> DataFrame:
    return attach(df, tracts, "GEOID", "_tract")


def cells_of(df: DataFrame, deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct grid cells of the rows, by integer index."""
    return df.select(cell_index(F.col(lat), deg).alias("cy"), cell_index(F.col(lon), deg).alias("cx")).distinct()


def attach_cell(df: DataFrame, cells: DataFrame, deg: float = 0.5, on=("date",), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Left join of cell values (cy, cx, *on, ...)."""
    keyed = df.withColumn("cy", cell_index(F.col(lat), deg)).withColumn("cx", cell_index(F.col(lon), deg))
    return keyed.join(cells, ["cy", "cx", *on], "left")


def from_cells(df: DataFrame, cells: DataFrame, deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return attach_cell(df, cells, deg, (), lat, lon)


def _across(row: Column, deg: float, reach: float) -> Column:
    """Cells round the globe in a row of cells `deg` high: each as wide as the reach (km) at the latitudes next to the row."""
    edge = F.least((F.greatest(F.abs(row), F.abs(row + 1)) + 1) * deg, F.lit(90.0))
    half = F.least(F.lit(sin(min(pi / 2, reach / KM_RADIUS / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)), F.lit(1.0))
    return F.greatest(F.floor(F.lit(360.0) / (F.degrees(2 * F.asin(half)) * 1.001)), F.lit(1)).cast("int")


def dealt(df: DataFrame, *keys) -> DataFrame:
    """df by hash of the keys over all tasks, also where few bytes would be put into one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once; as a plain column, each filter on it would work it out again for each time it names it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def within(a: DataFrame, b: DataFrame, km: float, on=()) -> DataFrame:
    """Pairs of rows of a and b (each with lat, lon; other names disjoint but for `on`) at most km apart, with their km.

    b goes to the nine cells around its own; a cell spans the reach wherever it
    lies, so the poles and the date line are places like others. Rows without
    a place meet nothing. Straight lines through the globe rule out most pairs
    before any sine. Rows are few and pairs many, so the cells are dealt to all
    tasks, however small the tables.
    """
    deg = min(180.0, degrees(km / KM_RADIUS) * 1.001)
    row = lambda lat: F.floor(F.col(lat) / deg).cast("int")
    column = lambda lon, n: F.least(F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)
    left = a.withColumn("_cy", row("lat"))
    left = left.withColumn("_cx", column("lon", _across(F.col("_cy"), deg, km)))
    other = b.withColumnsRenamed({"lat": "_lat2", "lon": "_lon2"}).withColumn("_ry", row("_lat2"))
    cells = []
    for i in (-1, 0, 1):
        n = _across(F.col("_ry") + i, deg, km)
        cells += [F.struct((F.col("_ry") + i).alias("_cy"), F.pmod(column("_lon2", n) + j, n).alias("_cx")) for j in (-1, 0, 1)]
    right = other.where(F.col("_lat2").isNotNull() & F.col("_lon2").isNotNull()).withColumn("_c", F.explode(F.array_distinct(F.array(*cells)))).drop("_ry")
    right = right.select(*[c for c in right.columns if c != "_c"], "_c._cy", "_c._cx")
    xyz = lambda lat, lon: {"x": F.cos(F.radians(lat)) * F.cos(F.radians(lon)), "y": F.cos(F.radians(lat)) * F.sin(F.radians(lon)), "z": F.sin(F.radians(lat))}
    left = dealt(left.withColumns({f"_{c}1": v for c, v in xyz("lat", "lon").items()}), *on, "_cy", "_cx")
    right = dealt(right.withColumns({f"_{c}2": v for c, v in xyz("_lat2", "_lon2").items()}), *on, "_cy", "_cx")
    chord = sum(((F.col(f"_{c}1") - F.col(f"_{c}2")) * (F.col(f"_{c}1") - F.col(f"_{c}2")) for c in "xyz"), F.lit(0.0))
    most = (2 * sin(min(pi / 2, km / KM_RADIUS / 2))) ** 2 * (1 + 1e-9) + 1e-15
    met = left.join(right, [*on, "_cy", "_cx"]).where(chord <= most).drop(*[f"_{c}{i}" for c in "xyz" for i in (1, 2)])
    return once(met, "km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat2"), F.col("_lon2"))).where(F.col("km") <= km).drop("_cy", "_cx", "_lat2", "_lon2")


def neighbour_stats(pairs: DataFrame, keys, radii, value: str = "_pm") -> DataFrame:
    """Mean and count by radius, and the population deviation within the middle one, in one pass over the pairs."""
    middle = sorted(radii)[len(radii) // 2]
    inside = lambda r: F.when(F.col("km") <= r, F.col(value))
    aggs = []
    for r in radii:
        aggs += [F.avg(inside(r)).alias(f"nbr_pm25_{r}km"), F.count(inside(r)).cast("int").alias(f"nbr_count_{r}km")]
    return pairs.groupBy(*keys).agg(*aggs, F.stddev_pop(inside(middle)).alias(f"nbr_std_{middle}km"))


def loo_day_mean(query: DataFrame, pool: DataFrame) -> DataFrame:
    """query with the same-day mean of the pool without the row's own reading.

    The day's count less one counts as one at least, so a day with a single
    reading gives 0; null only where the pool lacks the day.
    """
    day = pool.groupBy("date").agg(F.sum("pm25").alias("_sum"), F.count("pm25").alias("_cnt"))
    return query.join(day, "date", "left").withColumn("loo_mean", (F.col("_sum") - F.col("pm25")) / F.greatest(F.col("_cnt") - 1, F.lit(1))).drop("_sum", "_cnt")


def fill_neighbors(df: DataFrame, pool_mean: Column, radii=(25, 50, 100)) -> DataFrame:
    """Middle radius from the leave-one-out day mean, then the pool mean; the others from the middle one; counts and deviation 0."""
    middle = sorted(radii)[len(radii) // 2]
    anchor = F.coalesce(F.col(f"nbr_pm25_{middle}km"), F.col("loo_mean"), pool_mean)
    out = df.withColumn(f"nbr_pm25_{middle}km", anchor)
    out = out.withColumns({f"nbr_pm25_{r}km": F.coalesce(f"nbr_pm25_{r}km", f"nbr_pm25_{middle}km") for r in radii if r != middle})
    zeros = {f"nbr_count_{r}km": F.coalesce(F.col(f"nbr_count_{r}km"), F.lit(0)) for r in radii}
    return out.withColumns(zeros | {f"nbr_std_{middle}km": F.coalesce(F.col(f"nbr_std_{middle}km"), F.lit(0.0))})


def neighbor_features(query: DataFrame, pool: DataFrame, radii=(25, 50, 100)) -> DataFrame:
    """query (sensor_id, lat, lon, date, pm25, ...) with statistics of the same day's other sensors by radius."""
    keys = ["sensor_id", "date", "lat", "lon"]
    asked = query.select(*keys).distinct()
    others = pool.select(F.col("sensor_id").alias("_sid"), "date", "lat", "lon", F.col("pm25").alias("_pm"))
    pairs = within(asked, others, max(radii), ("date",)).where("_sid <> sensor_id")
    stats = neighbour_stats(pairs, keys, radii)
    mean = pool.agg(F.avg(F.when(~F.isnan("pm25"), F.col("pm25"))).alias("m")).scalar()
    out = loo_day_mean(query.join(stats, keys, "left"), pool)
    return fill_neighbors(out, F.coalesce(mean, F.lit(0.0)), radii).drop("loo_mean")


def neighbor_features_heldout(df: DataFrame, radii=(25, 50, 100)) -> DataFrame:
    """(fold, sensor_id, date, ...): neighbour statistics of rows near a sensor with that sensor held out.

    Rows without a pair to the held-out sensor keep their statistics. For the
    others its share is taken from the row's sums, so the work grows with the
    pairs within reach. The day means change for all rows and are corrected
    likewise; for rows that are not listed see loo_without. Neighbours'
    readings that are not numbers count as none. The pairs are met three times
    (for means, sums, and what is left) and never shuffled or written.
    """
    keys = ["sensor_id", "date", "lat", "lon"]
    middle = sorted(radii)[len(radii) // 2]
    reading = F.when(~F.isnan("pm25"), F.col("pm25"))
    several = F.count(F.lit(1)).over(Window.partitionBy("sensor_id", "date")) > 1
    others = written(df.select(F.col("sensor_id").alias("_sid"), "date", "lat", "lon", reading.alias("_pm"), F.col("pm25").alias("_held"), several.alias("_many")))
    near = lambda rows, pool: within(rows, pool, max(radii), ("date",)).where("_sid <> sensor_id")
    asked = df.select(*keys).distinct()
    asked = written(asked.join(near(asked, others).groupBy(*keys).agg(F.avg("_pm").alias("_mean")), keys))
    # Deviations from the row's mean keep the sums of squares exact enough to subtract.
    off = F.col("_pm") - F.col("_mean")
    parts = {f"_n{r}": F.when((F.col("km") <= r) & F.col("_pm").isNotNull(), 1).otherwise(0).cast("long") for r in radii}
    parts |= {f"_s{r}": F.when((F.col("km") <= r) & F.col("_pm").isNotNull(), off).otherwise(0.0) for r in radii}
    parts["_q"] = F.when((F.col("km") <= middle) & F.col("_pm").isNotNull(), off * off).otherwise(0.0)
    asked = written(asked.join(near(asked, others).groupBy(*keys).agg(*[F.sum(c).alias(f"{k}_all") for k, c in parts.items()]), keys))
    day = df.groupBy("date").agg(F.sum("pm25").alias("_sum"), F.count("pm25").alias("_cnt"))
    rows = asked.join(df.select(*keys, "pm25"), keys).join(day, "date")
    # A sensor with one reading a day is one pair of a row: what is left is worked out where the pair is met.
    lone = near(rows, others.where("NOT _many").drop("_many")).withColumns(parts)
    mine = near(asked, others.where("_many").drop("_many", "_held")).groupBy(*keys, "_sid").agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    taken = df.select(F.col("sensor_id").alias("_sid"), "date", F.col("pm25").alias("_held"))
    many = mine.join(rows, keys).join(taken, ["_sid", "date"], "left")
    columns = ["_sid", *keys, "pm25", "_mean", "_sum", "_cnt", "_held", *parts, *[f"{k}_all" for k in parts]]
    rest = lone.select(columns).unionByName(many.select(columns)).withColumns({k: F.col(f"{k}_all") - F.col(k) for k in parts})
    stats = {}
    for r in radii:
        stats[f"nbr_pm25_{r}km"] = F.when(F.col(f"_n{r}") > 0, F.col("_mean") + F.col(f"_s{r}") / F.col(f"_n{r}"))
        stats[f"nbr_count_{r}km"] = F.col(f"_n{r}").cast("int")
    n, off = F.col(f"_n{middle}"), F.col(f"_s{middle}") / F.col(f"_n{middle}")
    stats[f"nbr_std_{middle}km"] = F.when(n > 1, F.sqrt(F.greatest(F.col("_q") / n - off * off, F.lit(0.0)))).when(n == 1, 0.0)
    loo = loo_without(F.col("_sum"), F.col("_cnt"), F.col("pm25"), F.col("_held"))
    out = rest.select(F.col("_sid").alias("fold"), *keys, "pm25", *[c.alias(k) for k, c in stats.items()], loo.alias("loo_mean"))
    mean = df.agg(F.avg("pm25").alias("m")).first()["m"]
    return fill_neighbors(out, F.lit(mean).cast("double"), radii).drop("loo_mean")


def fold_sums(df: DataFrame, folds: DataFrame, radii=(25, 50, 100)) -> dict[str, DataFrame]:
    """What the neighbour features of all folds are made of, from one pass over the pairs.

    df: (sensor_id, lat, lon, date, pm25, ...); folds: (sensor_id, fold).
    rows has df with fold and its neighbour sums over all folds; held has the
    same sums (sensor_id, date, out, ...) by the fold `out` of the neighbours;
    days has the sum and count of readings by date and fold. Readings that are
    not numbers count as none. Deviations from the day's mean keep sums of
    squares exact enough to subtract.
    """
    keys, middle = ["sensor_id", "date", "lat", "lon"], sorted(radii)[len(radii) // 2]
    known = df.join(folds.select("sensor_id", "fold"), "sensor_id")
    reading = F.when(~F.isnan("pm25"), F.col("pm25"))
    days = known.groupBy("date", "fold").agg(F.coalesce(F.sum(reading), F.lit(0.0)).alias("_sum"), F.count(reading).alias("_cnt"))
    centre = days.groupBy("date").agg(F.try_divide(F.sum("_sum"), F.sum("_cnt")).alias("_mean"))
    others = known.join(centre, "date").select(F.col("sensor_id").alias("_sid"), "date", "lat", "lon", F.col("fold").alias("out"), (reading - F.col("_mean")).alias("_off"))
    pairs = within(known.select(*keys).distinct(), others, max(radii), ("date",)).where("_sid <> sensor_id")
    inside = lambda r, c: F.when(F.col("km") <= r, c)
    sums = {f"_n{r}": F.count(inside(r, F.col("_off"))) for r in radii} | {f"_s{r}": F.coalesce(F.sum(inside(r, F.col("_off"))), F.lit(0.0)) for r in radii}
    sums["_q"] = F.coalesce(F.sum(inside(middle, F.col("_off") * F.col("_off"))), F.lit(0.0))
    held = written(pairs.groupBy("sensor_id", "date", "out").agg(*[c.alias(k) for k, c in sums.items()]))
    whole = held.groupBy("sensor_id", "date").agg(*[F.sum(k).alias(k) for k in sums])
    rows = known.join(centre, "date", "left").join(whole, ["sensor_id", "date"], "left")
    return {"rows": rows, "held": held, "days": days}


def fold_features(parts: dict[str, DataFrame], fold, radii=(25, 50, 100)) -> DataFrame:
    """df with fold, loo_mean and neighbour features as they are without the readings of the sensors of one fold.

    Rows of the fold itself are what is predicted, the others what is trained
    on; neither sees a reading of the fold but its own target. Only rows near
    the fold change their sums, by those of `held`; the day means of all change.
    """
    middle = sorted(radii)[len(radii) // 2]
    names = [*[f"_n{r}" for r in radii], *[f"_s{r}" for r in radii], "_q"]
    held = parts["held"].where(F.col("out") == fold).select("sensor_id", "date", *[F.col(c).alias(f"{c}_out") for c in names])
    rest = parts["days"].groupBy("date").agg(*[F.coalesce(F.sum(F.when(F.col("fold") != fold, F.col(c))), F.lit(0)).alias(c) for c in ("_sum", "_cnt")])
    pool = parts["days"].where(F.col("fold") != fold).agg(F.try_divide(F.sum("_sum"), F.sum("_cnt"))).scalar()
    out = parts["rows"].drop("loo_mean").join(held, ["sensor_id", "date"], "left").join(rest, "date")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) - F.coalesce(f"{c}_out", F.lit(0)) for c in names})
    n, off = F.col(f"_n{middle}"), F.col(f"_s{middle}") / F.col(f"_n{middle}")
    stats = {f"nbr_pm25_{r}km": F.when(F.col(f"_n{r}") > 0, F.col("_mean") + F.col(f"_s{r}") / F.col(f"_n{r}")) for r in radii}
    stats |= {f"nbr_count_{r}km": F.col(f"_n{r}").cast("int") for r in radii}
    stats[f"nbr_std_{middle}km"] = F.when(n > 1, F.sqrt(F.greatest(F.col("_q") / n - off * off, F.lit(0.0)))).when(n == 1, 0.0)
    own = F.when((F.col("fold") != fold) & ~F.isnan("pm25"), F.col("pm25"))
    loo = (F.col("_sum") - F.coalesce(own, F.lit(0.0))) / F.greatest(F.col("_cnt") - F.when(own.isNotNull(), 1).otherwise(0), F.lit(1))
    out = out.withColumns(stats | {"loo_mean": loo}).drop("_mean", "_sum", "_cnt", *names, *[f"{c}_out" for c in names])
    return fill_neighbors(out, F.coalesce(pool, F.lit(0.0)), radii)


def loo_without(day_sum: Column, day_count: Column, own: Column, held: Column) -> Column:
    """Leave-one-out day mean with another sensor's reading (null: none) taken out too."""
    has = F.when(held.isNotNull(), 1).otherwise(0)
    return (day_sum - F.coalesce(held, F.lit(0.0)) - own) / F.greatest(day_count - has - 1, F.lit(1))


def day_mean_without(rows: DataFrame, held: Column, value: str = "pm25") -> DataFrame:
    """rows with loo_mean: the same-day mean of the rows that are not held out, without the row's own reading if it is one of them.

    Null where a day has no other such row.
    """
    kept = F.when(~held, F.col(value))
    day = rows.groupBy("date").agg(F.sum(kept).alias("_sum"), F.count(kept).alias("_cnt"))
    n = F.col("_cnt") - F.when(kept.isNotNull(), 1).otherwise(0)
    mean = F.when(n > 0, (F.col("_sum") - F.coalesce(kept, F.lit(0.0))) / n)
    return rows.drop("loo_mean").join(day, "date").withColumn("loo_mean", mean).drop("_sum", "_cnt")


def point_neighbors(points: DataFrame, sensors: DataFrame, radii=(25, 50, 100), min_n: int = 20) -> DataFrame:
    """points (id, lat, lon) with statistics of one snapshot of sensors (lat, lon, pm25).

    Empty radii fall back to the mean of all sensors. With fewer than min_n
    sensors the snapshot isn't trusted and no rows come back.
    """
    total = sensors.agg(F.avg("pm25").alias("loo_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n)
    pairs = within(points.select("id", "lat", "lon"), sensors.select("lat", "lon", F.col("pm25").alias("_pm")), max(radii))
    stats = neighbour_stats(pairs, ["id"], radii)
    out = points.join(stats, "id", "left").join(F.broadcast(total), F.lit(True))  # one row
    return fill_neighbors(out, F.lit(None).cast("double"), radii).drop("loo_mean", "_n")


def _first_reach(sources: DataFrame, k: int) -> float:
    """A reach (km) in which an even spread over the box of the sources has some six times k of them."""
    box = sources.agg(F.count("lat").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    if not box["n"]:
        return FARTHEST_KM
    side = degrees(1 / KM_RADIUS)
    area = max((box["t"] - box["s"]) / side, 1.0) * max((box["e"] - box["w"]) / side, 1.0)
    return min(FARTHEST_KM, max(1.0, sqrt(6.0 * k * area / (pi * box["n"]))))


def knn(targets: DataFrame, sources: DataFrame, k: int, max_km: float | None = None, exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """(target columns, source columns, source_id, km, rank): the k nearest sources (id, lat, lon, ...) of each target (id, lat, lon, ...) that are nearer than max_km, if given.

    Targets that have k sources within a reach are done with it; for the
    others the reach is made four times as wide, until it is max_km or the
    whole globe. Each round is written, so the next starts from what is left.
    Ties go to the smaller id; distances that agree in so many decimal digits
    of a km are ties, for places as far away differ by what sines round.
    """
    right = sources.withColumnRenamed("id", "source_id")
    most = FARTHEST_KM if max_km is None else min(float(max_km), FARTHEST_KM)
    reach, left, parts = min(most, _first_reach(sources, k)), targets, []
    far = F.col("km") if digits is None else F.rint(F.col("km") * 10.0**digits)
    best = Window.partitionBy("id").orderBy(far, "source_id")
    while True:
        met = within(left, right, reach)
        if exclude_self:
            met = met.where("source_id <> id")
        ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if reach >= most:
            parts.append(ranked)
            break
        found = written(ranked)
        sure = reach if digits is None else reach - 10.0**-digits  # a tie may lie just beyond the reach
        enough = found.where((F.col("rank") == k) & (F.col("km") <= sure)).select("id")
        parts.append(found.join(enough, "id", "left_semi"))
        left = written(left.join(enough, "id", "left_anti"))
        if left.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).limit(1).count() == 0:
            break
        reach = min(most, reach * 4)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if max_km is None else out.where(F.col("km") < max_km)


def nearest(points: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """points (id, lat, lon, ...) with the key and km of the nearest target (key, lat, lon) at any distance; ties, to nine digits of a km, to the smaller key.

    Both are null for points without a place, or if there is no target.
    """
    found = knn(points.select("id", "lat", "lon"), targets.select(F.col(key).alias("id"), "lat", "lon"), 1, digits=9)
    return points.join(found.select("id", F.col("source_id").alias(key), "km"), "id", "left").select(*points.columns, key, "km")


def assign_missing_key(points: DataFrame, known: DataFrame, targets: DataFrame, key: str = "GEOID") -> DataFrame:
    """Keys from the known table (id, key); nearest target only where that has none."""
    joined = points.drop(key).join(known.select("id", key), "id", "left")
    have = joined.where(F.col(key).isNotNull())
    lack = nearest(joined.where(F.col(key).isNull()).drop(key), targets, key).drop("km")
    return have.unionByName(lack)


def nearest_other(sensors: DataFrame) -> DataFrame:
    """(id, km): distance of each sensor (id, lat, lon) to the nearest other one, null for a lone sensor."""
    rows = sensors.select("id", "lat", "lon")
    return rows.select("id").join(knn(rows, rows, 1, exclude_self=True).select("id", "km"), "id", "left")


def dist_to_set(points: DataFrame, sensors: DataFrame, clip: float | None = 164.4, miles: bool = False) -> DataFrame:
    """points (id, lat, lon, ...) with dist to the nearest of the sensors (lat, lon), clipped; null for points without a place.

    Beyond the clip nothing is searched.
    """
    unit = MILES_RADIUS / KM_RADIUS if miles else 1.0
    places = sensors.select("lat", "lon").distinct().select(F.lit(0).alias("id"), "lat", "lon")
    most = None if clip is None else clip / unit
    found = knn(points.select("id", "lat", "lon"), places, 1, most).select("id", (F.col("km") * unit).alias("dist"))
    out = points.drop("dist").join(found, "id", "left")
    if clip is None:
        return out
    return out.withColumn("dist", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.least(F.coalesce("dist", F.lit(float(clip))), F.lit(float(clip)))))


def pairs(df: DataFrame, miles: float, on=(), carry=()) -> DataFrame:
    """(i, j, dist) of rows (id, lat, lon) with i < j at most `miles` apart, and of equal `on`.

    Carried columns come as <name>_i and <name>_j, so what is made of a pair
    needs no join: pairs are never shuffled.
    """
    km = miles * KM_RADIUS / MILES_RADIUS * 1.001
    left = df.select(*on, F.col("id").alias("i"), "lat", "lon", F.col("lat").alias("_a"), F.col("lon").alias("_o"), *[F.col(c).alias(f"{c}_i") for c in carry])
    right = df.select(*on, F.col("id").alias("j"), "lat", "lon", F.col("lat").alias("_b"), F.col("lon").alias("_p"), *[F.col(c).alias(f"{c}_j") for c in carry])
    met = within(left, right, km, on).where("i < j")
    far = once(met, "dist", haversine_mi(F.col("_a"), F.col("_o"), F.col("_b"), F.col("_p"))).where(F.col("dist") <= miles)
    return far.select(*on, "i", "j", "dist", *[f"{c}_{x}" for c in carry for x in "ij"])


def cell_or_nearest(points: DataFrame, cells: DataFrame, default: float, deg: float = 1.0) -> DataFrame:
    """points with the value of their cell (cy, cx, value), else of the nearest cell in squared degrees, else the default.

    Places without a cell meet the cells in squares of degrees, which widen
    for those that have found none.
    """
    keyed = points.drop("value").withColumn("cy", cell_index(F.col("lat"), deg)).withColumn("cx", cell_index(F.col("lon"), deg))
    joined = keyed.join(cells.select("cy", "cx", "value"), ["cy", "cx"], "left").drop("cy", "cx")
    left = written(joined.where(F.col("value").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct())
    targets = cells.where(F.col("value").isNotNull()).select((F.col("cy") * deg).alias("_y"), (F.col("cx") * deg).alias("_x"), "cy", "cx", F.col("value").alias("_v"))
    reach, found = 4 * deg, None
    while left.limit(1).count():
        square = lambda y, x: (F.floor(y / reach).cast("int"), F.floor(x / reach).cast("int"))  # noqa: E731,B023
        ty, tx = square(F.col("_y"), F.col("_x"))
        near = F.explode(F.array(*[F.struct((ty + i).alias("_sy"), (tx + j).alias("_sx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        py, px = square(F.col("lat"), F.col("lon"))
        met = left.withColumn("_sy", py).withColumn("_sx", px).join(targets.select("*", near.alias("_s")).select("*", "_s._sy", "_s._sx"), ["_sy", "_sx"])
        met = met.withColumn("_d", F.pow(F.col("_y") - F.col("lat"), 2) + F.pow(F.col("_x") - F.col("lon"), 2)).where(F.col("_d") <= reach * reach)
        part = written(met.groupBy("lat", "lon").agg(F.min(F.struct("_d", "cy", "cx", "_v")).alias("_b")).select("lat", "lon", F.col("_b._v").alias("_v")))
        found = part if found is None else found.unionByName(part)
        left = written(left.join(part.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        if reach > 800:
            break
        reach *= 4
    if found is None:
        return joined.withColumn("value", F.coalesce("value", F.lit(default)))
    return joined.join(found, ["lat", "lon"], "left").withColumn("value", F.coalesce("value", "_v", F.lit(default))).drop("_v")


#: Side (degrees) of the coarsest cells of a polygon cover, how often they are halved at most, and edges that a point is tested against at most above the last level.
COARSE, HALVINGS, EDGES = 4.0, 8, 16
#: Degrees by which a cell is widened when edges are sought: what rounding moves across its border is found in it.
SLACK = 1e-9


def polygon_cover(polygons: DataFrame, coarse: float = COARSE, halvings: int = HALVINGS, cuts: int = 1) -> DataFrame:
    """polygons (rings, ...) as the cells that cover them: (..., _level, _py, _px, _edges) without rings.

    A polygon starts in a few cells about as large as its box. A cell that no
    edge touches lies wholly inside (_edges is null: its points need no test) or
    outside (it is left out). Others are cut in four `cuts` times, and again while
    they have many edges; then they keep the edges that a ray from inside the cell
    can meet. So a polygon costs its outline in small cells and its area in large
    ones, whatever its size. Rounds of cutting are written.
    """
    segments = F.flatten(F.transform("rings", lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.array(ring[i], ring[i + 1]))))
    keep, edges = [c for c in polygons.columns if c != "rings"], "array<array<array<double>>>"
    size = F.greatest(F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin"), F.lit(1e-9))
    first = F.least(F.greatest(F.ceil(F.log2(coarse / size)), F.lit(0)), F.lit(halvings)).cast("int")
    sides = F.array(*[F.lit(coarse / 2**i) for i in range(halvings + 1)])
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(f"_box.{lo}") - SLACK) / F.col("_side")).cast("int"), F.floor((F.col(f"_box.{hi}") + SLACK) / F.col("_side")).cast("int")))
    spread = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = polygons.where(F.size("rings") > 0).repartition(spread).select(*keep, segments.cast(edges).alias("_edges"), bbox(F.col("rings")).alias("_box")).withColumn("_level", first).withColumn("_side", F.get(sides, F.col("_level")))
    cells = cells.withColumn("_py", span("ymin", "ymax")).withColumn("_px", span("xmin", "xmax")).select(*keep, "_edges", "_level", "_py", "_px", F.lit(0).alias("_cuts"))
    y, x, side = F.col("_y"), F.col("_x"), F.col("_side")
    # A ray to the right of a point of the cell meets only edges that reach its rows and lie not wholly to its left.
    near = F.filter("_edges", lambda e: (F.least(e[0][1], e[1][1]) <= y + side) & (F.greatest(e[0][1], e[1][1]) >= y) & (F.greatest(e[0][0], e[1][0]) >= x))
    quarter = F.explode(F.array(*[F.struct((F.col("_py") * 2 + i).alias("_py"), (F.col("_px") * 2 + j).alias("_px")) for i in (0, 1) for j in (0, 1)]))
    found = [*keep, "_level", "_py", "_px", "_edges"]
    out = None
    while True:
        wide = F.get(sides, F.col("_level"))
        placed = cells.withColumns({"_side": wide + 2 * SLACK, "_y": F.col("_py") * wide - SLACK, "_x": F.col("_px") * wide - SLACK})
        kept = placed.withColumn("_edges", near).withColumn("_hit", F.exists("_edges", lambda e: _touches(e, x, y, side)))
        inside = F.when(~F.col("_hit"), contains(F.col("_edges"), x + side / 2, y + side / 2))
        done = ~F.col("_hit") | (F.col("_level") >= halvings) | ((F.col("_cuts") >= cuts) & (F.size("_edges") <= EDGES))
        judged = kept.withColumn("_in", inside).withColumn("_done", done)
        # An array of one row or none: as a filter, the conditions would be worked out a second time.
        one = F.explode(F.when(F.col("_hit") | F.col("_in"), F.array(F.struct(*found, "_cuts", "_hit", "_done"))))
        split = written(judged.select(one.alias("_c")).select("_c.*"))
        part = split.where("_done").withColumn("_edges", F.when(F.col("_hit"), F.col("_edges"))).select(found)
        out = part if out is None else out.unionByName(part)
        rest = split.where("NOT _done")
        if rest.limit(1).count() == 0:
            return out
        cells = rest.select(*keep, "_edges", (F.col("_level") + 1).alias("_level"), (F.col("_cuts") + 1).alias("_cuts"), quarter.alias("_q")).select(*keep, "_edges", "_level", "_q._py", "_q._px", "_cuts")


def _touches(e: Column, x: Column, y: Column, side: Column) -> Column:
    """Whether an edge may meet the closed square at (x, y): their boxes do, and not all corners lie on one side of its line."""
    a, b = e[0], e[1]
    apart = (F.greatest(a[0], b[0]) < x) | (F.least(a[0], b[0]) > x + side) | (F.greatest(a[1], b[1]) < y) | (F.least(a[1], b[1]) > y + side)
    corners = [(b[0] - a[0]) * (y + j * side - a[1]) - (b[1] - a[1]) * (x + i * side - a[0]) for i in (0, 1) for j in (0, 1)]
    return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _levels(cover: DataFrame) -> list[int]:
    return sorted(r[0] for r in cover.select("_level").distinct().collect())  # at most halvings + 1


def _at_levels(points: DataFrame, levels, coarse: float) -> DataFrame:
    """points with _level, _py, _px: a row for the cell of each level."""
    at = [F.struct(F.lit(i).alias("_level"), F.floor(F.col("lat") / (coarse / 2**i)).cast("int").alias("_py"), F.floor(F.col("lon") / (coarse / 2**i)).cast("int").alias("_px")) for i in levels]
    return points.withColumn("_c", F.explode(F.array(*at))).select(*points.columns, "_c.*")


def _held(boundary: bool, rule: Column | None) -> Column:
    return contains(F.col("_edges"), F.col("lon"), F.col("lat"), boundary) if rule is None else rule


def in_polygons(points: DataFrame, polygons: DataFrame, on=(), boundary: bool = False, coarse: float = COARSE, halvings: int = HALVINGS, rule: Column | None = None) -> DataFrame:
    """Pairs of points (lat, lon, ...) and polygons (rings, ...; other names disjoint but for `on`) that contain them, without rings.

    A point looks up its cell of each level; only in cells on an outline do
    edges decide. Points on an edge count as `boundary` says. The corners of a
    shape given by a formula are rounded, so points on its edge may come to lie on
    either side; its formula, a condition on the columns of both, is the `rule`
    that decides in place of the edges.
    """
    cover = polygon_cover(polygons, coarse, halvings)
    levels = _levels(cover)
    if not levels:
        return points.join(polygons.drop("rings"), list(on)).limit(0) if on else points.crossJoin(polygons.drop("rings")).limit(0)
    met = _at_levels(points, levels, coarse).join(cover, [*on, "_level", "_py", "_px"])
    return met.where(F.col("_edges").isNull() | _held(boundary, rule)).drop("_level", "_py", "_px", "_edges")


def count_in_polygons(points: DataFrame, polygons: DataFrame, key: str, boundary: bool = False, coarse: float = COARSE, halvings: int = HALVINGS, rule: Column | None = None) -> DataFrame:
    """(key, n): points (lat, lon) in each polygon (key, rings, ...) that has any.

    Pairs are formed only on outlines, which are cut finer for it, and of
    different places; a cell wholly inside adds the number of its points.
    """
    places = written(points.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n")))
    cover = polygon_cover(polygons, coarse, halvings, cuts=3)
    cells = ["_level", "_py", "_px"]
    at = _at_levels(places, _levels(cover) or [0], coarse)
    whole = cover.where(F.col("_edges").isNull()).select(key, *cells).join(at.groupBy(*cells).agg(F.sum("_n").alias("_n")), cells)
    outline = cover.where(F.col("_edges").isNotNull())
    edge = dealt(at, *cells).join(dealt(outline.drop("_edges") if rule is not None else outline, *cells), cells).where(_held(boundary, rule))
    return whole.select(key, "_n").unionByName(edge.select(key, "_n")).groupBy(key).agg(F.sum("_n").alias("n"))


def highest_in_polygons(points: DataFrame, polygons: DataFrame, on=(), boundary: bool = False, coarse: float = COARSE, rule: Column | None = None) -> DataFrame:
    """(*on, lat, lon, tier) of the different places of points (*on, lat, lon) in any polygon (*on, tier, rings, ...): the highest tier of those that contain it.

    Cells wholly inside are one row each with the highest tier there, and an
    outline is followed only where no such cell around it has its tier, so
    polygons upon polygons are not met one by one.
    """
    cells = [*on, "_level", "_py", "_px"]
    places = points.select(*on, "lat", "lon").distinct()
    cover = polygon_cover(polygons, coarse)
    whole = written(cover.where(F.col("_edges").isNull()).groupBy(*cells).agg(F.max("tier").alias("_top")))
    outline = cover.where(F.col("_edges").isNotNull())
    at_edge = outline.select(*cells).distinct().withColumn("_up", F.explode(F.sequence(F.lit(0), F.col("_level"))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_up"))).cast("int")
    around = whole.withColumnsRenamed({"_level": "_l", "_py": "_y", "_px": "_x"})
    above = at_edge.select(*cells, (F.col("_level") - F.col("_up")).alias("_l"), up("_py").alias("_y"), up("_px").alias("_x")).join(around, [*on, "_l", "_y", "_x"])
    outline = outline.join(above.groupBy(*cells).agg(F.max("_top").alias("_top")), cells, "left").where(F.col("_top").isNull() | (F.col("tier") > F.col("_top"))).drop("_top")
    at = _at_levels(places, _levels(cover) or [0], coarse)
    edge = dealt(at, *cells).join(dealt(outline.drop("_edges") if rule is not None else outline, *cells), cells).where(_held(boundary, rule))
    found = at.join(whole.withColumnRenamed("_top", "tier"), cells).select(*on, "lat", "lon", "tier").unionByName(edge.select(*on, "lat", "lon", "tier"))
    return found.groupBy(*on, "lat", "lon").agg(F.max("tier").alias("tier"))


def smoke_tier(points: DataFrame, polygons: DataFrame, deg: float = COARSE, boundary: bool = False, rule: Column | None = None) -> DataFrame:
    """points (id, date, lat, lon) with the highest tier of the day's polygons (date, tier, rings) that contain them, else 0; rule: see in_polygons."""
    hit = highest_in_polygons(points, polygons if rule is not None else polygons.select("date", "tier", "rings"), ("date",), boundary, deg, rule)
    return points.join(hit, ["date", "lat", "lon"], "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def entity_day_tier(sensors: DataFrame, polygons: DataFrame, deg: float = COARSE, rule: Column | None = None) -> DataFrame:
    """Sparse (id, date, tier > 0) of sensors (id, lat, lon) on the days of the polygons; rule: see in_polygons.

    Sensors meet the polygons of all days by cell; days without a hit are never formed.
    """
    met = in_polygons(sensors.select("id", "lat", "lon"), polygons if rule is not None else polygons.select("date", "tier", "rings"), coarse=deg, rule=rule)
    return met.groupBy("id", "date").agg(F.max("tier").alias("tier")).where("tier > 0")


def inside_any(points: DataFrame, polygons: DataFrame, boundary: bool = True, deg: float = COARSE, rule: Column | None = None) -> DataFrame:
    """points (id, lat, lon) with in_tx: does any polygon contain them or, with boundary, touch them; rule: see in_polygons."""
    met = in_polygons(points.select("id", "lat", "lon"), polygons if rule is not None else polygons.select("rings"), (), boundary, deg, rule=rule)
    hit = met.select("id").distinct().withColumn("in_tx", F.lit(True))
    return points.join(hit, "id", "left").withColumn("in_tx", F.coalesce("in_tx", F.lit(False)))
