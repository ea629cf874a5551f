"""Polygons as array<array<array<double>>>: rings of [x, y] points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_values(rings: Column, axis: int) -> Column:
    """All x (0) or y (1) of all rings."""
    return F.flatten(F.transform(rings, lambda ring: F.transform(ring, lambda p: p[axis])))


def bbox(rings: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax)."""
    x, y = ring_values(rings, 0), ring_values(rings, 1)
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def box_overlaps(box: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return (box["xmax"] >= xmin) & (box["xmin"] <= xmax) & (box["ymax"] >= ymin) & (box["ymin"] <= ymax)


def clean_rings(rings: Column) -> Column:
    """Rings of three points or more, closed; null where none is left."""
    long_enough = F.filter(rings, lambda r: F.size(r) >= 3)
    closed = F.transform(long_enough, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    return F.when(F.size(closed) > 0, closed)


def contains(rings: Column, x: Column, y: Column, boundary: bool = False) -> Column:
    """Even-odd test over all (closed) rings; points on an edge count as `boundary` says."""

    def edge(ring: Column, i: Column) -> Column:
        a, b = ring[i], ring[i + 1]
        cross = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
        within = x.between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & y.between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))
        crossed = ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
        return F.struct(F.coalesce(crossed, F.lit(False)).cast("int").alias("crossed"), ((cross == 0) & within).alias("on"))

    edges = F.flatten(F.transform(rings, lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: edge(ring, i))))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("on"))
    seen = F.aggregate(edges, start, lambda acc, e: F.struct((acc["n"] + e["crossed"]).alias("n"), (acc["on"] | e["on"]).alias("on")))
    return F.when(seen["on"], F.lit(boundary)).otherwise(seen["n"] % 2 == 1)


def simplify_ring(ring: Column, tol: float = 0.0008) -> Column:
    """Drops inner points within tol of the last kept one; a ring that would fall under four points stays."""
    none = F.slice(ring, 1, 1)

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.sqrt(F.pow(p[0] - last[0], 2) + F.pow(p[1] - last[1], 2)) > tol
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    inner = F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0))), none, step)
    out = F.concat(inner, F.slice(ring, -1, 1))
    return F.when((F.size(ring) <= 4) | (F.size(out) < 4), ring).otherwise(out)


def round_ring(ring: Column, digits: int = 5) -> Column:
    return F.transform(ring, lambda p: F.array(F.bround(p[0], digits), F.bround(p[1], digits)))


def simplify_features(df: DataFrame, tol: float = 0.0008, digits: int = 5) -> DataFrame:
    """Rings of every feature simplified and rounded; other columns stay."""
    return df.withColumn("rings", F.transform("rings", lambda r: round_ring(simplify_ring(r, tol), digits)))


def vertex_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r))


def vertex_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: vertices before and after, and the share removed in percent."""
    a = before.agg(F.sum(vertex_count(F.col("rings"))).alias("before"))
    b = after.agg(F.sum(vertex_count(F.col("rings"))).alias("after"))
    removed = 100.0 * (1 - F.col("after") / F.col("before"))
    return a.crossJoin(b).withColumn("removed_pct", removed)  # one row each


def bounds(polygons: DataFrame) -> DataFrame:
    """One row: the box around all polygons."""
    box = bbox(F.col("rings"))
    return polygons.select(box.alias("b")).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))
