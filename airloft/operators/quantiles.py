"""Exact order statistics of columns of any size, for all rows or by group.

No task ever holds the values of a column. Sketches that merge on the map side
give two pivots around each wanted rank; one pass counts the rows below, at, between
and above them, and sketches what lies between for the next pass. Each pass leaves some
sixtieth of the rows in question, so a few passes leave so few that they are
sorted in place. Ranks are exact; only the choice of pivots is approximate.
"""

from __future__ import annotations

from math import isnan
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import null_nan
from ..sources.io import written

#: Values of a group that one task may sort.
IN_PLACE = 200_000
#: Ranges that a sketch cuts the rows in question into, and its relative precision.
RANGES, PRECISION = 128, 2000


def quantiles(df: DataFrame, targets: dict, by=(), in_place: int = IN_PLACE) -> DataFrame:
    """(by columns, a column a target): targets map a name to (column, share), as in {"p25": (F.col("x"), 0.25)}.

    Exact and linearly interpolated between neighbouring values. Nulls and NaN
    are skipped; null where there is no value. One row without `by`, also for
    an empty table.
    """
    by = [by] if isinstance(by, str) else list(by)
    names, columns = list(targets), {}
    for name in names:
        columns.setdefault(str(targets[name][0]), f"_x{len(columns)}")
    source = {c: targets[n][0] for n in names for c in [columns[str(targets[n][0])]]}
    of = {n: columns[str(targets[n][0])] for n in names}
    base = df.select(*by, *[null_nan(c.cast("double")).alias(x) for x, c in source.items()])
    most = base.groupBy(*by).agg(F.greatest(F.lit(0).cast("long"), *[F.count(x) for x in source]).alias("_n"))
    direct = lambda rows: rows.groupBy(*by).agg(*[F.percentile(of[n], F.lit(float(targets[n][1]))).alias(n) for n in names])
    sizes = written(most)
    large = sizes.where(F.col("_n") > in_place)
    if large.limit(1).count() == 0:
        return direct(base)
    base = written(base)
    if not by:
        return _select(base, targets, of, [], in_place)
    few = _small(written(large.select(*by)), 1)
    rest = base.join(few, by, "left_semi")
    return direct(base.join(few, by, "left_anti")).unionByName(_select(rest, targets, of, by, in_place))


def _select(base: DataFrame, targets: dict, of: dict, by: list[str], in_place: int) -> DataFrame:
    """Quantiles of groups by counting ranges. base is written: each pass reads it again.

    The state of a group has arrays with an entry a target: the open interval
    (a, b) that holds its lower rank, the place k of that rank and the number n
    of values inside, pivots p and q, and v once the value is found.
    """
    names, key = list(targets), by or ["_all"]
    rows = base if by else base.withColumn("_all", F.lit(0))
    x = [F.col(of[n]) for n in names]
    grid = F.array(*[F.lit(i / RANGES) for i in range(RANGES + 1)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in key)
    form = f"{kinds}, a array<double>, b array<double>, k array<long>, n array<long>, p array<double>, q array<double>, v array<double>"
    shares = [float(targets[n][1]) for n in names]

    def first(batches):
        for rows in batches:
            out = [_Range.of_all(n, s, g) for row in zip(rows["n"], rows["s"]) for n, s, g in zip(row[0], shares, row[1])]
            yield _frame(rows[key], out, len(shares))

    def narrowed(batches):
        for rows in batches:
            out = [_Range(*st).narrowed(c, g, in_place) for row in zip(*[rows[c] for c in ("a", "b", "k", "n", "p", "q", "v", "counts", "grids")]) for *st, c, g in zip(*row)]
            yield _frame(rows[key], out, len(shares))

    seen = rows.groupBy(*key).agg(F.array(*[F.count(c) for c in x]).alias("n"), F.array(*[F.percentile_approx(c, grid, PRECISION) for c in x]).alias("s"))
    state = written(seen.mapInPandas(first, form))
    while state.where(F.exists("n", lambda n: n > in_place)).limit(1).count():
        counts, grids = [], []
        for i, c in enumerate(x):
            a, b, p, q = (F.get(f, F.lit(i)) for f in ("a", "b", "p", "q"))
            inside = c.isNotNull() & (F.get("n", F.lit(i)) > in_place) & F.coalesce(c > a, F.lit(True)) & F.coalesce(c < b, F.lit(True))
            between = inside & F.coalesce(c > p, F.lit(True)) & F.coalesce(c < q, F.lit(True))
            parts = (inside & (c < p), inside & (c == p), between, inside & (c == q) & (q > p))
            counts.append(F.array(*[F.count_if(part) for part in parts]))
            grids.append(F.percentile_approx(F.when(between, c), grid, PRECISION))
        met = rows.join(_small(state, len(names)), key).groupBy(*key).agg(F.array(*counts).alias("counts"), F.array(*grids).alias("grids"))
        state = written(state.join(met, key).mapInPandas(narrowed, form))
    inside = lambda i, c: F.get("v", F.lit(i)).isNull() & F.coalesce(c > F.get("a", F.lit(i)), F.lit(True)) & F.coalesce(c < F.get("b", F.lit(i)), F.lit(True))
    held = rows.join(_small(state, len(names)), key).groupBy(*key).agg(*[F.sort_array(F.collect_list(F.when(inside(i, c), c))).alias(f"h{i}") for i, c in enumerate(x)])
    lower = lambda i: F.coalesce(F.get("v", F.lit(i)), F.get(f"h{i}", F.get("k", F.lit(i)).cast("int")))
    found = written(state.join(held, key).select(*key, *[lower(i).alias(f"v{i}") for i in range(len(names))]))
    # The upper rank is at the same value or at the next one.
    last = [a for i, c in enumerate(x) for a in (F.count(c).alias(f"n{i}"), F.count_if(c <= F.col(f"v{i}")).alias(f"c{i}"), F.min(F.when(c > F.col(f"v{i}"), c)).alias(f"w{i}"), F.first(f"v{i}").alias(f"v{i}"))]
    out = rows.join(_small(found, len(names)), key).groupBy(*key).agg(*last)

    def value(i: int) -> Column:
        place = (F.col(f"n{i}") - 1) * shares[i]
        upper = F.when(F.floor(place) + 1 < F.col(f"c{i}"), F.col(f"v{i}")).otherwise(F.coalesce(f"w{i}", f"v{i}"))
        share = place - F.floor(place)
        return F.when(share > 0, F.col(f"v{i}") * (1 - share) + upper * share).otherwise(F.col(f"v{i}"))

    return out.select(*by, *[value(i).alias(n) for i, n in enumerate(names)])


class _Range(NamedTuple):
    a: float | None
    b: float | None
    k: int
    n: int
    p: float | None
    q: float | None
    v: float | None

    @classmethod
    def of_all(cls, n: int, share: float, grid) -> _Range:
        return cls(None, None, int((n - 1) * share) if n else 0, n, None, None, None).with_pivots(grid)

    def with_pivots(self, grid) -> _Range:
        """Pivots are the sketched values a range before and after the one that holds place k."""
        if grid is None or not self.n:
            return self
        at = self.k * RANGES // self.n
        return self._replace(p=float(grid[max(at - 1, 0)]), q=float(grid[min(at + 2, RANGES)]))

    def narrowed(self, counts, grid, in_place: int) -> _Range:
        """After a pass: place k lies below the lower pivot, at it, between them, at the upper one or above.

        Outside of both pivots nothing was sketched: then the next pass only sketches.
        """
        a, b, p, q = (None if x is None or isnan(x) else float(x) for x in (self.a, self.b, self.p, self.q))
        k, n = int(self.k), int(self.n)
        if n <= in_place:
            return _Range(a, b, k, n, p, q, None if self.v is None or isnan(self.v) else float(self.v))
        below, low, mid, high = map(int, counts)
        blank = _Range(a, b, k, n, None, None, None)
        if k < below:
            return blank._replace(b=p, n=below)
        if k < below + low:
            return blank._replace(n=0, v=p)
        if k < below + low + mid:
            return blank._replace(a=a if p is None else p, b=b if q is None else q, k=k - below - low, n=mid).with_pivots(grid)
        if k < below + low + mid + high:
            return blank._replace(n=0, v=q)
        above = below + low + mid + high
        return blank._replace(a=q, k=k - above, n=n - above)


def _frame(keys: pd.DataFrame, ranges: list[_Range], width: int) -> pd.DataFrame:
    out = keys.reset_index(drop=True)
    for i, name in enumerate(_Range._fields):
        out[name] = [[r[i] for r in ranges[j * width : (j + 1) * width]] for j in range(len(out))]
    return out


def _small(rows: DataFrame, width: int, most: int = 32 << 20) -> DataFrame:
    """rows (of `width` ranks) hinted for broadcast if their bytes are few; groups of many values are."""
    return F.broadcast(rows) if rows.count() * 120 * width <= most else rows
