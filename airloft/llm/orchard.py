"""Clusters of vectors around centroids, assigned by Orchard's search.

Each centroid has a list of the others by distance. A vector walks the list of
the closest centroid it knows; when it meets a closer one it goes on with that
one's list, passing over those it has measured, and it stops at the first that is
strictly more than twice as far from the current centroid as the vector is: by
the triangle inequality no later one is as close. All in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, table

CENTROIDS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: Components of this size or more have squared distances that a long may not hold.
TOO_LARGE = 1 << 26
#: Vectors that walk together.
TOGETHER = 8192


class Lists:
    """Centroids and, for each, the others in order of distance with their squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        gaps = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        own = np.eye(k, dtype=bool)
        self.near = np.argsort(np.where(own, -1, gaps), axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each vector its nearest centroid (of equally near ones the first) and its squared distance; and how many distances were measured."""
        n, k = len(x), len(self.centroids)
        at, d = np.zeros(n, np.int64), ((x - self.centroids[0]) ** 2).sum(axis=1)
        place, seen = np.zeros(n, np.int64), np.zeros((n, k), bool)
        seen[:, 0] = True
        walking, measured = np.arange(n if k > 1 else 0), n
        while len(walking):
            step, c = place[walking], at[walking]
            go = step < k - 1
            go[go] = self.gaps[c[go], step[go]] <= 4 * d[walking[go]]
            walking = walking[go]
            other = self.near[c[go], step[go]]
            place[walking] += 1
            fresh = ~seen[walking, other]
            rows, other = walking[fresh], other[fresh]
            seen[rows, other] = True
            measured += len(rows)
            far = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            better = (far < d[rows]) | ((far == d[rows]) & (other < at[rows]))
            rows = rows[better]
            at[rows], d[rows], place[rows] = other[better], far[better], 0
        return at, d, measured


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column(1)
    return np.asarray(values.flatten(), np.int64).reshape(len(values), width)


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector of whole numbers) of rows (vec_id, embedding) with exactly `width` components, none null, non-finite or too large."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    fine = (F.size("embedding") == width) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < TOO_LARGE), F.lit(False)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v).cast("int")).alias("vector"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of the k smallest hashes of ids; equal hashes by vector, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["vector"] for r in rows.select("vector", order.alias("h")).orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of the vectors nearest to it; an empty one stays. Tasks send a sum a centroid."""
    k, width = centroids.shape
    held = rows.sparkSession.sparkContext.broadcast(Lists(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _vectors(batch, width)
            for i in range(0, len(x), TOGETHER):
                part = x[i : i + TOGETHER]
                at = lists.nearest(part)[0]
                np.add.at(sums, at, part)
                counts += np.bincount(at, minlength=k)
        used = np.flatnonzero(counts)
        flat = pa.array(sums[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, width, dtype=np.int32)), flat)], ["cluster", "n", "sums"])

    wide = rows.mapInArrow(run, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums"))
    out = centroids.copy()
    for r in wide.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect():  # k x width rows
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of rows (vec_id, vector)."""
    width = centroids.shape[1]
    held = rows.sparkSession.sparkContext.broadcast(Lists(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        for batch in batches:
            x = _vectors(batch, width)
            found = [lists.nearest(x[i : i + TOGETHER])[:2] for i in range(0, len(x), TOGETHER)]
            at, d = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """Clusters of rows (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A row a kept vector: of exactly `width` components, none null, non-finite or
    of 2**26 / scale or more in size. Repeated ids are vectors of their own; a
    null id comes last in the choice of first centroids. With fewer than k
    vectors each starts as a centroid; an empty table gives no rows. Other
    columns are not read. An inertia beyond a long is null.
    """
    path = shared_folder(vectors.sparkSession, "vectors")
    quantised(vectors, width, scale).write.parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = cut(assigned(rows, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    fits = lambda v: v if v < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(i, fits(sums[i]), fits(sum(sums.values())), digest(centroids[i])) for i in sorted(sums)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def sql() -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r)"
        )
        if i < ROUNDS:
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(q ORDER BY p) AS v FROM ("
                f"SELECT c, p, ((s - (s % n + n) % n) // n)::BIGINT AS q FROM (SELECT m.c AS c, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {WIDTH + 1}) t(p) GROUP BY ALL)) GROUP BY c) n USING (c))"
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256"
        f" FROM (SELECT vec_id, m.c AS c, m.d AS d FROM a{ROUNDS} JOIN kept USING (r)) JOIN c{ROUNDS} USING (c)"
    )
