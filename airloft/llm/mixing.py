"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key divided by its quality weight; within a
source the documents in key order are a weighted sample without replacement.
Complete epochs of a source come first; the rest of its token budget takes a
prefix of the key order. The prefix sum is computed in key-range buckets, so a
source that holds most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_to_long, shielded, table, word_count

#: Source weights in order of the source names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Key ranges per source. A task sorts the narrow rows of one range, so raise
#: it when a source holds more than some 10 million documents a range.
RANGES = 1024


def _source_key(source: Column) -> Column:
    """Sorts as the name by code point, null after all names."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """Token budgets of sources: sizes has one row (_src, source_size) a source.

    The total of all sizes is shared by weight. A source stops at `most` times
    its size and the excess goes to the others by weight until none is above.
    In order of cap / weight the capped sources come first, so running sums
    over the (few) sources give the level that the others share.
    """
    by_name, by_ratio = Window.orderBy("_src"), Window.orderBy("_ratio", "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rank = F.row_number().over(by_name) - 1
    ranked = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1))
        .withColumn("_cap", most * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    )
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    levelled = ranked.withColumn("_level", level).withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    shared = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    return levelled.select("_src", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * shared).alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights=WEIGHTS,
    most: int = MAX_EPOCHS,
    seed: str = "mix",
    ranges: int = RANGES,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """How often each row of docs (doc_id, text, source) enters the mix.

    quality: optional (doc_id, weight), at most one row a doc_id; a missing,
    null or non-positive weight counts as 1. Returns the columns `keep` and
    _src, size, source_size, target, copies, taken.

    Null text has size 0; null sources form one source, the last by name.
    Repeated rows are separate documents; whole documents are taken, so a
    source misses its target by at most half of its largest document. The
    sample depends on seed, doc_id and text alone.
    """
    digest = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    rows = docs.select(*[F.col(c) for c in dict.fromkeys((*keep, "doc_id"))], _source_key(F.col("source")).alias("_src"), word_count(F.col("text")).alias("size"), hex_to_long(digest).alias("_h"))
    weight = F.lit(1.0)
    if quality is not None:
        known = quality.select(F.col("doc_id").alias("_qid"), F.col("weight").alias("_qw"))
        rows = rows.join(known, rows["doc_id"] == known["_qid"], "left").drop("_qid")
        weight = F.when(F.col("_qw") > 0, F.col("_qw").cast("double")).otherwise(1.0)
    unit = (F.col("_h") + F.lit(0.5)) / F.lit(float(2**52))
    rows = rows.withColumn("_key", -F.log(unit) / weight)
    rows = rows.withColumn("_range", F.least(F.floor(ranges * (1 - F.exp(-F.col("_key")))), F.lit(ranges - 1)).cast("int")).drop("_qw")

    in_range = rows.groupBy("_src", "_range").agg(F.sum("size").alias("_held"))
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    budgets = source_targets(in_range.groupBy("_src").agg(F.sum("_held").alias("source_size")), weights, most)
    starts = in_range.withColumn("_start", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).join(budgets, "_src")

    order = Window.partitionBy("_src", "_range").orderBy("_key", "_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    ahead = F.col("_start") + F.sum("size").over(order) - F.col("size")
    return (
        rows.join(starts.drop("_held"), ["_src", "_range"])
        .withColumn("_epochs", epochs)
        .withColumn("_rest", rest)
        .withColumn("_ahead", ahead)
        .withColumn("copies", (F.col("_epochs") + ((F.col("_rest") > 0) & (2 * F.col("_ahead") + F.col("size") <= 2 * F.col("_rest"))).cast("int")).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select(*keep, "_src", "size", "source_size", "target", "copies", "taken")
    )


@shielded("doc_id", "text", "source")
def take_mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, most: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    mixed = mix_sources(docs, quality, weights, most, seed, keep=tuple(docs.columns)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from a 0/1 quality column: 0.5 for 0, 1.5 for 1, means between; repeated ids are averaged."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((0.5 + F.avg("quality")).alias("weight"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix_sources(docs, label_quality(labels)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH q AS (SELECT doc_id, 0.5 + avg(quality) AS w FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d AS (
  SELECT d.doc_id, coalesce('s' || d.source, 't') AS src,
         CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), '-') || chr(31) || coalesce(d.text, '')), 1, 13) AS BIGINT) AS h,
         CASE WHEN q.w > 0 THEN q.w ELSE 1.0 END AS w
  FROM documents d LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((h + 0.5) / 4503599627370496.0::DOUBLE) / w AS k FROM d),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)] AS sw, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / sw AS ratio FROM r),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(sw) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT src, source_size, CASE WHEN ratio <= level THEN cap ELSE sw * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM l),
o AS (
  SELECT k.*, t.source_size, t.target, sum(size) OVER (PARTITION BY src ORDER BY k, h, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM k JOIN t USING (src)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * ahead + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
