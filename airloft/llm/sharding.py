"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global row number; a keyed Feistel network with cycle walking
permutes 0..n-1, and the permuted number modulo the shard count is the shard,
its quotient the slot. Shards differ by at most one row and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, cut, if_small, shielded, table

SHARDS = 8
ROUNDS = 6
#: Rows of a hash bucket, in which rows are numbered, on average.
BUCKET_ROWS = 1 << 17
#: Identical rows from which they have buckets of their own.
HOT_ROWS = 1 << 16
#: Steps of the cycle walk. The domain exceeds n by less than its square root,
#: so even for small n all steps fit, and for large n the chance of needing so
#: many is below n ** -60; a row that did would raise an error.
WALK = 128


def _network(x: Column, a: Column, b: Column, seed: int, rounds: int) -> Column:
    """A permutation of 0..a*b-1: halves in mixed radix, keyed additions in turn."""
    right = F.pmod(x, b)
    left = ((x - right) / b).cast("long")  # divides exactly
    for r in range(rounds):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), a), a)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), b), b)
    return left * b + right


def permuted(number: Column, n: Column, a: Column, b: Column, seed: int = 17, rounds: int = ROUNDS) -> Column:
    """Where the permutation of 0..n-1 puts `number`; a * b >= n must hold with a * b - n < a."""
    once = _network(number, a, b, seed, rounds)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < n, x).otherwise(_network(x, a, b, seed, rounds)))
    return F.when(once < n, once).otherwise(walked)


def numbered(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds a gapless global row number _row and the row count _n.

    The number depends on doc_id and text alone. Rows are ranked within hash
    buckets; the bucket sizes give each bucket its first number. Identical rows
    beyond hot_rows would fill one bucket; they are numbered after all others,
    dealt over as many buckets of their own as they fill, by a hash of where they
    lie, which does not matter as they are interchangeable. So there are at most
    n / hot_rows + 2 n / bucket_rows buckets, whose sizes are broadcast if
    their bytes are few.
    """
    n = docs.count()
    buckets, h = max(64, -(-n // bucket_rows)), F.xxhash64(F.col("doc_id"), F.col("text"))
    counts = docs.groupBy(h.alias("_hash")).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > hot_rows)
    hot = cut(counts.select("_hash", F.ceil(F.col("_copies") / bucket_rows).alias("_parts")))
    rows = docs.withColumn("_hash", h).withColumns({"_key": F.lit(0).cast("long"), "_hot": F.lit(False), "_bucket": F.pmod("_hash", F.lit(buckets))})
    if hot.limit(1).count():
        held = if_small(hot, 24)
        dealt = rows.join(held, "_hash").withColumns({"_key": F.col("_hash"), "_hot": F.lit(True), "_bucket": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))})
        rows = rows.join(held, "_hash", "left_anti").unionByName(cut(dealt.drop("_parts")))
    place = ["_hot", "_key", "_bucket"]
    upto = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bucket
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_held"))
    starts = cut(sizes.select(*place, (F.sum("_held").over(upto) - F.col("_held")).alias("_start")))
    order = Window.partitionBy(*place).orderBy("_hash", "doc_id")
    return (
        rows.withColumn("_rank", F.row_number().over(order) - 1)
        .join(if_small(starts, 40), place)
        .withColumn("_row", F.col("_start") + F.col("_rank"))
        .withColumn("_n", F.lit(n).cast("long"))
        .drop("_hash", *place, "_rank", "_start")
    )


@shielded("doc_id", "text")
def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Adds shard (int) and slot (long) to docs (doc_id, text, ...).

    Null ids and texts are values like others. Identical rows are
    interchangeable: which of them gets which slot may differ between runs, the
    set of rows does not. Of a long text only its hash is compared.
    """
    side = F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long")
    rows = numbered(docs).withColumn("_a", side).withColumn("_b", F.ceil(F.col("_n") / F.col("_a")).cast("long"))
    rows = rows.withColumn("_to", permuted(F.col("_row"), F.col("_n"), F.col("_a"), F.col("_b"), seed))
    sure = F.when(F.col("_to") < F.col("_n"), F.col("_to")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    rows = rows.withColumn("_to", sure)
    return rows.withColumn("shard", F.pmod(F.col("_to"), F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("_to") / shards).cast("long")).drop("_n", "_a", "_b", "_to", "_row")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = docs.select(
        "doc_id",
        F.xxhash64("text").cast("string").alias("text"),  # numbering needs the text's hash only
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return assign_shards(measured).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
