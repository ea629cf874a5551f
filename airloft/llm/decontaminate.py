"""Benchmark decontamination by spaced-seed hashing.

A mask picks four of five or six consecutive tokens and ignores those between.
The tokens that a mask picks are hashed at every position of the benchmark and of
the training texts, and equal hashes of one mask meet in a join. With the two
masks used here an item of 8 tokens or more, up to a fifth of which is
substituted, still shares a hash (checked over all placements to 24 tokens; a
longer item has ten consecutive tokens with at most two substituted).
Shorter items, which may have one token substituted from five on, have masks of
their own: the whole item, or its two halves. Each hit is then verified:
benchmark and text are aligned at the hit and compared token by token around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_pair, if_small, shielded, table

SPAN = 8
#: Places of a window that are hashed; the others are ignored.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
STRIDE = 1
#: Tokens compared on each side of a hit's window.
REACH = 64
#: Share of the item's tokens around the hit that must agree, or
SIMILAR = 0.8
#: the score that an aligned segment must reach at 1 an equal token, -4 another.
SEGMENT = 13


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lowered; empty for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def seeds(token: Column, stride: int) -> Column:
    """array<struct<p, h>>: window starts and the hash of the tokens that a mask picks there, of one mask after the other."""

    def of(k: int, mask: tuple[int, ...]) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(token) - 1 - mask[-1], F.lit(0)), F.lit(stride))
        made = F.transform(starts, lambda p: F.struct(p.alias("p"), F.xxhash64(F.lit(k), *[F.get(token, p + o) for o in mask]).alias("h")))
        return F.when(F.size(token) > mask[-1], made).otherwise(F.slice(made, 1, 0))

    return F.concat(*[of(k, mask) for k, mask in enumerate(MASKS)])


def _short_masks(n: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of an item of n < SPAN tokens of which one is intact in every text that counts."""
    return [(0, n)] if n < 5 else [(0, n // 2), (n // 2, n - n // 2)]


def find_short(based: DataFrame, items: DataFrame) -> DataFrame:
    """(_t1, _t2, item_id, overlap) of texts (_t1, _t2, _tok) with 0.8 of the tokens of an item (item_id, _it) of under SPAN tokens in place.

    Windows of each length meet the items by the hash of a run and are compared
    at once, so no list of hits is kept, however common the run is. Texts have
    an empty place at either end for a token that is cut off.
    """
    lengths = sorted(r["n"] for r in items.select(F.size("_it").alias("n")).distinct().collect())  # at most SPAN - 1
    if not lengths:
        return based.sparkSession.createDataFrame([], "_t1 long, _t2 long, item_id string, overlap double")
    runs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(m).alias("m")) for n in lengths for k, (a, m) in enumerate(_short_masks(n))])
    cut_out = lambda row, r, start: F.xxhash64(F.slice(row, start + r["a"] + 1, r["m"]))
    probes = items.select("item_id", "_it", F.explode(F.filter(runs, lambda r: r["n"] == F.size("_it"))).alias("r"))
    probes = cut(probes.select("item_id", "_it", F.col("r.n").alias("_n"), F.col("r.k").alias("_k"), cut_out(F.col("_it"), F.col("r"), F.lit(0)).alias("_h")))
    row = F.col("_row")
    padded = based.select("_t1", "_t2", F.concat(F.array(F.lit(None).cast("long")), "_tok", F.array(F.lit(None).cast("long"))).alias("_row"))
    last = F.size("_row") - F.col("r.n")
    places = padded.select("_t1", "_t2", "_row", F.explode(runs).alias("r")).where(last >= 0).select("_t1", "_t2", "_row", "r", F.explode(F.sequence(F.lit(0), last)).alias("_p"))
    windows = places.select("_t1", "_t2", F.col("r.n").alias("_n"), F.col("r.k").alias("_k"), cut_out(row, F.col("r"), F.col("_p")).alias("_h"), F.slice(row, F.col("_p") + 1, F.col("r.n")).alias("_mine"))
    met = windows.join(if_small(probes, 64 + 8 * F.size("_it")), ["_n", "_k", "_h"])
    agree = F.size(F.filter(F.zip_with("_mine", "_it", lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return met.withColumn("overlap", agree / F.col("_n")).where(F.col("overlap") >= SIMILAR).select("_t1", "_t2", "item_id", "overlap")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated text: (_t1, _t2, item_id, overlap).

    overlap is the share of the item's tokens around the hit that agree; the
    item is the one of highest overlap, then smallest item_id.
    """
    every = benchmark.where(F.col("text").isNotNull()).select("item_id", tokens(F.col("text")).alias("_it")).where(F.size("_it") > 0).dropDuplicates(["item_id", "_it"])
    items = every.where(F.size("_it") >= SPAN)
    probes = items.select("item_id", F.xxhash64("_it").alias("_iv"), F.explode(seeds(F.col("_it"), 1)).alias("s"))
    probes = cut(probes.select("item_id", "_iv", F.col("s.p").alias("_q"), F.col("s.h").alias("_h")).distinct())

    t1, t2 = hash_pair(F.col("text"))
    based = docs.where(F.col("text").isNotNull()).select(t1.alias("_t1"), t2.alias("_t2"), tokens(F.col("text")).alias("_tok"))
    windows = based.select("_t1", "_t2", F.explode(seeds(F.col("_tok"), STRIDE)).alias("s")).select("_t1", "_t2", F.col("s.p").alias("_p"), F.col("s.h").alias("_h"))
    met = windows.join(if_small(probes, 48), "_h")
    place = F.floor(F.col("_p") / REACH)
    hits = cut(met.groupBy("_t1", "_t2", "item_id", "_iv", (F.col("_p") - F.col("_q")).alias("_shift"), place.alias("_place")).agg(F.min("_p").alias("_p")))

    q = F.col("_p") - F.col("_shift")
    low = F.greatest(F.lit(-REACH), -q)
    high = F.least(F.lit(SPAN + REACH), F.size("_it") - q)
    inside = F.greatest(low, -F.col("_p"))
    aligned = (
        based.join(if_small(hits, 64), ["_t1", "_t2"])
        .join(if_small(cut(items.withColumn("_iv", F.xxhash64("_it"))), 64 + 8 * F.size("_it")), ["item_id", "_iv"])
        .withColumn("_region", high - low)
        .withColumn("_mine", F.slice("_tok", F.col("_p") + inside + 1, high - inside))
        .withColumn("_theirs", F.slice("_it", q + inside + 1, high - inside))
        .withColumn("_same", F.zip_with("_mine", "_theirs", lambda a, b: a.eqNullSafe(b)))
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def extend(acc: Column, same: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + F.when(same, 1).otherwise(-4))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    checked = aligned.withColumn("_overlap", F.size(F.filter("_same", lambda x: x)) / F.col("_region")).withColumn("_score", F.aggregate("_same", zero, extend)["best"])
    leaks = checked.where((F.col("_overlap") >= SIMILAR) | (F.col("_score") >= SEGMENT)).select("_t1", "_t2", "item_id", F.col("_overlap").alias("overlap"))
    short = find_short(based, cut(every.where(F.size("_it") < SPAN)))
    leaks = leaks.unionByName(short.withColumn("item_id", F.col("item_id").cast(leaks.schema["item_id"].dataType)))
    best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("item_id").alias("i")))
    return leaks.groupBy("_t1", "_t2").agg(best.alias("b")).select("_t1", "_t2", F.col("b.i").alias("item_id"), (-F.col("b.o")).alias("overlap"))


@shielded("text")
def mark_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (text, ...) with contaminated (boolean), item_id and overlap.

    Null texts, and items without a token, match nothing; an item of one token
    marks every text that has it. Equal texts get equal results, the item of
    highest overlap and then smallest item_id; an empty benchmark marks
    nothing. Texts of any length are read whole. Columns of docs called
    item_id, overlap or contaminated are replaced.
    """
    leaks = if_small(cut(find_leaks(docs.select("text"), benchmark.select("item_id", "text"))), 64)
    t1, t2 = hash_pair(F.col("text"))
    keyed = docs.withColumn("_t1", t1).withColumn("_t2", t2)
    return keyed.join(leaks, ["_t1", "_t2"], "left").withColumn("contaminated", F.col("overlap").isNotNull() & F.col("text").isNotNull()).drop("_t1", "_t2")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_id", "overlap")
