"""Near-duplicate classes by improved consistent weighted sampling.

Shingles of five words are weighted by tf-idf. A consistent weighted sample of
a text agrees with that of another with probability equal to their weighted
Jaccard similarity; samples are banded, texts that share a band are compared,
and every link is verified on the whole texts. First each text meets a few of a
band, which links most families of copies; then all texts of a band that are
not in one class by then are compared with each other, block by block.

The idf of a shingle is the mean idf of its words. Document frequencies of words
are counted exactly over all documents. A word in at most one of RARE documents
counts as found in just that share, so what every task needs, the commoner
words, is at most RARE times the mean number of different words of a text,
whatever the vocabulary and the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small, shielded, small_batches, table
from .textnum import U, Texts, grams, mix, raw, slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 4
#: Words in at most one of so many documents share one idf.
RARE = 4096
#: Rows of counts that a task holds before it adds them up.
COUNTED = 1 << 20
#: Pairs of the first round whose samples agree less than this (0.8 less three deviations of the estimate) are left to links_within_bands.
LIKELY = 0.6
#: Texts of a band that are put in order together, and how many before a text it is compared with.
PART_ROWS, NEIGHBOURS = 256, 2
#: Texts and bytes of a block; texts of a band that are left over are compared block against block.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Bytes of texts that are verified together.
SLICE_BYTES = 3 << 20
#: Columns of the matrix product that compares two blocks, at once.
WIDTH = 2048

_RNG = np.random.default_rng(20240229)
_SALTS = _RNG.integers(1, 2**63, size=(BANDS * ROWS, 3), dtype=np.int64).astype(U) | U(1)
_NEGLOG = (-np.log((np.arange(65536) + 0.5) / 65536)).astype(np.float32)


@dataclass
class Idf:
    """Inverse document frequencies: of the words with the sorted hashes, and of all others."""

    words: np.ndarray
    values: np.ndarray
    other: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other, np.float32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.values[at], np.float32(self.other))


def summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words and the sums of their counts."""
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), words[1:] != words[:-1]]))
    return words[new], np.add.reduceat(counts, new) if len(new) else counts


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, n) of texts (text): the documents that have the word with this hash; of a null word, the documents with any word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = [(np.zeros(0, U), np.zeros(0, np.int64))], 0
        for batch in batches:
            for _, _, t in slices(batch.column(0), lower=True):
                order = np.argsort(t.hashes, kind="stable")
                h, own = t.hashes[order], t.owners()[order]
                once = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
                held.append(summed(h[once], np.ones(np.count_nonzero(once), np.int64)))
                filled += np.count_nonzero(np.diff(t.first))
            if sum(len(w) for w, _ in held) > COUNTED:
                words, n = summed(*(np.concatenate(x) for x in zip(*held)))
                held = [(words, n)]
                if len(words) > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
                    held = [(words[:0], n[:0])]
        words, n = summed(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([filled], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def idf_table(texts: DataFrame) -> Idf:
    """1 + ln((1 + documents) / (1 + frequency)), a frequency being one of RARE documents at least."""
    counts = cut(document_frequencies(texts))
    row = counts.where("word IS NULL").first()
    total = row["n"] if row else 0
    least = max(1.0, total / RARE)
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") > least)).toArrow()
    words, df = (np.asarray(rows[c].combine_chunks()) if rows.num_rows else np.zeros(0, np.int64) for c in ("word", "n"))
    order = np.argsort(words.view(U))
    value = lambda n: 1 + np.log((1 + total) / (1 + n))
    return Idf(words.view(U)[order], value(df[order]).astype(np.float32), float(value(least)))


def weighted_shingles(t: Texts, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in hash order: hash, text, tf-idf weight."""
    h, own, at = grams(t, SHINGLE, short=True)
    if not len(h):
        return h, own, np.zeros(0, np.float32)
    word = np.concatenate([[0.0], np.cumsum(idf.of(t.hashes), dtype=np.float64)])
    stop = np.minimum(at + SHINGLE, t.first[own + 1])
    weight = (word[stop] - word[at]) / (stop - at)
    order = np.lexsort((h, own)) if len(t) >= 1 << 20 else np.argsort((own.astype(U) << U(44)) | (h >> U(20)), kind="stable")
    h, own, weight = h[order], own[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]))
    return h[new], own[new], np.add.reduceat(weight, new).astype(np.float32)


def samples(h: np.ndarray, own: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Consistent weighted samples, one row of BANDS * ROWS uint64 a text; 0 where a text has no shingle."""
    out = np.zeros((n, BANDS * ROWS), U)
    if not len(h):
        return out
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    texts, lens = own[starts], np.diff(np.append(starts, len(own)))
    lo = 0
    while lo < len(starts):  # runs of texts whose arrays stay in cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 32768)))
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(h)
        hs, logs, at = h[a:b], np.log(weight[a:b]), starts[lo:hi] - a
        local = np.repeat(np.arange(hi - lo), lens[lo:hi])
        for k in range(BANDS * ROWS):
            x = (hs ^ _SALTS[k, 0]) * _SALTS[k, 1]
            x ^= x >> U(32)
            x *= _SALTS[k, 2]
            x ^= x >> U(29)
            u = _NEGLOG[x.view(np.uint16).reshape(-1, 4)]
            r = u[:, 0] + u[:, 1]
            c = u[:, 2] + u[:, 3]
            beta = ((x * _SALTS[k, 0]) >> U(40)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(logs / r + beta)
            value = np.log(c) - r * (t - beta + 1)
            least = np.minimum.reduceat(value, at)
            hit = np.flatnonzero(value == least[local])[::-1]
            chosen = np.empty(hi - lo, np.int64)
            chosen[local[hit]] = hit
            out[texts[lo:hi], k] = mix(hs[chosen] + t[chosen].astype(np.int64).astype(U) * _SALTS[k, 1])
        lo = hi
    return out


def sampled(texts: DataFrame, idf) -> DataFrame:
    """(node, id, bands array<long>, sig binary, size) of rows (node, id, text) that have a word."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = idf.value
        for batch in batches:
            lengths = np.diff(raw(batch.column(2))[1])
            for i, j, t in slices(batch.column(2), lower=True):
                s = samples(*weighted_shingles(t, table_), len(t))
                bands = np.zeros((len(t), BANDS), U)
                for b in range(BANDS):
                    key = np.full(len(t), b + 1, U)
                    for r in range(ROWS):
                        key = mix(key * U(0x9E3779B97F4A7C15) + s[:, b * ROWS + r])
                    bands[:, b] = key
                has = np.diff(t.first) > 0
                short = np.ascontiguousarray(s >> U(48)).astype(np.uint16)
                keep = np.flatnonzero(has)
                part = batch.slice(i, j - i).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(list(bands[keep].view(np.int64)), pa.list_(pa.int64())),
                        pa.array([row.tobytes() for row in short[keep]], pa.binary()),
                        pa.array(lengths[i:j][keep], pa.int64()),
                    ],
                    ["node", "id", "bands", "sig", "size"],
                )

    return texts.select("node", "id", "text").mapInArrow(sample, "node binary, id long, bands array<long>, sig binary, size long")


def _agreement(a: str, b: str):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            x, y = (np.frombuffer(b"".join(batch.column(names.index(c)).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in (a, b))
            alike = (x == y).mean(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], ["a", "b", "alike"])

    return share


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, alike) with a < b: likely links among texts that share a band.

    Each text is paired, in each of its bands, with the band's head and with
    the texts just before it in the order of their next band, where closer
    texts are neighbours. The head is the text with the most company over all
    of its bands: among copies of one text that is mostly the original. So
    pairs grow with the number of texts, not with the square of a band's
    size; huge bands are cut into parts for the neighbours, and their join
    with the heads is a plain shuffled one that AQE can split. Pairs that this
    leaves out are compared by links_within_bands.
    """
    banded = nodes.select("node", F.posexplode("bands").alias("i", "band"), "bands")
    banded = banded.select("node", "band", F.get("bands", F.pmod(F.col("i") + 1, F.lit(BANDS))).alias("near"))
    sizes = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(banded.join(sizes, "band"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    heads = cut(shared.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("m")).select("band", F.col("m.node").alias("head")))
    to_head = shared.join(heads, "band").select("node", F.col("head").alias("other"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART_ROWS))
    order = Window.partitionBy("band", part).orderBy("near", "node")
    before = F.array(*[F.lag("node", k).over(order) for k in range(1, NEIGHBOURS + 1)])
    to_neighbours = shared.select("node", before.alias("before")).select("node", F.explode("before").alias("other")).where(F.col("other").isNotNull())
    pairs = to_head.union(to_neighbours).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()
    sig = nodes.select("node", "sig")
    joined = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    shares = joined.select("a", "b", "sa", "sb").mapInArrow(_agreement("sa", "sb"), "a binary, b binary, alike double")
    return shares.where(F.col("alike") >= LIKELY)


def similarities(left: Texts, right: Texts, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of the texts pair by pair."""
    n = len(left)
    (h1, o1, w1), (h2, o2, w2) = weighted_shingles(left, idf), weighted_shingles(right, idf)
    h, own, weight = np.concatenate([h1, h2]), np.concatenate([o1, o2]), np.concatenate([w1, w2]).astype(np.float64)
    order = np.lexsort((h, own))
    h, own, weight = h[order], own[order], weight[order]
    twice = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1]))
    shared = np.bincount(own[twice], np.minimum(weight[twice], weight[twice + 1]), minlength=n)
    total = np.bincount(own, weight, minlength=n) - shared
    return np.divide(shared, total, out=np.zeros(n), where=total > 0)


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, idf, similar: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = idf.value
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ends = np.cumsum(np.diff(raw(left)[1]) + np.diff(raw(right)[1]))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
                a, b = (next(slices(c.slice(i, j - i), True, 1 << 62))[2] for c in (left, right))
                part = batch.slice(i, j - i).filter(pa.array(similarities(a, b, table_) >= similar))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])
                i = j

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(ends.join(nodes.select("node", "id"), "node"))
    held = texts.alias("t").join(if_small(wanted).alias("w"), F.expr("t.node = w.node AND t.id <=> w.id"), "left_semi").select("node", "text")
    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary").distinct()


def block_links(node: list[bytes], root: np.ndarray, rest: np.ndarray, t: Texts, idf: Idf, similar: float) -> list[tuple[bytes, bytes]]:
    """Pairs that join what is similar among texts: those of `rest` against all, by exact weighted Jaccard similarity.

    With equal roots (numbers) counted as joined, the pairs connect all that
    the similar pairs connect, and are fewer than the texts. The least of two
    weights is a sum over levels of weight that both reach, so the shared
    weights of all pairs are one product of matrices.
    """
    n, wanted = len(node), np.flatnonzero(rest)
    h, own, weight = weighted_shingles(t, idf)
    weight = weight.astype(np.float64)
    total = np.bincount(own, weight, minlength=n)
    order = np.lexsort((weight, h))
    h, own, weight = h[order], own[order], weight[order]
    start = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    shared = np.bincount(np.cumsum(start) - 1)[np.cumsum(start) - 1] > 1 if len(h) else start
    h, own, weight, start = h[shared], own[shared], weight[shared], start[shared]
    common = np.zeros((len(wanted), n))
    if len(h):
        step = weight - np.where(start, 0, np.concatenate([[0], weight[:-1]]))
        level = start | (step > 1e-4 * weight)
        column = np.cumsum(level) - 1
        first = column[np.flatnonzero(start)][np.cumsum(start) - 1]
        height, reach = np.sqrt(step[level]), column - first + 1
        at = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        who = np.repeat(own, reach)
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        for lo in range(0, len(height), WIDTH):
            a, b = np.searchsorted(at, (lo, lo + WIDTH))
            x = np.zeros((n, min(WIDTH, len(height) - lo)))
            x[who[a:b], at[a:b] - lo] = height[at[a:b]]
            common += x[wanted] @ x.T
    alike = np.zeros((n, n), bool)
    alike[wanted] = common >= (similar - 1e-9) * (total[wanted][:, None] + total - common)
    alike |= alike.T
    same = root[:, None] == root
    links, seen = [], np.zeros(n, bool)
    for begin in range(n):
        stack = [] if seen[begin] else [begin]
        seen[begin] = True
        while stack:
            i = stack.pop()
            new = np.flatnonzero((alike[i] | same[i]) & ~seen)
            seen[new] = True
            stack += new.tolist()
            links += [(node[i], node[j]) for j in new if not same[i, j]]
    return links


def links_within_bands(nodes: DataFrame, roots: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """Pairs (a, b) that link classes (node, root) whose texts share a band: no pair of texts of different classes in a band is left out.

    Bands of one class need nothing. In any other, the texts of its largest class and
    the rest are dealt to blocks of bounded size; blocks of the rest meet all
    blocks. So a family of copies that is one class but for a few texts costs
    in proportion, while one of unlike texts is compared in full.
    """
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    sizes = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = banded.join(sizes.select("band"), "band").join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    each = [F.bit_xor(h).alias(f"x{i}") for i, h in enumerate((F.xxhash64("node"), F.xxhash64(F.lit(7), "node")))]
    kinds = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *each)
    bands = kinds.groupBy("band").agg(F.max(F.struct("n", "root", "bytes")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)])
    # Bands of the same texts are compared once.
    bands = cut(bands.where("roots > 1").groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "most", "bytes")).alias("b")).select("n", "b.*"))
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES, F.lit(1e-9))).cast("long")
    one = (F.col("n") <= BLOCK_ROWS) & (F.col("bytes") <= BLOCK_BYTES)
    rest = parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    bands = bands.select("band", F.col("most.root").alias("main"), F.when(one, 1).otherwise(rest).alias("others"), F.when(one, 0).otherwise(parts(F.col("most.n"), F.col("most.bytes"))).alias("mains"))
    dealt = members.select("band", "node", "root").join(bands, "band").withColumn("rest", F.col("root") != F.col("main"))
    dealt = dealt.withColumn("block", F.when(F.col("mains") == 0, 0).when(F.col("rest"), F.pmod(F.xxhash64("node"), F.greatest("others", F.lit(1)))).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1))).where("mains = 0 OR block <> with")
    met = cut(met.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "node", "root", "rest"))
    wanted = cut(met.select("node").distinct().join(nodes.select("node", "id"), "node"))
    held = texts.alias("t").join(if_small(wanted).alias("w"), F.expr("t.node = w.node AND t.id <=> w.id"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def link(block: pa.Table) -> pa.Table:
        node = block["node"].to_pylist()
        _, root = np.unique(np.array([r.hex() for r in block["root"].to_pylist()]), return_inverse=True)
        t = next(slices(block["text"], True, 1 << 62))[2]
        found = block_links(node, root, np.array(block["rest"].to_pylist(), bool), t, idf.value, similar)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return met.join(held, "node").groupBy("band", "lo", "hi").applyInArrow(link, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every end of edges (a, b); the root is the smallest node of the component.

    Labels spread over edges and jump to their label's label, so rounds grow
    with the logarithm of a component's width. Each round is written, so lost
    executors cost one round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(spread, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = cut(nearer.join(jump, "next").select("node", "root", F.least("next", "far").alias("next")))
        done = moved.where("root <> next").limit(1).count() == 0
        labels = moved.select("node", F.col("next").alias("root"))
        if done:
            return labels


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_texts, node) of each row of docs (doc_id, text); node is the text's digest.

    class_id is the smallest doc_id of the class, n_texts the number of
    different texts in it. Equal texts are one class, empty ones too; a null
    text is alone in its class. Texts under five words are one shingle. Words
    are split at ASCII white space with A-Z lowered. Rows of one doc_id may
    hold different texts; then both may carry that id as class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    based = docs.select(F.col("doc_id"), F.col("doc_id").cast("long").alias("id"), "text", F.unhex(F.md5("text")).alias("node"))
    texts = based.where(F.col("text").isNotNull())
    idf = spark.sparkContext.broadcast(idf_table(texts))
    nodes = cut(sampled(texts, idf).groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size")))

    pairs = cut(candidate_pairs(nodes))
    ends = pairs.select(F.col("a").alias("n"), "a", "b", "alike").union(pairs.select(F.col("b").alias("n"), "a", "b", "alike"))
    best = ends.groupBy("n").agg(F.max(F.struct("alike", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    first = cut(verified(best, texts, nodes, idf, similar))
    roots = components(first)

    within = links_within_bands(nodes, roots, texts, idf, similar)
    joined = components(cut(first.union(within)))

    sizes = joined.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    classed = joined.join(sizes, "root").select("node", "class", "n")
    copies = based.groupBy("node").agg(F.min("id").alias("least"))
    final = cut(copies.where(F.col("node").isNotNull()).join(classed, "node", "left").select("node", F.coalesce("class", "least").alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n_texts")))
    found = based.select("doc_id", "id", "node").join(final, "node", "left")
    return found.select("doc_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"), "node")


@shielded("doc_id", "text")
def keep_one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs whose doc_id is the id of their class.

    Rows with null text or id stay; rows alike in id and text stay or go
    together, and so do texts with the id of their class. Other columns of docs
    come through whatever their names.
    """
    classes = near_duplicate_classes(docs.select("doc_id", "text"), similar)
    gone = cut(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))
    keyed = docs.withColumn("_text", F.unhex(F.md5("text")))
    return keyed.join(if_small(gone), (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_node")), "left_anti").drop("_text")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("node")
