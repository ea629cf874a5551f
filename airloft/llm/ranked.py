"""Ranked lexical search by two trees, exact.

Documents and items are vectors over the items' terms: a document's coordinate
is the part of the score that its own term frequency and length give, an item's
is the term's weight times its occurrences. Both sides stand in trees whose
nodes hold the largest coordinates below them. The product of two nodes' vectors
bounds the score of every item with every document below them; if it does not
reach the weakest k-th score among the node's items, the whole batch is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, shared_folder, table
from .textnum import _LOWER, U, Texts, pieces

#: Letters and digits of ASCII, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Documents of a leaf, children of a node, item terms of one block of items, entries of an index that one tree holds.
LEAF, FAN, BLOCK_TERMS, TREE_ENTRIES = 16, 8, 1 << 15, 4_000_000
#: Scores are sums of whole numbers in doubles, exact below this; beyond it they are summed as integers.
EXACT = float(1 << 53)
LAST = np.iinfo(np.int64).max
#: Places of the first and last 8 bytes of a word inside a padded copy.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


class Vocabulary:
    """Terms in the order of their hashes; `find` gives the place of each word of some texts, or -1.

    A word is found by its hash and then compared in full: its length, its
    first and last 8 bytes, and what lies between them.
    """

    def __init__(self, terms: list[bytes]):
        t = _texts(terms)
        order = np.argsort(t.hashes, kind="stable")
        self.terms = [terms[i] for i in order]
        self.hashes = t.hashes[order]
        self.lens = np.array([len(x) for x in self.terms], np.int64)
        self.heads, self.tails = (x[order] for x in _ends(t))

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, t: Texts) -> np.ndarray:
        if not len(self) or not len(t.hashes):
            return np.full(len(t.hashes), -1)
        at = np.searchsorted(self.hashes, t.hashes)
        at[at == len(self)] = 0
        words = np.flatnonzero(self.hashes[at] == t.hashes)
        heads, tails = _ends(t, words)
        at_words = at[words]
        same = (self.lens[at_words] == (t.ends - t.starts)[words]) & (self.heads[at_words] == heads) & (self.tails[at_words] == tails)
        for i in np.flatnonzero(same & (self.lens[at_words] > 16)):
            w = words[i]
            same[i] = _LOWER[t.data[t.starts[w] : t.ends[w]]].tobytes() == self.terms[at_words[i]]
        out = np.full(len(t.hashes), -1)
        out[words[same]] = at_words[same]
        return out


def _texts(terms: list[bytes]) -> Texts:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(terms), np.uint8), offsets, True, _GAP)


def _ends(t: Texts, words=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The first and last 8 bytes of words in lower case, as numbers."""
    padded = np.concatenate([np.zeros(8, np.uint8), _LOWER[t.data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lens = np.minimum(t.ends[words] - t.starts[words], 8)
    shift = (8 * (8 - lens)).astype(U)
    return eight[t.starts[words] + 8] & _MASK[lens], eight[t.ends[words]] >> shift


def term_counts(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of terms; and row, place and count of each term of the vocabulary that it has."""
    n = np.zeros(len(column), np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = max(1, len(vocabulary))
    for rows, t in pieces(column, lower=True, blank=_GAP):
        np.add.at(n, rows, np.diff(t.first))
        found = vocabulary.find(t)
        hit = found >= 0
        k, c = np.unique(rows[t.owners()[hit]] * size + found[hit], return_counts=True)
        keys.append(k)
        counts.append(c)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))  # a row cut into pieces has a term in several
    counts = np.add.reduceat(counts, first) if len(first) else counts
    return n, keys[first] // size, keys[first] % size, counts


class Side:
    """A tree over sparse vectors: levels[0] are its leaves' maxima, one more level for each FAN nodes; a level is (first entry of each node, term, maximum)."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int):
        self.levels = []
        while True:
            key, order = owner * terms + term, None
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            value = np.maximum.reduceat(value[order], first) if len(first) else value
            owner, term = key[order][first] // terms, key[order][first] % terms
            nodes = int(owner[-1]) + 1 if len(owner) else 0
            self.levels.append((np.searchsorted(owner, np.arange(nodes + 1)), term, value))
            if nodes <= 1:
                return
            owner = owner // FAN

    def of(self, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        first, term, value = self.levels[level]
        return term[first[node] : first[node + 1]], value[first[node] : first[node + 1]]


class Items:
    """The items of a block: ids, vocabulary, and after `weigh` the tree of their weighted vectors.

    tree[0] has a dense row for each item, in an order that puts like items
    together; a row of tree[l + 1] is the maximum of FAN rows of tree[l].
    """

    def __init__(self, rows: pa.Table):
        """rows: (item_id, term, count)."""
        terms = sorted({x.encode() for x in rows["term"].to_pylist()})
        self.vocabulary = Vocabulary(terms)
        place = {x: i for i, x in enumerate(self.vocabulary.terms)}
        ids = rows["item_id"].to_pylist()
        self.ids = sorted(set(ids), key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.ids)}
        self.counts = np.zeros((len(self.ids), len(terms)))
        for i, t, c in zip(ids, rows["term"].to_pylist(), rows["count"].to_pylist()):
            self.counts[number[i], place[t.encode()]] = c
        self.tree: list[np.ndarray] = []

    def weigh(self, documents: int, having: np.ndarray) -> None:
        """documents: N; having: the number of documents that have each term."""
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in having.tolist()], np.float64)
        rows = self.counts * weights
        scale = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        near, left, order = scale @ scale.T, np.ones(len(rows), bool), []
        while left.any():  # groups of like items
            seed = int(np.flatnonzero(left)[0])
            group = np.argsort(np.where(left, -near[seed], np.inf), kind="stable")[: min(FAN, int(left.sum()))]
            order += group.tolist()
            left[group] = False
        self.ids = [self.ids[i] for i in order]
        self.counts, rows = self.counts[order], rows[order]
        self.whole = bool(rows.sum(axis=1).max(initial=0) * 1e6 >= EXACT)
        self.tree = [rows]
        while len(self.tree[-1]) > 1:
            last = self.tree[-1]
            self.tree.append(np.stack([last[i : i + FAN].max(axis=0) for i in range(0, len(last), FAN)]))
        self.weights = weights

    def scores(self, items: np.ndarray, terms: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Exact scores of some items with the documents of a block (terms x documents)."""
        q = self.tree[0][np.ix_(items, terms)]
        return q.astype(np.int64) @ block.astype(np.int64) if self.whole else (q @ block).astype(np.int64)


class Best:
    """The k best (score, document) of each item, in order; `floor` are the k-th that are known from elsewhere."""

    def __init__(self, items: int, k: int, floor: tuple[np.ndarray, np.ndarray] | None = None):
        self.score, self.doc = np.zeros((items, k), np.int64), np.full((items, k), LAST, np.int64)
        self.least, self.after = floor or (np.zeros(items, np.int64), np.full(items, -LAST, np.int64))
        self.least, self.after = self.least.copy(), self.after.copy()
        self.base = (self.least.copy(), self.after.copy())

    def take(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of documents with an item: those that come before or equal its k-th enter."""
        ok = (scores > self.least[item]) | ((scores == self.least[item]) & (docs <= self.after[item]) & (scores > 0))
        if not ok.any():
            return
        s, d = np.concatenate([self.score[item], scores[ok]]), np.concatenate([self.doc[item], docs[ok]])
        order = np.lexsort((d, -s))[: self.score.shape[1]]
        self.score[item], self.doc[item] = s[order], d[order]
        least, after = self.score[item, -1], self.doc[item, -1]
        if least > self.base[0][item] or (least == self.base[0][item] and least > 0 and after <= self.base[1][item]):
            self.least[item], self.after[item] = least, after


class Batch:
    """Documents of a batch as vectors, and their tree."""

    def __init__(self, items: Items, docs: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, length: int):
        size = 75 + 25 * n * documents // max(1, length)
        part = 1_000_000_000 * tf // (1000 * tf + 12 * size[row])
        merit = part * items.weights[term]
        best = np.zeros(len(docs))
        np.maximum.at(best, row, merit)
        top = np.zeros(len(docs), np.int64)
        is_best = merit == best[row]
        top[row[is_best]] = term[is_best]
        order = np.lexsort((-best, top))  # documents whose strongest term is the same stand together
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        self.docs = docs[order]
        at = np.argsort(place[row], kind="stable")
        self.owner, self.term, self.part = place[row][at], term[at], part[at].astype(np.float64)
        self.side = Side(self.owner // LEAF, self.term, self.part, max(1, len(items.vocabulary)))
        self.first = np.searchsorted(self.owner, np.arange(0, len(docs) + LEAF, LEAF))
        least = [np.minimum.reduceat(self.docs, np.arange(0, len(docs), LEAF)) if len(docs) else self.docs]
        for _ in self.side.levels[1:]:
            least.append(np.minimum.reduceat(least[-1], np.arange(0, len(least[-1]), FAN)))
        self.least_doc = least

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a leaf, its terms, and a dense block (terms x documents)."""
        a, b = self.first[k], self.first[k + 1]
        terms, place = np.unique(self.term[a:b], return_inverse=True)
        docs = self.docs[k * LEAF : (k + 1) * LEAF]
        block = np.zeros((len(terms), len(docs)))
        block[place, self.owner[a:b] - k * LEAF] = self.part[a:b]
        return docs, terms, block

    def probe(self, items: Items, best: Best) -> None:
        """Each item with the leaf that has its largest bound: first values of the k-th scores."""
        leaves = len(self.side.levels[0][0]) - 1
        most, where = np.zeros(len(items.ids)), np.full(len(items.ids), -1)
        for k in range(leaves):
            terms, value = self.side.of(0, k)
            bound = items.tree[0][:, terms] @ value
            where = np.where(bound > most, k, where)
            most = np.maximum(most, bound)
        for k in np.unique(where[where >= 0]):
            self._compare(items, best, int(k), np.flatnonzero(where == k))

    def _compare(self, items: Items, best: Best, k: int, these: np.ndarray) -> None:
        docs, terms, block = self.leaf(k)
        scores = items.scores(these, terms, block)
        for i in np.flatnonzero(scores.max(axis=1) >= np.maximum(best.least[these], 1)):
            best.take(int(these[i]), scores[i], docs)

    def search(self, items: Items, best: Best) -> int:
        """All pairs that the bounds leave; returns the number of leaves read."""
        if not len(self.docs) or not len(self.term) or not len(items.ids):
            return 0
        read, top = 0, len(self.side.levels) - 1
        stack = [(top, k, len(items.tree) - 1, np.arange(len(items.tree[-1])), np.inf) for k in range(len(self.side.levels[top][0]) - 1)]
        while stack:
            level, node, tier, these, _ = stack.pop()
            terms, value = self.side.of(level, node)
            these = self._alive(items, best, tier, these, terms, value, self.least_doc[level][node])
            if not len(these):
                continue
            if tier:  # down in both trees; the bounds of the children are theirs
                tier -= 1
                these = np.concatenate([np.arange(i * FAN, min((i + 1) * FAN, len(items.tree[tier]))) for i in these])
                if level == 0:
                    stack.append((level, node, tier, these, 0.0))
                    continue
            elif level == 0:
                read += 1
                self._compare(items, best, node, these)
                continue
            below = range(node * FAN, min((node + 1) * FAN, len(self.side.levels[level - 1][0]) - 1))
            queue = []
            for child in below:
                terms, value = self.side.of(level - 1, child)
                queue.append((level - 1, child, tier, these, float((items.tree[tier][np.ix_(these, terms)] @ value).max(initial=0))))
            stack += sorted(queue, key=lambda x: x[-1])  # the most promising child is taken first
        return read

    def _alive(self, items: Items, best: Best, tier: int, these: np.ndarray, terms: np.ndarray, value: np.ndarray, least_doc: int) -> np.ndarray:
        """Those of the item nodes whose bound with a document node reaches the weakest k-th score of their items."""
        bound = items.tree[tier][np.ix_(these, terms)] @ value
        span = FAN**tier
        at = np.arange(0, len(items.ids), span)
        weakest = np.minimum.reduceat(best.least, at)[these]
        after = np.maximum.reduceat(best.after, at)[these]
        if items.whole:
            bound = bound * (1 + 1e-9) + 1  # the double may be rounded
        return these[(bound > weakest) | ((bound == weakest) & (weakest > 0) & (least_doc <= after))]


def index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of rows (doc_id, text) with a term: its number of terms, and those of the vocabulary with their frequencies. Written as Parquet."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(held.value)
        for batch in batches:
            n, row, term, tf = term_counts(known, batch.column(1))
            first = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *arrays], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = shared_folder(docs.sparkSession, "terms")
    rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _walk(found: DataFrame, items: Items, documents: int, length: int, k: int, floor=None) -> DataFrame:
    """(item, score, doc_id) of each task's best documents: of one leaf an item without a floor, of all that reach the floor with one."""
    spark = found.sparkSession
    held = spark.sparkContext.broadcast((items, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = held.value
        best = Best(len(items.ids), k, floor)
        for batch in batches:
            docs, n, terms, tfs = batch.columns
            first, term, tf = np.asarray(terms.offsets, np.int64), np.asarray(terms.values, np.int64), np.asarray(tfs.values, np.int64)
            ids, n = np.asarray(docs.fill_null(LAST), np.int64), np.asarray(n, np.int64)
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(first, first[i] + TREE_ENTRIES, "right")) - 1)
                row = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                part = Batch(items, ids[i:j], n[i:j], row, term[first[i] : first[j]], tf[first[i] : first[j]], documents, length)
                part.search(items, best) if floor else part.probe(items, best)
                i = j
        item, _ = np.nonzero(best.score)
        score, doc = best.score[best.score > 0], best.doc[best.score > 0]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=doc == LAST)], ["item", "score", "doc_id"])

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, score long, doc_id long")


def _first(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best of docs (doc_id, text) for each of items (item_id, text): item_id, rank, doc_id, score.

    Every row of docs is a document, also one that repeats another or has no
    id (null ids come last among equal scores). Rows of items that share an id
    are one item with the terms of its different texts. Null, empty and
    termless texts are neither found nor find anything; empty tables give no
    rows. Other columns are not read. Items are taken in blocks of some 32,768
    terms (or one item, if it has more), against all documents each.
    """
    spark = docs.sparkSession
    words = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    words = words.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    words = cut(words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count")))
    blocks = max(1, math.ceil(words.count() / block_terms))
    out, totals = [], None
    for b in range(blocks):
        block = Items(words.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow())
        found = index(docs, block.vocabulary)
        if totals is None:
            totals = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        having = np.zeros(len(block.vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            having[r["t"]] = r["count"]
        block.weigh(totals[0], having)
        found = found.where(F.size("terms") > 0)
        seeds = _first(_walk(found, block, *totals, k), k).where(F.col("rank") == k).collect()  # a row an item of the block
        floor = (np.zeros(len(block.ids), np.int64), np.full(len(block.ids), -LAST, np.int64))
        for r in seeds:
            floor[0][r["item"]], floor[1][r["item"]] = r["score"], LAST if r["doc_id"] is None else r["doc_id"]
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        out.append(_first(_walk(found, block, *totals, k, floor), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH word AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), tfs AS (SELECT d, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc AS (SELECT d, sum(tf)::BIGINT AS n FROM tfs GROUP BY d),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM doc),
df AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
item AS (
  SELECT item_id, term, count(*)::BIGINT AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), scored AS (
  SELECT item_id, t.d, t.doc_id,
    sum(c * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // len)))))::BIGINT AS score
  FROM item JOIN tfs t USING (term) JOIN df USING (term) JOIN doc USING (d), total GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""
