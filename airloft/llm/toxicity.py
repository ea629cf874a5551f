"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are counted from labelled
documents. A class's pair of words backs off to the pair in both classes
scaled by the class's word, and a word to its share among the words of all
documents of the corpus. So what is rare in the sample is smoothed by counts
that both classes share. A text's score comes from the differences of its
log-likelihoods per word, calibrated on labelled texts that the models have
not seen: differences of each strength have a weight of their own, so many weak
ones, which samples of this size give by chance, do not bury a few strong ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, shielded, small_batches, table
from .textnum import U, Texts, slices

#: Labelled documents of each class that the models are fitted on; a bounded sample in order of a hash of doc_id.
PER_CLASS = 1500
#: Characters of a sampled text, and the pieces that are taken of a longer one.
TEXT_CHARS, PIECES = 65_536, 16
#: One in so many of them calibrates instead of being counted.
CALIBRATE = 4
#: The larger class is counted in up to so many parts of the smaller one's size; their models are averaged.
PARTS = 12
#: Absolute discounts to choose from by the loss on the calibrating texts.
DISCOUNTS = (0.75, 1.5, 3.0, 6.0, 12.0)
#: Strengths of evidence (differences of log-probabilities) that have weights of their own.
STRENGTHS = (0.0, 1.0, 2.0, 3.5)
CUT = 0.3
_START = U(0xA5A5A5A5A5A5A5A5)


def plain(text: Column) -> Column:
    """Lowered runs of letters and digits, separated by single spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def _before(ids: np.ndarray, t: Texts, start) -> np.ndarray:
    """The word before each, `start` for the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[t.first[:-1][np.diff(t.first) > 0]] = start
    return out


@dataclass
class Model:
    """Differences of log-probabilities, toxic less ordinary.

    words: sorted hashes of the words of the sample; word i has number i, any
    other len(words), and len(words) + 1 stands before a text. by_word and
    by_context go by number and add up for a pair that by_pair, by the sorted
    before * width + word, has not.
    """

    words: np.ndarray
    by_word: np.ndarray
    by_context: np.ndarray
    pairs: np.ndarray
    by_pair: np.ndarray
    weights: np.ndarray | None = None

    def features(self, t: Texts) -> np.ndarray:
        """Of each text: a constant, the log of its length, and by strength its evidence per word and per root of the length."""
        n = np.maximum(np.diff(t.first), 1)
        value = np.zeros(len(t.hashes))
        if len(value):
            word = _numbers(self.words, t.hashes)
            before = _before(word, t, len(self.words) + 1)
            value = self.by_word[word] + self.by_context[before]
            if len(self.pairs):
                key = before * (len(self.words) + 2) + word
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                found = self.pairs[at] == key
                value[found] = self.by_pair[at[found]]
        strength, owner = np.digitize(np.abs(value), STRENGTHS) - 1, t.owners()
        out = [np.ones(len(n)), np.log(n)]
        for k in range(len(STRENGTHS)):
            sums = np.bincount(owner, np.where(strength == k, value, 0.0), minlength=len(t))
            out += [sums / n, sums / np.sqrt(n)]
        return np.stack(out, axis=1)

    def scores(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(t) @ self.weights, -40, 40)))


def _numbers(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(words, hashes)
    known = np.append(words, U(0))[at] == hashes
    return np.where(known & (at < len(words)), at, len(words))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The bounded sample: (doc_id, toxic, text), up to per_class documents of each class, without held-out ids.

    An id that is labelled both ways counts as toxic. With labels of one class
    only, that class is sampled alone. Of rows that share an id the text with
    the smallest hash counts, and of a text of more than TEXT_CHARS characters
    PIECES spaced evenly over it, so the sample is bounded in rows and bytes.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda c: marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(first(0).union(first(1))), "doc_id")
    size = TEXT_CHARS // PIECES
    at = lambda i: F.floor(F.length("text").cast("long") * i / PIECES).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", at(i), F.lit(size))), " ")
    bounded = rows.select("doc_id", "toxic", F.xxhash64("text").alias("_h"), F.when(F.length("text") <= TEXT_CHARS, F.col("text")).otherwise(spread).alias("text"))
    return bounded.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct("_h", "text")).alias("text")).select("doc_id", "text", "toxic")


def sample_counts(sample: DataFrame) -> tuple[pa.Table, pa.Table]:
    """Of rows (part, text): (part, v, n) by word and (part, u, v, n) by pair of words (hashes); a different text counts at most once.

    A text counts for a word if it has it after a word that no earlier text
    (by hash) of the part has before it, and for a pair likewise: such counts
    of new contexts keep copied texts from passing for common expressions.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, text = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, t in slices(batch.column(2)):
                v = t.hashes
                u = _before(v, t, _START)
                own = t.owners()
                columns = [pa.array(part[i:j][own]), pa.array(text[i:j][own]), *(pa.array(x.view(np.int64)) for x in (_before(u, t, _START), u, v))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "d", "t", "u", "v"])

    seen = sample.select("part", F.xxhash64("text").alias("d"), "text").mapInArrow(read, "part int, d long, t long, u long, v long")
    triples = seen.groupBy("part", "t", "u", "v").agg(F.min("d").alias("d"))
    pairs = triples.groupBy("part", "u", "v").agg(F.count_distinct("d").alias("n"))
    words = triples.groupBy("part", "u", "v").agg(F.min("d").alias("d")).groupBy("part", "v").agg(F.count_distinct("d").alias("n"))
    return words.toArrow(), pairs.toArrow()


def shared_counts(texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, float]:
    """Documents of the corpus (text) that have each of the sorted words, and the sum over all words that there are."""
    held = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        total, every = np.zeros(len(wanted) + 1, np.int64), 0
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                word, own = _numbers(wanted, t.hashes), t.owners()
                known = word < len(wanted)
                once = np.unique(own[known] * len(wanted) + word[known])
                total += np.bincount(once % max(1, len(wanted)), minlength=len(wanted) + 1)
                rest = own[~known].astype(U) * U(0x9E3779B97F4A7C15) + t.hashes[~known]
                every += len(once) + len(np.unique(rest))
        total[-1] = every
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["k", "n"])

    rows = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1)
    out[np.asarray(rows["k"])] = np.asarray(rows["n"])
    return out[:-1], out[-1]


@dataclass
class Counts:
    """What the models are made of: counts by part of the sample, with words and pairs by number, and shared shares of words."""

    words: np.ndarray
    shared: np.ndarray
    keys: np.ndarray
    by_part: dict

    def tables(self, parts, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities of words, of backing off after a word, and of the pairs `keys`; means over the models of the parts."""
        width = len(self.words) + 2
        pu, pv = self.keys // width, self.keys % width
        everything = [self.by_part[p] for p in sorted(self.by_part)]
        pooled, back = self._kept(sum(n for _, n in everything), pu, width, discount)
        pooled = pooled + back[pu] * self.shared[pv]
        logs = []
        for p in parts:
            of_word, of_pair = self.by_part[p]
            kept = np.maximum(of_word - discount, 0) / max(1.0, of_word.sum())
            word = kept + (1 - kept.sum()) * self.shared
            kept, back = self._kept(of_pair, pu, width, discount)
            logs.append([np.log(word), np.log(back), np.log(kept + back[pu] * pooled * word[pv] / self.shared[pv])])
        return tuple(np.mean(x, axis=0) for x in zip(*logs))

    @staticmethod
    def _kept(n: np.ndarray, context: np.ndarray, width: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Discounted shares of pairs after their first word, and what is left for backing off."""
        total = np.maximum(np.bincount(context, n, minlength=width), 1)
        kept = np.maximum(n - discount, 0) / total[context]
        return kept, np.maximum(1 - np.bincount(context, kept, minlength=width), 1e-9)


def count_sample(sample: DataFrame, texts: DataFrame) -> tuple[Counts, list[list[int]]]:
    """Counts of rows (toxic, h, text) and of the whole corpus (text), and the parts of each class.

    The sample is bounded, so its counts come to the driver; of the corpus come
    the counts of the sample's words.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    least = max(1, min(sizes.values(), default=1)) if len(sizes) > 1 else max(1, *sizes.values(), 1)
    n = [max(1, min(PARTS, round(sizes.get(c, 0) / least))) for c in (0, 1)]
    split = F.when(F.col("toxic") == 0, F.pmod("h", F.lit(n[0]))).otherwise(n[0] + F.pmod("h", F.lit(n[1]))).cast("int")
    by_word, by_pair = sample_counts(sample.select(split.alias("part"), "text"))
    words = np.unique(np.asarray(by_word["v"]).view(U))
    width = len(words) + 2
    shared, total = shared_counts(texts, words)
    shared = np.append(shared + 0.5, (0.5, 0.5)) / (total + 0.5 * width)
    u, v = (np.asarray(by_pair[c]).view(U) for c in ("u", "v"))
    keys, place = np.unique(np.where(u == _START, len(words) + 1, _numbers(words, u)) * width + _numbers(words, v), return_inverse=True)
    part, pair_part = np.asarray(by_word["part"]), np.asarray(by_pair["part"])
    number, count, pair_count = _numbers(words, np.asarray(by_word["v"]).view(U)), np.asarray(by_word["n"]), np.asarray(by_pair["n"])
    by_part = {}
    for p in range(sum(n)):
        a, b = part == p, pair_part == p
        by_part[p] = (np.bincount(number[a], count[a], minlength=width), np.bincount(place[b], pair_count[b], minlength=len(keys)))
    return Counts(words, shared, keys, by_part), [list(range(n[0])), list(range(n[0], sum(n)))]


def fit_model(counts: Counts, parts: list[list[int]], discount: float) -> Model:
    """Differences of the classes' models; pairs that no part has more often than the discount need no entry."""
    ordinary, toxic = (counts.tables(p, discount) for p in parts)
    by_word, by_context, by_pair = (t - o for o, t in zip(ordinary, toxic))
    told = np.max([n for _, n in counts.by_part.values()], axis=0) > discount if len(counts.keys) else np.zeros(0, bool)
    return Model(counts.words, by_word.astype(np.float32), by_context.astype(np.float32), counts.keys[told], by_pair[told].astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weighted logistic regression and its mean loss; the first column is constant and not penalised, the others are in deviations."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = x / scale
    b, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ b)
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
    return b / scale, float(-(w * np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12))).sum() / w.sum())


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A calibrated model; with no labels of one class every score is that class's share.

    The discount is the one of DISCOUNTS whose calibrated model has the least loss.
    """
    small_batches(docs.sparkSession)
    h = F.xxhash64(F.lit(3), "doc_id")
    texts = docs.select(plain(F.col("text")).alias("text"))
    sample = labelled(docs, labels, per_class).select("toxic", plain(F.col("text")).alias("text"), F.shiftrightunsigned(h, 8).alias("h"), (F.pmod(h, F.lit(CALIBRATE)) == 0).alias("later"))
    later = sample.where("later").select("toxic", "text").toArrow()
    y = np.asarray(later["toxic"].combine_chunks() if later.num_rows else pa.array([], pa.int32())).astype(np.float64)
    seen = [t for _, _, t in slices(later["text"])] if later.num_rows else []
    row = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic").alias("p")).first()
    share = 0.5 if row["p"] is None else float(row["p"])
    width = 2 + 2 * len(STRENGTHS)
    if not 0 < y.sum() < len(y):
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        none, zero = np.zeros(0, np.int64), np.zeros(2, np.float32)
        return Model(np.zeros(0, U), zero, zero, none, np.zeros(0, np.float32), np.array([np.log(odds / (1 - odds)), *[0.0] * (width - 1)]))
    counts, parts = count_sample(sample.where("NOT later"), texts)
    # The sample may have other shares of the classes than the labels; weights restore them.
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    best, least = None, np.inf
    for discount in DISCOUNTS:
        model = fit_model(counts, parts, discount)
        model.weights, loss = _logistic(np.concatenate([model.features(t) for t in seen]), y, w)
        if loss < least:
            best, least = model, loss
    return best


@shielded("text")
def score_toxicity(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """docs (text, ...) with score from 0 to 1; without text if it is not asked for.

    Null and empty texts get the score of no evidence, equal texts equal
    scores. Texts of any length are read whole, in slices of rows. A column
    score is replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs if with_text else docs.drop("text")
    rows = docs.select(*kept.columns, plain(F.col("text")).alias("_plain"))
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in batches:
            found = [model.scores(t) for _, _, t in slices(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found) if found else [], pa.float64())], [*batch.schema.names[:-1], "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    scored = score_toxicity(marked, train(docs, labels), with_text=False)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
