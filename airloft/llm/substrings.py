"""Substring dedup by super-k-mer partitioning.

A window is a run of 20 words. Consecutive windows that share a minimiser (the
least hash of their runs of 4 words) travel as one packed string to the bucket
of that minimiser, where windows are sorted; equal windows meet there, and all
but the earliest are marked. Words under a marked window are removed.

Three things keep buckets even. Windows that repeat within one slice of a
task's input are marked there, so a passage found everywhere sends one string a
slice. Runs of words that are frequent in slices are avoided as minimisers, so
the windows that straddle such a passage go to the buckets of their rare
neighbours. And a window that has no other run goes by its own hash to one of
several salted buckets, whose survivors meet in a second round: with s slices
either round brings together about the root of s strings of one window. The list
of frequent runs decides only where windows meet, never which are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shielded, table
from .textnum import U, Texts, grams, joined_words, mix, slices

WINDOW = 20
MINIMISER = 4
#: Bytes of packed strings that a bucket should hold, and a shuffled partition; partitions at most, which then hold more buckets.
BUCKET_BYTES, PARTITION_BYTES, PARTITIONS = 8 << 20, 24 << 20, 50_000
#: Text that is searched for repeats before anything travels.
PIECE_BYTES = 4 << 20
#: A run of MINIMISER words is frequent if a piece holds it so often; so many of the most frequent are avoided.
OFTEN, AVOIDED = 8, 65_536
#: Level of zstd for packed strings, which are most of what is shuffled.
LEVEL = 6
#: Slots (bits) of the table that tells which texts may have removed ranges; the others need not be shuffled.
SLOT_BITS = 26
_TOP = U(1 << 63)
_FORM = "bucket long, size long, blob binary"
#: Ranges have bucket -1; strings that go on to a second round have theirs.
_FOUND = "bucket long, id long, th long, start long, n long, size long, blob binary"


def _frequent(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in slices(batch.column(0), most=PIECE_BYTES):
                h, n = np.unique(grams(t, MINIMISER)[0], return_counts=True)
                ok = n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(n[ok], pa.int64())], ["h", "n"])

    top = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(AVOIDED)
    return np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64).view(U))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    out, span = x, 1
    while span < n:
        step = min(span, n - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def _equal_before(words: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of windows in order of precedence, those whose words equal an earlier window's; at: their first words."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1]) + 1
    now, prior = order[same], order[same - 1]
    equal = np.ones(len(now), bool)
    for k in range(WINDOW):
        equal &= words[at[now] + k] == words[at[prior] + k]
    out = np.zeros(len(h), bool)
    out[now[equal]] = True
    return out


def _packed(bucket: int, did: np.ndarray, th: np.ndarray, pos: np.ndarray, lens: np.ndarray, strings: bytes) -> tuple[int, int, bytes]:
    blob = b"".join([np.array([len(did)], np.int64).tobytes(), did.tobytes(), th.tobytes(), pos.astype(np.int64).tobytes(), lens.astype(np.int64).tobytes(), strings])
    return bucket, len(blob), pa.Codec("zstd", compression_level=LEVEL).compress(blob, asbytes=True)


def _unpacked(size: int, blob: bytes):
    data = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    did, th, pos, lens = np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n)
    return did, th, pos, lens, data[8 + 32 * n :]


def _runs(did: np.ndarray, th: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Starts of runs of consecutive positions in one text."""
    return np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + 1)])) if len(did) else np.zeros(0, np.int64)


def _scatter(texts: DataFrame, buckets: int, salts: int, avoid) -> DataFrame:
    """Packed super-k-mers by bucket (those to be salted under -1 - bucket - buckets * salt) and ranges already marked, all as _FOUND."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        avoided, piece = avoid.value, TaskContext.get().partitionId()
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).max))
            ths = np.asarray(batch.column(1))
            order = np.lexsort((ths, ids))
            first = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(ths[order]) != 0)])
            order = order[first]  # rows alike in id and text count once; those of other batches meet in the buckets
            ids, ths, column = ids[order], ths[order], batch.column(2).take(pa.array(order))
            for i, j, t in slices(column, most=PIECE_BYTES):
                out = list(_piece(t, ids[i:j], ths[i:j], buckets, piece % salts, avoided))
                piece += 7919
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "size", "blob"])

    return texts.select("id", "th", "text").mapInArrow(send, _FORM)


def _piece(t: Texts, ids: np.ndarray, ths: np.ndarray, buckets: int, salt: int, avoided: np.ndarray):
    h, own, at = grams(t, WINDOW)
    if not len(h):
        return
    pos = at - t.first[own]
    marked = _equal_before(t.hashes, at, h)
    if marked.any():
        d, e, p = ids[own[marked]], ths[own[marked]], pos[marked]
        new = _runs(d, e, p)
        yield _packed(int(mix(ths[:1].view(U))[0] % U(buckets)), d[new], e[new], p[new], -np.diff(np.append(new, len(d))), b"")
    w = t.hashes
    small = np.zeros(len(w) - MINIMISER + 1, U)
    for k in range(MINIMISER):
        small = small * U(0x9E3779B97F4A7C15) + w[k : len(w) - MINIMISER + 1 + k]
    small = mix(small)
    if len(avoided):
        near = np.minimum(np.searchsorted(avoided, small), len(avoided) - 1)
        often = avoided[near] == small
        small = np.where(often, small | _TOP, small & ~_TOP)
    else:
        small &= ~_TOP
    least = _least(small, WINDOW - MINIMISER + 1)[at]
    salted = least & _TOP != 0
    least = np.where(salted, h, least)
    sent = np.flatnonzero(~marked)
    if not len(sent):
        return
    least, salted, own, pos, at = least[sent], salted[sent], own[sent], pos[sent], at[sent]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.append(new, len(sent)))
    data, begin = joined_words(t)
    text = data.tobytes()
    a, b = begin[at[new]], begin[at[new] + n + WINDOW - 1] - 1
    bucket = (mix(least[new]) % U(buckets)).astype(np.int64)
    bucket = np.where(salted[new], -1 - bucket - buckets * salt, bucket)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        k = order[lo:hi]
        strings = b" ".join([text[x:y] for x, y in zip(a[k].tolist(), b[k].tolist())])
        yield _packed(int(bucket[k[0]]), ids[own[new[k]]], ths[own[new[k]]], pos[new[k]], n[k], strings)


def _gather(buckets: int):
    """A function of the packed rows of one bucket: the ranges of marked windows, and of a salted bucket the windows that are left."""

    def settle(part: pa.Table) -> pa.Table:
        dids, thss, poss, words, lens, texts = [], [], [], [], [], []
        found = [(np.zeros(0, np.int64),) * 4]
        key = part["bucket"][0].as_py()
        for size, blob in zip(part["size"].to_pylist(), part["blob"].to_pylist()):
            did, th, pos, n, strings = _unpacked(size, blob)
            if len(n) and n[0] < 0:
                found.append((did, th, pos, -n))
                continue
            words.extend(t.hashes for _, _, t in slices(pa.array([strings], pa.large_binary()).cast(pa.large_string(), safe=False)))
            dids.append(did), thss.append(th), poss.append(pos), lens.append(n)
            if key < 0:
                texts += strings.split(b" ")
        left = []
        if dids:
            did, th, pos, n, w = (np.concatenate(x) for x in (dids, thss, poss, lens, words))
            base = np.concatenate([[0], np.cumsum(n + WINDOW - 1)])[:-1]  # first word of each string
            string = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
            did, th, pos, at = did[string], th[string], pos[string] + step, base[string] + step
            order = np.lexsort((pos, th, did))
            did, th, pos, at = did[order], th[order], pos[order], at[order]
            # The same window of a row that occurs in several slices is judged once.
            once = np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1])])
            did, th, pos, at = did[once], th[once], pos[once], at[once]
            h = np.zeros(len(at), U)
            for k in range(WINDOW):
                h = h * U(0x9E3779B97F4A7C15) + w[at + k]
            marked = _equal_before(w, at, mix(h))
            d, e, p = did[marked], th[marked], pos[marked]
            new = _runs(d, e, p)
            found.append((d[new], e[new], p[new], np.diff(np.append(new, len(d)))))
            if key < 0:
                rest = np.flatnonzero(~marked)
                strings = b" ".join([b" ".join(texts[a : a + WINDOW]) for a in at[rest].tolist()])
                left.append(_packed((-1 - key) % buckets, did[rest], th[rest], pos[rest], np.ones(len(rest), np.int64), strings))
        did, th, pos, n = (np.concatenate(x) for x in zip(*found))
        none = [None] * len(did)
        return pa.table(
            {
                "bucket": pa.array([-1] * len(did) + [x[0] for x in left], pa.int64()),
                **{c: pa.array(x.tolist() + [None] * len(left), pa.int64()) for c, x in zip(("id", "th", "start", "n"), (did, th, pos, n))},
                "size": pa.array(none + [x[1] for x in left], pa.int64()),
                "blob": pa.array(none + [x[2] for x in left], pa.binary()),
            }
        )

    return settle


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        starts, counts = batch.column(names.index("starts")), batch.column(names.index("counts"))
        for i, j, t in slices(batch.column(names.index("text"))):
            s, c = starts.slice(i, j - i), counts.slice(i, j - i)
            row = np.repeat(np.arange(j - i), np.asarray(s.fill_null([]).value_lengths()))
            begin = np.asarray(s.flatten()) + t.first[row]
            delta = np.bincount(begin, minlength=len(t.hashes) + 1) - np.bincount(begin + np.asarray(c.flatten()) + WINDOW - 1, minlength=len(t.hashes) + 1)
            kept = np.cumsum(delta)[: len(t.hashes)] == 0
            upto = np.concatenate([[0], np.cumsum(kept)])[t.first]
            data, at = joined_words(t, kept)
            lo, hi = at[upto[:-1]], np.maximum(at[upto[1:]] - 1, at[upto[:-1]])  # no space after the last word
            text = data.tobytes()
            texts = [text[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist())]
            total = np.diff(t.first)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k, c in enumerate(names) if c not in ("starts", "counts")), pa.array(total, pa.int64()), pa.array(total - np.diff(upto), pa.int64()), pa.array(texts, pa.string())],
                [*(c for c in names if c not in ("starts", "counts")), "n_words", "n_removed", "kept_text"],
            )


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, th, starts, counts): by text (doc_id, hash of the text) the runs of windows that start earlier elsewhere."""
    spark = docs.sparkSession
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    held = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]) * 7 // 2
    buckets = max(8, -(-held // BUCKET_BYTES))
    partitions = min(PARTITIONS, max(8, -(-held // PARTITION_BYTES)))
    salts = max(1, round((held / PIECE_BYTES) ** 0.5))
    avoid = spark.sparkContext.broadcast(_frequent(texts))
    sent = _scatter(texts, buckets, salts, avoid).repartition(partitions, "bucket")
    # Both rounds' rows are few beside the strings; the written table serves the second round and the ranges.
    first = cut(sent.groupBy("bucket").applyInArrow(_gather(buckets), _FOUND))
    second = first.where("blob IS NOT NULL").select("bucket", "size", "blob").groupBy("bucket").applyInArrow(_gather(buckets), _FOUND)
    ranges = first.where("blob IS NULL").select("id", "th", "start", "n").union(second.select("id", "th", "start", "n"))
    return ranges.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("r")).select("id", "th", F.col("r.start").alias("starts"), F.col("r.n").alias("counts"))


def _slots_of(ranges: DataFrame) -> np.ndarray:
    """The table of bits: a set one for the slot of every text that has ranges."""
    rows = ranges.select(_slot().alias("s")).groupBy(F.expr("s DIV 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("b")).toArrow()
    bits = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    bits[np.asarray(rows["w"])] = np.asarray(rows["b"])
    return bits


def _slot():
    return F.pmod(F.xxhash64("id", "th"), F.lit(1 << SLOT_BITS))


def _only(bits, known: bool):
    """Passes on the rows, without their last column (the slot), whose bit is set or is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.asarray(batch.column(batch.num_columns - 1))
            part = batch.filter(pa.array(((bits.value[s >> 6] >> (s & 63)) & 1 == 1) == known))
            yield part.select(part.schema.names[:-1])

    return run


@shielded("doc_id", "text")
def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept_text.

    Words are runs of other than ASCII white space, unchanged. A word goes if
    a window over it starts earlier too: in a smaller doc_id, or in the same
    document before. Windows are judged on the input. Null text has no words.
    Null doc_ids come last; rows of one doc_id with different texts are
    ordered by a hash of the text, rows alike in both are judged once and get
    one result, whichever partitions they are in. A text of any length is read
    whole; only its own words and ranges are held with it. Columns of docs with
    the added names are replaced.
    """
    ranges = cut(repeated_ranges(docs.select("doc_id", "text")))
    bits = docs.sparkSession.sparkContext.broadcast(_slots_of(ranges))
    keyed = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))
    slotted = keyed.select("*", _slot().alias("_slot"))
    form = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = form(docs) + ", n_words long, n_removed long, kept_text string"
    # Texts that have ranges travel to them; the others stay where they are.
    travel = slotted.mapInArrow(_only(bits, True), form(keyed)).join(ranges.hint("shuffle_hash"), ["id", "th"], "left").drop("id", "th").mapInArrow(_strip, out)
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("starts", "counts")]
    others = _only(bits, False)
    return travel.union(slotted.select(*docs.columns, *none, "_slot").mapInArrow(lambda batches: _strip(others(batches)), out))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return strip_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM d WHERE len(ws) >= 20),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS h FROM w),
m AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM m WHERE k > 1),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM d),
f AS (SELECT e.doc_id, count(*) AS n_words, count(g.q) AS n_removed, string_agg(e.w, ' ' ORDER BY e.q) FILTER (WHERE g.q IS NULL) AS kept
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY 1)
SELECT d.doc_id, coalesce(f.n_words, 0) AS n_words, coalesce(f.n_removed, 0) AS n_removed, sha256(coalesce(f.kept, '')) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
"""
