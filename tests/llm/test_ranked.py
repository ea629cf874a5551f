"""Ranked search and clusters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airloft.llm import orchard, ranked, textnum

from test_llm import odd_documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k=20):
    """docs: (doc_id, text) rows; items: id to set of texts."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, texts in items.items():
        want = Counter(t for text in texts for t in terms(text))
        found = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in want.items() if t in bag)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(found[:k])]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_terms", [ranked.BLOCK_TERMS, 40])
def test_search_equals_brute_force(spark, block_terms, monkeypatch):
    rng = random.Random(block_terms)
    docs = [(i, prose(rng, rng.randrange(1, 80), 300)) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000, "Éa é-É_9 " * 3), (2001, None), (2002, ""), (2003, "!?"), (None, docs[7][1])]
    items = {i: {prose(rng, rng.randrange(1, 40), 300)} for i in range(30)} | {30: {docs[7][1]}, 31: {"É, 9"}, 32: {"absent"}, 33: {"w1 w2", "w2 W3"}}
    rows = [(i, t) for i, texts in items.items() for t in texts] + [(34, None), (35, "?!"), (30, docs[7][1])]
    monkeypatch.setattr(ranked, "TREE_ENTRIES", 3000)
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(rows, "item_id long, text string"), block_terms=block_terms)
    assert collected(got) == ranking(docs, items)


def tree_of(rng, count, shares):
    """Items and a batch of documents of several vocabularies."""
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(2)) for _ in range(0)]
    for i in range(count):
        c = "abcdefgh"[i % shares]
        texts.append(" ".join(f"{c}{int(rng.random() ** 2 * 4000)}" for _ in range(60)))
    questions = [(i, t, c) for i in range(24) for t, c in Counter(rng.choice(texts).split()[:12]).items()]
    items = ranked.Items(pa.table({"item_id": [q[0] for q in questions], "term": [q[1] for q in questions], "count": [q[2] for q in questions]}))
    n, row, term, tf = ranked.term_counts(items.vocabulary, pa.array(texts))
    items.weigh(count, np.bincount(term, minlength=len(items.vocabulary)))
    return items, ranked.Batch(items, np.arange(count), n, row, term, tf, count, int(n.sum()))


def test_bounds_prune_batches():
    items, batch = tree_of(random.Random(4), 4000, 8)
    first = ranked.Best(len(items.ids), 20)
    batch.search(items, first)
    floor = (first.score[:, -1].copy(), first.doc[:, -1].copy())
    again = ranked.Best(len(items.ids), 20, floor)
    read = batch.search(items, again)
    assert (again.score == first.score).all() and (again.doc == first.doc).all()
    assert read < 4000 / ranked.LEAF  # some leaves are never read
    probed = ranked.Best(len(items.ids), 20)
    batch.probe(items, probed)
    assert (probed.score[:, -1] <= first.score[:, -1]).all() and (probed.score[:, 0] > 0).all()


def test_scores_beyond_doubles_are_whole_numbers():
    items, batch = tree_of(random.Random(6), 300, 2)
    small = ranked.Best(len(items.ids), 20)
    batch.search(items, small)
    items.counts = items.counts * 2**22
    items.weigh(300, np.bincount(batch.term, minlength=len(items.vocabulary)))
    assert items.whole
    large = ranked.Best(len(items.ids), 20)
    batch.search(items, large)
    assert (np.sort(large.score, axis=None) == np.sort(small.score * 2**22, axis=None)).all()


def test_terms_are_compared_in_full():
    known = ranked.Vocabulary([b"abcdefghijklmnopqrstuvwxyz", b"ab", "é9".encode()])
    t = ranked._texts([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmNopqrstuvwxyz", b"abcdefghijklm-opqrstuvwxyz", b"ab", b"abc", "É9 é9".encode()])
    found = [known.terms[i].decode() if i >= 0 else None for i in known.find(t)]
    assert found == ["abcdefghijklmnopqrstuvwxyz"] * 2 + [None, None, "ab", None, None, "é9"]
    known.hashes = np.full(3, t.hashes[4])  # as if all had the hash of abc
    assert known.find(t).tolist() == [-1] * len(t.hashes)


def test_pieces_of_long_rows():
    text = " ".join(f"w{i}" for i in range(5000))
    rows, words = [], 0
    for r, t in textnum.pieces(pa.array(["a b", None, text, "x" * 9000, "c"]), most=1000):
        rows += np.repeat(r, np.diff(t.first)).tolist()
        words += len(t.hashes)
    assert words == 5000 + 4 and rows == sorted(rows) and Counter(rows) == {0: 2, 2: 5000, 3: 1, 4: 1}


def test_search_of_odd_input(spark):
    docs = odd_documents(spark).withColumns({"item_id": F.lit("x"), "rank": F.lit("y")})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame([(1, rows[0][1]), (None, "one w3"), (2, "")], "item_id long, text string")
    assert collected(ranked.search(docs, items)) == ranking(rows, {1: {rows[0][1]}, None: {"one w3"}})
    assert ranked.search(docs.where("false"), items).count() == 0
    assert ranked.search(docs, items.where("false")).count() == 0


def clusters(rows, k=40, rounds=5, width=64):
    """rows: (vec_id, list)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    first = sorted((i is None, digest(i) if i is not None else "", v) for i, v in kept)[:k]
    centroids = [list(v) for _, _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    own = Counter()
    for d, j in at:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("count", [0, 1, 3, 300])
def test_clusters_equal_brute_force(spark, count):
    rng = random.Random(count)
    rows = [(i, [rng.choice([-1, 0, 0.5, 1]) * rng.random() ** 4 + (i % 5) * 0.3 for _ in range(8)]) for i in range(count)]
    rows += rows[:1] * 3 + [(None, [0.1] * 8), (5, [0.1] * 8), (6, None), (7, [0.1] * 7), (8, [0.1] * 9), (9, [0.1] * 7 + [None]), (10, [math.nan] * 8), (11, [math.inf] + [0.0] * 7), (9012, [1e300] * 8)]
    want = clusters([r for r in rows if r[0] != 9012], k=12, rounds=3, width=8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    got = orchard.cluster(df, k=12, rounds=3, width=8)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
    assert orchard.cluster(df.where("false")).count() == 0 and orchard.cluster(df.where("false")).columns == COLUMNS


def test_orchard_measures_few_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(40, 16))
    x = centres[rng.integers(40, size=2000)] + rng.integers(-100, 100, size=(2000, 16))
    at, d, measured = orchard.Lists(centres).nearest(x)
    every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert measured < 0.5 * 2000 * 40


def test_orchard_ties_go_to_the_first_centroid():
    rng = np.random.default_rng(3)
    for _ in range(20):
        centres = rng.integers(-3, 3, size=(12, 2))
        x = rng.integers(-4, 4, size=(200, 2))
        every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (orchard.Lists(centres).nearest(x)[0] == every.argmin(axis=1)).all()
