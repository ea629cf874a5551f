"""The training-data operators against brute force and on odd input."""

import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airloft.llm import decontaminate, langid, licences, lines, media, mixing, neardup, queries, sharding, substrings, textnum, toxicity
from airloft.llm.common import held_out

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids used twice, extra columns with clashing names."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    base = prose(rng, 60)
    rows = [
        (1, base, "en", "s1", 1), (1, base, "en", "s1", 1), (2, base, None, None, None), (2, prose(rng, 40), "fr", "s2", 2),
        (3, None, None, "s1", None), (None, base, "en", "s2", 3), (None, None, None, None, None), (4, "", "de", "s1", 0),
        (5, " \n\t\n ", "en", "s3", 4), (6, long, "en", "s1", 5), (7, long + " end", "en", "s1", 5), (8, "one", "en", "s2", 3),
    ]
    extra = ["_row", "_key", "size", "shard", "slot", "score", "copies", "node", "kept_text", "_t1", "digest", "overlap", "id", "th", "lang_pred", "media"]
    df = spark.createDataFrame(rows, FORM)
    return df.withColumns({c: F.lit(c) for c in extra})


def test_words_and_hashes():
    texts = ["a bb\tccc", "", None, "bb", " x  y z ", "A BB"]
    (_, _, t), *rest = textnum.slices(pa.array(texts), lower=True)
    assert not rest
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(t.starts[t.first[i] : t.first[i + 1]], t.ends[t.first[i] : t.first[i + 1]])] for i in range(len(texts))]
    assert got == [WORD.findall(x or "") for x in texts]
    h = t.hashes[t.first[0] : t.first[1]]
    assert h[1] == t.hashes[t.first[3]] and h[0] == t.hashes[t.first[5]] and len(set(h.tolist())) == 3
    parts = list(textnum.slices(pa.array(["x y"] * 10), most=4))
    assert [p[:2] for p in parts] == [(i, i + 1) for i in range(10)]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    order = [[d[0] for d in want.description].index(c) for c in names]
    tidy = lambda row: [float(f"{v:.9g}") if isinstance(v, float) else v for v in row]
    a = sorted((tidy([r[c] for c in names]) for r in got.collect()), key=repr)
    b = sorted((tidy([r[i] for i in order]) for r in want.fetchall()), key=repr)
    assert a == b


# 1


def plant(rng, passage, swaps):
    words = passage.split()
    for i in rng.sample(range(len(words)), swaps):
        words[i] = "zzz"
    return prose(rng, 50) + " " + " ".join(words) + ". " + prose(rng, 50)


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(rng.randint(14, 50)))) for i in range(20)] + [(90, "too short"), (91, None), (0, "b1 b2")]
    docs, expected = [], {}
    for i, text in items[:20]:
        n = len(text.split())
        docs.append((i, plant(rng, text, n // 8)))
        expected[i] = i
    expected[202] = 0  # the whole of a short item
    docs += [(100 + i, prose(rng, 120)) for i in range(20)] + [(200, None), (201, ""), (202, "b1 b2"), (0, docs[0][1])]
    # A text that shares half of an item's words, but never more than a few in place.
    docs.append((300, " ".join(w if i % 2 else "q" for i, w in enumerate(items[3][1].split()))))
    got = decontaminate.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["item_id"] for r in got if r["contaminated"]} == expected
    assert all(r["overlap"] >= 0.8 for r in got if r["contaminated"])


def leaks_by_brute_force(text, item):
    """The rule itself: of all alignments, 80 % of the item in place, or a segment of 13 at +1 and -4."""
    for shift in range(1 - len(item), len(text)):
        same = [0 <= shift + i < len(text) and text[shift + i] == w for i, w in enumerate(item)]
        run = best = 0
        for x, i in zip(same, range(len(item))):
            if 0 <= shift + i < len(text):
                run = max(0, run + (1 if x else -4))
                best = max(best, run)
        if sum(same) >= decontaminate.SIMILAR * len(item) - 1e-9 or best >= decontaminate.SEGMENT:
            return True
    return False


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    items = {n: [f"i{n}x{rng.randrange(40)}" for _ in range(n)] for n in range(1, 61)}
    docs = []
    for n, item in items.items():
        for lead in (0, 6, 7):
            for subs in {0, n // 5, n // 5 + 1, n // 5 + 3}:
                words = list(item)
                for i in rng.sample(range(n), min(n, subs)):
                    words[i] = "zz"
                if rng.random() < 0.3:
                    words = words[rng.randrange(2) :]
                docs.append([f"q{rng.randrange(9)}" for _ in range(lead)] + words + ["r"] * rng.choice((0, 3)))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = decontaminate.mark_contaminated(df, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    found = {r["doc_id"] for r in got.where("contaminated").collect()}
    want = {i for i, d in enumerate(docs) if any(leaks_by_brute_force(d, item) for item in items.values() if set(item) & set(d))}
    assert found == want and 100 < len(want) < len(docs)


def test_decontamination_of_long_items(spark):
    """Items beyond what is compared around one hit, and masks that ignore places."""
    rng = random.Random(33)
    items = {n: [f"l{n}x{rng.randrange(3000)}" for _ in range(n)] for n in (137, 150, 300, 900)}
    docs, want = [], []
    for n, item in items.items():
        for subs in (0, n // 8, n // 2):
            words = list(item)
            for i in range(0, n, 2) if subs == n // 2 else rng.sample(range(n), subs):
                words[i] = "zz"
            want += [len(docs)] * (subs < n // 2)
            docs.append(prose(rng, 200).split() + words + prose(rng, 200).split())
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = decontaminate.mark_contaminated(df, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.where("contaminated").collect()) == want
    assert all(set(m) != set(range(m[-1] + 1)) for m in decontaminate.MASKS)


def test_decontamination_of_odd_input(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark_contaminated(docs, none).where("contaminated").count() == 0
    bench = docs.where("doc_id = 1").limit(1).select(F.lit(5).alias("item_id"), "text")
    got = decontaminate.mark_contaminated(docs, bench)
    assert set(docs.columns) - {"overlap"} <= set(got.columns)
    assert sorted(str(r["doc_id"]) for r in got.where("contaminated").collect()) == ["1", "1", "2", "None"]
    assert decontaminate.mark_contaminated(docs.limit(0), bench).count() == 0


def test_masks_meet_two_substitutions():
    import itertools

    for parity in range(decontaminate.STRIDE):
        windows = [frozenset(p + o for o in m) for m in decontaminate.MASKS for p in range(parity, 14 - decontaminate.SPAN + 1, decontaminate.STRIDE)]
        for subs in itertools.combinations(range(14), 2):
            assert any(not w & set(subs) for w in windows)


def test_masks_meet_every_accepted_substitution(spark):
    import itertools

    for n in range(decontaminate.SPAN, 25):
        for parity in range(2):
            at = range((-parity) % decontaminate.STRIDE, n, decontaminate.STRIDE)
            windows = [sum(1 << p + o for o in m) for m in decontaminate.MASKS for p in at if p + m[-1] < n]
            for subs in itertools.combinations(range(n), n // 5):
                gone = sum(1 << i for i in subs)
                assert any(not w & gone for w in windows)
    # Items of 8 to 12 tokens behind an even and an odd number of others.
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in range(8, 13)]
    docs = []
    for n, words in items:
        for subs in itertools.chain([()], itertools.combinations(range(n), n // 5)):
            for lead in (10, 11):
                docs.append((n * 1000 + len(docs), " ".join(["q"] * lead + [f"z{i}" if i in subs else w for i, w in enumerate(words)] + ["r"] * 7), n))
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    got = decontaminate.mark_contaminated(df, spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id int, text string"))
    assert got.where("NOT contaminated OR item_id <> n").count() == 0


# 2


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_classes(spark):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(12):
        base = prose(rng, 200, 3000).split()
        for c in range(rng.randint(2, 6)):
            copy = list(base)
            for i in rng.sample(range(200), c if c < 4 else 0):
                copy[i] = "edited"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    for _ in range(30):
        group[len(rows)] = f"own{len(rows)}"
        rows.append((len(rows), prose(rng, 150, 3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df).collect()}
    for a, ta in rows:
        for b, tb in rows[:a]:
            x, y = shingles(ta), shingles(tb)
            if len(x & y) / len(x | y) >= 0.85:
                assert got[a] == got[b]
            if group[a] != group[b]:
                assert got[a] != got[b]
    kept = {r["doc_id"] for r in neardup.keep_one_of_each(df).collect()}
    assert kept == set(got.values())


def test_pairs_inside_a_template_family(spark):
    rng = random.Random(13)
    form, rows = prose(rng, 320, 3000).split(), []
    for k in range(200):  # all share the form, 70 % of their weight; every second has a closer twin
        own = prose(rng, 10, 100_000).split()
        rows.append((len(rows), " ".join(form + own)))
        if k % 2:
            rows.append((len(rows), " ".join(form + own[:6] + prose(rng, 4, 100_000).split())))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df).collect()}
    t = next(textnum.slices(pa.array([x for _, x in rows]), True))[2]
    idf = neardup.idf_table(df)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    alike = []
    for lo in range(0, len(pairs), 5000):
        left, right = (next(textnum.slices(pa.array([rows[p[k]][1] for p in pairs[lo : lo + 5000]]), True, 1 << 62))[2] for k in (0, 1))
        alike.append(neardup.similarities(left, right, idf) >= neardup.SIMILAR)
    near = [p for p, x in zip(pairs, np.concatenate(alike)) if x]
    assert 50 < len(near) < 1000
    assert all(got[i] == got[j] for i, j in near)
    # Block by block gives what comparing pairs gives.
    node, root = [str(i).encode() for i in range(len(rows))], np.arange(len(rows))
    joined = list(range(len(rows)))
    for a, b in neardup.block_links(node, root, root > 0, t, idf, neardup.SIMILAR):
        x, y = joined[int(a)], joined[int(b)]
        joined = [min(x, y) if z in (x, y) else z for z in joined]
    want = list(range(len(rows)))
    for i, j in near:
        x, y = want[i], want[j]
        want = [min(x, y) if z in (x, y) else z for z in want]
    assert joined == want


def test_weighted_samples_estimate_similarity():
    rng = random.Random(4)
    base = prose(rng, 3000, 100_000).split()
    other = [w if rng.random() > 0.03 else "x" + w for w in base]
    idf = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)
    a, b = (next(textnum.slices(pa.array([" ".join(w)]), True))[2] for w in (base, other))
    exact = neardup.similarities(a, b, idf)[0]
    x, y = (neardup.samples(*neardup.weighted_shingles(t, idf), 1) for t in (a, b))
    assert abs((x == y).mean() - exact) < 0.25
    h = [shingles(" ".join(w)) for w in (base, other)]
    assert abs(exact - len(h[0] & h[1]) / len(h[0] | h[1])) < 1e-6


def test_document_frequencies_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 100)
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(0, 80), 400).upper() for _ in range(700)] + [None, "", " ", "one one one"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(5)
    words = [set(WORD.findall((x or "").lower())) for x in texts]
    n, held = sum(map(bool, words)), Counter(w for x in words for w in x)
    idf = neardup.idf_table(df)
    names = sorted(held)
    got = idf.of(next(textnum.slices(pa.array([" ".join(names)]), True))[2].hashes)
    want = [1 + math.log((1 + n) / (1 + max(held[w], n / 100))) for w in names]
    assert n > 600 and min(held.values()) < n / 100 and np.allclose(got, want, atol=1e-5)
    assert len(idf.words) == sum(c > n / 100 for c in held.values())
    assert neardup.idf_table(df.limit(0)).of(np.zeros(0, np.uint64)).tolist() == []


def test_near_duplicates_of_odd_input(spark):
    docs = odd_documents(spark)
    got = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicate_classes(docs).collect()]
    assert len(got) == docs.count()
    assert (7, 6) in got and (2, 1) in got and (3, 3) in got and (4, 4) in got and (None, 1) in got
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 1, 2, 3, None, None, 4, 5, 6, 8]))
    assert neardup.near_duplicate_classes(docs.limit(0)).count() == 0 and neardup.keep_one_of_each(docs.where("text IS NULL")).count() == 2


# 3


def fill_level(sizes, weights, most=3):
    total, target, left = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while left and rest > 1e-9:
        w = sum(weights[i] for i in left)
        full = [i for i in left if rest * weights[i] / w >= most * sizes[i] - 1e-9]
        if not full:
            for i in left:
                target[i] = rest * weights[i] / w
            break
        for i in full:
            target[i] = most * sizes[i]
            rest -= target[i]
            left.discard(i)
    return target


def test_source_targets(spark):
    rng = random.Random(5)
    for sizes in ([10, 100, 1000], [5, 5, 5, 5, 900], [0, 7, 0], [0, 0], [rng.randint(0, 1000) for _ in range(11)]):
        df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "_src string, source_size long")
        got = [r["target"] for r in mixing.source_targets(df).orderBy("_src").collect()]
        assert np.allclose(got, fill_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]), atol=1e-6)


def test_mix_takes_near_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)), None, rng.choice(["a", "a", "a", "b", None]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, FORM)
    quality = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5).alias("weight"))
    got = mixing.mix_sources(df, quality).collect()
    again = mixing.mix_sources(df.repartition(3), quality).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    for src in {r["_src"] for r in got}:
        mine = [r for r in got if r["_src"] == src]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    part = [r for r in got if r["target"] < r["source_size"]]
    share = lambda k: np.mean([r["copies"] for r in part if r["doc_id"] % 2 == k])
    assert share(0) > share(1)
    mixed = mixing.take_mix(df, quality)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)


def test_mix_of_odd_input(spark):
    docs = odd_documents(spark)
    assert mixing.mix_sources(docs).count() == docs.count()
    assert mixing.take_mix(docs).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.where("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


# 4 is compared with SQL above.


def test_line_dedup_of_odd_input(spark):
    docs = odd_documents(spark)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == docs.count()
    state = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in got)
    assert state.count(("1", 1, 0)) == 2 and ("2", 1, 1) in state and ("None", 1, 1) in state and ("5", 3, 0) in state
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    rows = [(1, "a common line\nown first line"), (2, "  A COMMON LINE\t\nx"), (3, "a common line\na common line")]
    three = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert three == {1: rows[0][1], 2: "x", 3: ""}
    more = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4)
    assert more.agg(F.sum("n_dropped")).first()[0] == 0


# 5


def test_payload_digests(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    for form in ("pgm", "bmp"):
        got = media.digests(media.text_media(docs, form)).collect()
        want = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
        assert len(got) == len(want)
        for r, (_, text) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_bytes"])), sorted(want, key=lambda x: (x[0], len(x[1].encode())))):
            raw = text.encode()
            payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_image_codecs():
    rng = np.random.default_rng(7)
    image = rng.integers(0, 256, (7, 10), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P2 # c\n2 2\n255\n0 1\n2 3\n") == [[0, 1], [2, 3]]).all()
    assert (media.decode(b"P1\n3 1\n1 01\n") == [[1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[1, 0, 1], [0, 1, 0]]).all()
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    number = lambda *values: b"".join(v.to_bytes(4, "little") for v in values)
    fields = b"BM" + number(70, 0, 66) + number(40, 1, 1) + b"\x01\0\x20\0" + number(3, 4, 0, 0, 0, 0)
    straight = fields + number(255 << 16, 255 << 8, 255)
    assert media.decode(straight + b"\x03\x02\x01\0").tolist() == [[[1, 2, 3]]]
    bad_bmp = [fields + number(255, 255 << 8, 255 << 16) + b"\0" * 4, media.encode_bmp(image)[:1000], media.encode_bmp(image)[:14] + number(12) + media.encode_bmp(image)[18:]]
    bad_pnm = [b"P5\n99999999999 99999999999\n255\n1", b"P5\n9999999 9999999\n255\n1", b"P2\n1 1\n255\n300", b"P2\n1 1\n255\n-5", b"P2\n1 1\n255\n" + b"9" * 23, b"P1\n1 1\n9", b"P5\n1 1\n7\n\x09", b"P4\n9 9\n\0"]
    for bad in (b"", b"P5\n9 9\n255\n1", b"BM", b"GIF89a", b"P3\n1 1\n255\n1", *bad_bmp, *bad_pnm):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize():
    image = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(media.resize_area(image, 3, 4), image.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.resize_area(image, 6, 8), image)
    assert np.isclose(media.resize_area(image, 5, 3).mean(), image.mean())
    rng = np.random.default_rng(3)
    tall, strip = rng.integers(0, 256, (1000, 64)), media.STRIP
    try:
        media.STRIP = 640
        in_strips = media.resize_area(tall, 32, 32)
    finally:
        media.STRIP = strip
    assert np.allclose(in_strips, media.resize_area(tall, 32, 32)) and np.allclose(media.resize_area(tall, 1, 1), tall.mean())
    flat = np.full((5, 9), 7.0)
    assert np.allclose(media.resize_area(flat, 8, 11), 7.0) and media.difference_hash(flat) == "0" * 16


def test_image_columns(spark):
    rows = [(1, media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))), (2, None), (3, b"junk"), (4, b""), (5, b"P5\n99999999999 99999999999\n255\n1"), (6, b"P2\n1 1\n255\n" + b"9" * 23), (7, b"P2\n2 1\n9\n9 9")]
    got = {r["i"]: r for r in media.image_columns(spark.createDataFrame(rows, "i int, media binary")).collect()}
    assert got[1]["width"] == 8 and np.load(io.BytesIO(got[1]["tile_npy"])).shape == (32, 32) and got[1]["dhash"] == "f" * 16
    assert all(got[i]["dhash"] is None and got[i]["height"] is None for i in (2, 3, 4, 5, 6))
    assert np.load(io.BytesIO(got[7]["tile_npy"])).tolist() == np.ones((32, 32)).tolist()


@needs_tables
def test_media_query_equals_brute_force(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in media.op5(spark, SF).collect():
        raw = docs.pop(r["doc_id"])
        rows = max(1, -(-len(raw) // 64))
        payload = raw.ljust(rows * 64, b"\0")
        pgm = b"P5\n64 %d\n255\n" % rows + payload
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == r["bmp_payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["media_bytes"], r["media_sha256"], r["bmp_bytes"]) == (len(pgm), hashlib.sha256(pgm).hexdigest(), 1078 + len(payload))
        image = np.frombuffer(payload, np.uint8).reshape(rows, 64)
        # Means over fractional areas by repeating each sample.
        fine = np.repeat(np.repeat(image, 8, 0), 9, 1).astype(float)
        small = fine.reshape(8, rows, 9, 64).mean((1, 3))
        sure = np.abs(np.diff(small, axis=1)) > 1e-6
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["feature"]), np.uint8)).reshape(8, 8).astype(bool)
        assert (bits == (np.diff(small, axis=1) > 0))[sure].all()
    assert not docs


# 6


def strip(docs):
    seen, gone = {}, {}
    for d, text in sorted(docs):
        w = WORD.findall(text or "")
        cut = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                cut.update(range(i, i + 20))
            else:
                seen[k] = d
        gone[d] = (len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut))
    return gone


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    passages = [prose(rng, n, 5000) for n in (19, 20, 21, 60, 300)]
    docs = [(i, "\n".join(rng.choice([prose(rng, rng.randint(0, 40), 5000), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    docs += [(500, "ab " * 200), (501, "ab " * 30), (502, None), (503, "")]
    monkeypatch.setattr(substrings, "PIECE_BYTES", 6000)
    got = substrings.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == strip(docs)


def test_substring_dedup_of_repeated_rows(spark, monkeypatch):
    rng = random.Random(81)
    once, twice, shared = prose(rng, 60, 5000), prose(rng, 90, 5000), prose(rng, 70, 5000)
    rows = [(1, once), (1, once), (2, twice), (2, twice + " more"), (3, shared + " " + prose(rng, 30)), (None, shared), (None, shared), (None, twice + " x"), (9, "ab " * 90), (9, "ab " * 90)]
    want = None
    monkeypatch.setattr(substrings, "OFTEN", 2)  # so that some windows are salted
    monkeypatch.setattr(substrings, "PIECE_BYTES", 700)
    for parts in (1, 2, 5, 10):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got = sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.strip_repeats(df).collect())
        want = want or got
        assert got == want
    removed = [(d, r) for d, _, _, r, _ in want]
    assert removed.count(("1", 0)) == 2 and removed.count(("None", 70)) == 2 and ("None", 90) in removed and removed.count(("9", 89)) == 2
    assert sorted(r for d, r in removed if d == "2") == [0, 90] and ("3", 0) in removed


def test_substring_dedup_of_odd_input(spark):
    docs = odd_documents(spark)
    got = substrings.strip_repeats(docs)
    assert got.count() == docs.count() and set(docs.columns) - {"kept_text"} <= set(got.columns)
    state = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got.collect())
    assert state.count(("1", 60, 0)) == 2 and ("2", 60, 60) in state and ("None", 60, 60) in state and ("7", 30001, 30000) in state
    assert substrings.strip_repeats(docs.limit(0)).count() == 0


# 7


def test_sharding(spark):
    for n in (0, 1, 2, 3, 5, 64, 1000):
        rows = [(i, f"t{i}") for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r["shard"], r["slot"]) for r in sharding.assign_shards(df).orderBy("doc_id").collect()]
        again = [(r["shard"], r["slot"]) for r in sharding.assign_shards(df.repartition(3)).orderBy("doc_id").collect()]
        assert got == again and len(set(got)) == n
        counts = [sum(1 for s, _ in got if s == k) for k in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(x for s, x in got if s == k) == list(range(counts[k])) for k in range(8))


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 7, 100, 4099):
        a = math.ceil(math.sqrt(n))
        to = sharding.permuted(F.col("id"), F.lit(n), F.lit(a), F.lit(-(-n // a)))
        assert sorted(r[0] for r in spark.range(n).select(to).collect()) == list(range(n))


def test_sharding_of_hot_rows(spark):
    rows = [(i, f"t{i}") for i in range(40)] + [(None, None)] * 300 + [(7, "copy")] * 200
    want = None
    for parts in (1, 3, 7):
        df = sharding.numbered(spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string"), 50, 100)
        got = sorted((r["_row"], str(r["doc_id"]), str(r["text"])) for r in df.collect())
        want = want or got
        assert got == want and [r[0] for r in got] == list(range(540))


@needs_tables
def test_many_hot_keys_have_buckets_by_their_count(spark):
    """1,000 hot keys fill 1,000 to 3,000 buckets, not 1,000 times all."""
    rows = spark.range(40_000).select(F.pmod("id", F.lit(1000)).alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(5000).select((F.col("id") + 5000).alias("doc_id"), F.lit("own").alias("text")))
    got = sharding.numbered(rows, bucket_rows=25, hot_rows=30)
    plan = got._jdf.queryExecution().toString()
    assert sorted(r["_row"] for r in got.select("_row").collect()) == list(range(45_000)) and "map(" not in plan
    by_key = got.where("doc_id < 1000").groupBy("doc_id").agg((F.max("_row") - F.min("_row")).alias("reach")).agg(F.max("reach")).first()[0]
    assert by_key == 39  # the rows of a key stand together


def test_sharding_query_equals_brute_force(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = sharding.op7(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in docs.items()}
    counts = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_sharding_of_odd_input(spark):
    docs = odd_documents(spark)
    got = sharding.assign_shards(docs)
    assert got.count() == docs.count() and got.select("shard", "slot").distinct().count() == docs.count()
    assert dict(got.dtypes)["shard"] == "int" and set(docs.columns) <= set(got.columns)


# 8


def toxic_corpus(spark, n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randint(30, 120), 150).split(), i % 5 == 0
        if bad:
            for k in rng.sample(range(len(words)), max(2, len(words) // 25)):
                words[k] = rng.choice(["vile", "scum", "fool", "trash"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(scored) > 100
    right = np.mean([(r["score"] >= toxicity.CUT) == (r["toxic"] == 1) for r in scored])
    assert right > 0.97


def test_sample_is_bounded_in_rows_and_bytes(spark):
    long = "word " * 60_000
    docs = spark.range(20_000).select(F.pmod("id", F.lit(4)).alias("doc_id"), F.when(F.col("id") < 4, F.lit(long)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, 2).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 4
    longest = toxicity.labelled(docs.where(F.col("text") == long), labels, 2).agg(F.max(F.length("text"))).first()[0]
    assert 60_000 < longest <= toxicity.TEXT_CHARS + toxicity.PIECES


def test_kneser_ney_counts_equal_brute_force(spark):
    """Counts, backoff and evidence from their definitions, in dictionaries."""
    rng = random.Random(71)
    texts = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))) for k in (0, 0, 0, 0, 0, 0, 1, 1, 1) for _ in range(3)]
    texts += [texts[0], texts[-1]]
    corpus = [t for _, t in texts] + [" ".join(rng.choice("abcz") for _ in range(5)) for _ in range(9)]
    rows = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(texts)], "toxic int, h long, text string")
    counts, parts = toxicity.count_sample(rows, spark.createDataFrame([(t,) for t in corpus], "text string"))
    model = toxicity.fit_model(counts, parts, 0.75)
    n0 = round(sum(k == 0 for k, _ in texts) / sum(k == 1 for k, _ in texts))
    assert [len(p) for p in parts] == [n0, 1]
    hashed = dict(spark.createDataFrame([(t,) for t in corpus], "t string").select("t", F.xxhash64("t")).collect())

    def counted(held):
        triple = {}
        for t in held:
            w = ["", "", *t.split()]
            for x in zip(w, w[1:], w[2:]):
                triple[x] = min(triple.get(x, 2**63), hashed[t])
        pair, word, first = {}, {}, {}
        for (_, u, v), d in triple.items():
            pair.setdefault((u, v), set()).add(d)
            first[u, v] = min(first.get((u, v), 2**63), d)
        for (u, v), d in first.items():
            word.setdefault(v, set()).add(d)
        return {k: len(x) for k, x in pair.items()}, {k: len(x) for k, x in word.items()}

    groups = [counted([t for i, (k, t) in enumerate(texts) if k == 0 and i % n0 == g]) for g in range(n0)] + [counted([t for k, t in texts if k == 1])]
    vocabulary = {v for _, w in groups for v in w}
    total = sum(len(set(t.split())) for t in corpus)
    shared = {v: (sum(v in t.split() for t in corpus) + 0.5) / (total + 0.5 * (len(vocabulary) + 2)) for v in vocabulary}
    pool = {}
    for pair, _ in groups:
        for k, n in pair.items():
            pool[k] = pool.get(k, 0) + n

    def kept(pair, u, v):
        all_ = max(1, sum(n for (a, _), n in pair.items() if a == u))
        left = 1 - sum(max(n - 0.75, 0) / all_ for (a, _), n in pair.items() if a == u)
        return max(pair.get((u, v), 0) - 0.75, 0) / all_, max(left, 1e-9)

    def log_p(group, u, v):
        pair, word = group
        mass = sum(word.values())
        p_word = max(word.get(v, 0) - 0.75, 0) / mass + (1 - sum(max(n - 0.75, 0) for n in word.values()) / mass) * shared[v]
        a, b = kept(pool, u, v)
        x, y = kept(pair, u, v)
        return math.log(x + y * (a + b * shared[v]) * p_word / shared[v])

    for text in ("a b c", "h", "d a g f b", texts[0][1]):
        t = next(textnum.slices(pa.array([text])))[2]
        w = ["", *text.split()]
        want = [log_p(groups[-1], u, v) - np.mean([log_p(g, u, v) for g in groups[:-1]]) for u, v in zip(w, w[1:]) if v in vocabulary]
        got = model.features(t)[0][2::2].sum() * len(t.hashes)
        assert math.isclose(got, sum(want), abs_tol=1e-3)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Spark's own limits let 10,000 rows or 64 MB into a batch, whatever the size of an executor."""
    words = [f"w{i}" for i in range(5003)]
    texts = [" ".join(words[(i * 7919 + j * j + j) % 5003] for j in range(1500)) for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def bounded(column, *args, **kwargs):
        if column.nbytes > 2 * (4 << 20):
            raise ValueError(f"{column.nbytes} bytes in a batch")
        yield from textnum.slices(column, *args, **kwargs)

    for module in (toxicity, neardup):
        monkeypatch.setattr(module, "slices", bounded)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert toxicity.score_toxicity(docs, toxicity.train(docs, labels)).where("score >= 0").count() == 1200
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert neardup.near_duplicate_classes(docs).where("class_id = doc_id").count() == 1200
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        toxicity.train(docs, labels)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if before is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_toxicity_of_odd_input(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, None, None), (6, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.score_toxicity(docs, toxicity.train(docs, table)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


# 9


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(10)
    e, steps = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 7])
    post, both = langid.chain_posteriors(e, first, steps, pairs=True)
    want = np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        total, single, pair = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = math.exp(sum(e[a + i, y] for i, y in enumerate(path)) + sum(steps[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                single[i, y] += p
            for x, y in zip(path, path[1:]):
                pair[x, y] += p
        assert np.allclose(post[a:b], single / total)
        want += pair / total
    assert np.allclose(both, want)


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(11)
    ends = {"xx": ["ing", "tion", "ly"], "yy": ["eux", "ment", "que"], "zz": ["ung", "keit", "lich"]}
    word = lambda k: "".join(rng.choice("abdefgikmo") for _ in range(rng.randint(1, 4))) + rng.choice(ends[k])
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(rng.choice(list(ends)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.train(docs)
    got = langid.identify(docs, field).where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    mixed = " ".join([word("xx") for _ in range(12)] + [word("zz") for _ in range(12)])
    spans = langid.identify(spark.createDataFrame([(mixed,)], "text string"), field).first()["spans"]
    assert [(s["lang"], abs(s["words"] - 12) <= 1) for s in spans] == [("xx", True), ("zz", True)]
    assert len(field.lexicon) and set(field.listed.tolist()) <= {0, 1, 2}
    p = field.posteriors(next(textnum.slices(pa.array([mixed])))[2])
    assert (p[:10].argmax(1) == 0).all() and (p[-10:].argmax(1) == 2).all()


def test_all_languages_are_learned(spark):
    rng = random.Random(17)
    rows = [(i * 70 + k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('aeiou')}{rng.choice('xyz')}" for _ in range(30)), f"l{k:02}") for k in range(70) for i in range(4)]
    field = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert field.labels == [f"l{k:02}" for k in range(70)] and len(field.words) * 70 <= langid.WORD_WEIGHTS
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), field).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(sum(s["words"] for s in r["spans"]) == 30 for r in got)


def test_language_id_of_odd_input(spark):
    docs = odd_documents(spark).withColumn("lang_pred", F.lit("x"))
    got = {str(r["doc_id"]): r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got["3"]["lang_pred"] == got["4"]["lang_pred"] == got["5"]["lang_pred"] == "und" and got["6"]["lang_pred"] in ("en", "fr", "de")
    nothing = langid.train(docs.limit(0).select("doc_id", "text", "lang"))
    assert langid.identify(docs.limit(0), nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


# 10


def test_licences_in_other_dress(spark):
    texts = dict((k, t) for k, t in reversed(licences.TEXTS))
    dressed = "Copyright (c) 2020 Some Body\n\n" + next(t for k, t in licences.TEXTS if k == "MIT").upper().replace("SUBLICENSE", "sublicence").replace(",", " ,\n")
    rows = [(1, dressed), (2, "prose\nReleased under the MIT Licence!\nmore"), (3, "prose only"), (4, None), (5, ""), (6, texts["BSD-2-Clause"] + " and more")]
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license"] == "MIT" and got[2]["license"] is None and got[2]["notices"] == ["MIT"]
    assert all(got[i]["license"] is None and got[i]["notices"] == [] for i in (3, 4, 5, 6))


def form(text):
    """The canonical form, in other words than the operator's."""
    lines = []
    for line in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split("\n"):
        start = line.lstrip(" \t")
        mark = next((m for m in ("copyright", "(c)", "©") if start.startswith(m)), None)
        rest = start[len(mark) :] if mark else ""
        named = rest[:1] in (" ", "\t") and (rest.strip(" \t")[:1] in tuple("0123456789©[<{") or rest.strip(" \t").startswith(("(c)", "by ")))
        if not (mark and (named or re.search("(19|20)[0-9][0-9]", rest))):
            lines.append(line)
    import unicodedata

    lines = [x for x in lines if not re.fullmatch(r"[ \t]*all rights reserved[ \t.]*", x)]
    full = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c#*=_-")]
    if full and full[0] + 1 < len(lines):
        title = lines[full[0]].lstrip(" \t\r\x0b\x0c#*=_-").removeprefix("the ")
        families = ("mit", "expat", "x11", "isc", "zlib", "bsd", "new bsd", "modified bsd", "simplified bsd", "revised bsd", "apache", "boost", "gnu", "mozilla", "eclipse", "academic free", "artistic")
        if any(re.fullmatch(re.escape(x) + ".{0,50}licen[cs]e.{0,40}", title) for x in families):
            lines = lines[full[0] + 1 :]
    lines = [re.sub(r"^[ \t]*([0-9][0-9]?[.)]|\([0-9a-z][0-9a-z]?\)|[a-z][.)]|[*\u2022-])[ \t]+", "", x, count=1) for x in lines]
    text = " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in "\n".join(lines)).split())
    for a, b in licences.SPELLINGS:
        text = text.replace(a, b)
    for a, z in (("neither the name of ", " nor the names of"), ("provided by ", " as is"), ("in no event shall ", " be liable")):
        text = re.sub(re.escape(a) + ".{1,100}?" + (" nor the names? of" if "nor" in z else re.escape(z)), a + "the copyright owner" + z, text)
    return text


MIT_BODY = next(t for k, t in licences.TEXTS if k == "MIT").partition("\n\n")[2]
BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of Acme Corporation nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
HEADINGS = [
    ("MIT", MIT_BODY), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015-2020 Some Body\n\n" + MIT_BODY), ("MIT", "# MIT Licence\n" + MIT_BODY.replace(". ", ".\n")),
    ("MIT", "Copyright (c) 2019 A. Person. All rights reserved.\n\nThe MIT License\n\n" + MIT_BODY), ("BSD-3-Clause", BSD_BODY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2017, Acme\nAll rights reserved.\n\n" + BSD_BODY), ("BSD-3-Clause", "Copyright 2001 Acme\n" + BSD_BODY.replace("* Redis", "(a) Redis").replace("* Nei", "(c) Nei")),
    ("BSD-2-Clause", re.sub(r"\* Neither.*?permission\.\n", "", BSD_BODY, flags=re.S)), (None, MIT_BODY + "\nand no other use"), (None, BSD_BODY.replace("binary", "any")),
]


def test_licences_under_other_headings(spark):
    found = licences.scan_licences(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HEADINGS)], "doc_id int, text string")).collect()
    assert [r["license"] for r in sorted(found, key=lambda r: r["doc_id"])] == [k for k, _ in HEADINGS]


def test_licence_forms_equal_brute_force(spark):
    rng = random.Random(31)
    texts = [t for _, t in licences.TEXTS] + ["Copyright Acme Corp 2020\ncopyright notice and\n(c) 2001 x\nCopyright [yyyy] [name]\n© by me", "a “curly” – ‘quote’ … b", "", "ÀÉ licence\tÜ"]
    texts += ["".join(rng.choice("aB c.\n,©é-(c)2019") for _ in range(200)) for _ in range(50)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licences.canonical(F.col("t")).alias("c")).collect()
    assert all(r["c"] == form(texts[r["i"]]) for r in got)
    known = dict((form(t), k) for k, t in sorted(licences.TEXTS, reverse=True))
    files = [(k, t) for k, t in licences.TEXTS if len(t) > 5000]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= {k for k, _ in files}
    rows = [(i, "Copyright Acme Corp 2020\n" + t.replace('"', "“").replace("'", "’").upper()) for i, (_, t) in enumerate(files)]
    found = {r["doc_id"]: r["license"] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {i: known[form(t)] for i, (_, t) in enumerate(files)}
    own = licences.scan_licences(spark.createDataFrame([(1, "x\nDo as you like, neighbour.\ny")], "doc_id int, text string"), (("own", "Do as you like neighbour"),)).first()
    assert own["notices"] == ["own"]


def test_licences_of_odd_input(spark):
    docs = odd_documents(spark)
    got = licences.scan_licences(docs)
    assert got.count() == docs.count() and got.where("license IS NOT NULL").count() == 0
    assert licences.scan_licences(docs.limit(0)).count() == 0


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    docs, labels = toxic_corpus(spark, 300)
    item = " ".join(f"b{rng.randrange(5000)}" for _ in range(30))
    copy = prose(rng, 100, 3000)
    more = [(900, copy), (901, copy), (902, copy + " tail"), (903, plant(rng, item, 2)), (904, None), (None, prose(rng, 30))]
    rows = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    rows.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert not {901, 902, 903} & set(ids)
    assert max(ids.count(i) for i in set(ids)) <= 3
    assert out.select("shard", "slot").distinct().count() == len(ids)
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
