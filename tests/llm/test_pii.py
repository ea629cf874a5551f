"""Personal data: patterns against plain regular expressions, messages against enumeration, what the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airloft.llm import pii, queries

from test_llm import SF, needs_tables, odd_documents

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            d = "".join(c for c in m[0] if c.isdigit())
            doubled = [int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))]
            if [True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), kind != 2 or (14 <= len(d) <= 19 and sum(doubled) % 10 == 0), kind != 3 or 10 <= len(d) <= 15] == [True] * 4:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("a1.@-é", "0192. -", "+12() .-", "@.ab", "4 -1", "+1@.a ", "25.0a"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for c in ("1", "a", "1.", "@", "a@", "+1 ", "1 ", "1@"):
        text = c * (400_000 // len(c))
        pii.base_spans(text)
        assert sum(b - a for a, b in pii.tokens(text)) <= len(text)


def example_field():
    rng = random.Random(3)
    texts = []
    for i in range(300):
        d = f"{rng.randrange(10**15):015d}"
        card = next(d + x for x in "0123456789" if pii.luhn(d + x))
        bad = d + str((int(card[-1]) + 1 + rng.randrange(8)) % 10)
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        ip, mail = ".".join(str(rng.randrange(1, 256)) for _ in range(4)), f"user{i}@mail{i % 7}.example.com"
        texts.append(f"words {rng.choice([card, bad, phone, ip, mail])} and {rng.choice([card, bad, phone, ip, mail, 'version 3.0'])}, the end {i}.")
    return pii.fit(texts, 800)


FIELD = None


def field():
    global FIELD
    FIELD = FIELD or example_field()
    return FIELD


def named(text):
    base, extra = pii.all_spans(field(), pa.array([text]))[0]
    return [(pii.KINDS[k], text[s:e]) for s, k, e in base], [(pii.KINDS[k], text[s:e]) for s, k, e in extra]


def test_field_adds_what_patterns_miss():
    a, b = "4111111111111111", "5500005555555559"
    assert named(f"cards {a} {b} here") == ([], [("card", a), ("card", b)])
    assert named(f"call +1 (743) 555-3824 {a} now") == ([], [("phone", "+1 (743) 555-3824"), ("card", a)])
    assert named("no 4111111111111112, 12 of 2021-01-02, version 3.0, token = \"ab12cd34\"") == ([], [])


def test_like_tokens_share_labels():
    whole, part = "+1 (743) 555-3824", "(743) 555-3824"
    assert named(f"only {part} here") == ([], [])
    assert named(f"call {whole} now, {'word ' * 50} or {part} later") == ([("phone", whole)], [("phone", part)])


def test_messages_equal_enumeration_on_trees():
    """Without loops the beliefs are the probabilities."""
    rng = np.random.default_rng(5)
    f = pii.Field(rng.normal(size=(pii.SLOTS, pii.N)), rng.normal(size=(pii.N, pii.N)), rng.normal(size=(pii.N, pii.N)))
    f.likes = (f.likes + f.likes.T) / 2
    text = "x 12 34 words 9876543 and more 9876543 5"
    g = pii.Graph()
    g.add(0, text, list(pii.tokens(text)))
    g.close()
    assert [text[a:b] for _, a, b in g.spans] == ["12", "34", "9876543", "9876543", "5"]
    assert g.near.tolist() == [[0, 1], [3, 4]] and g.like.tolist() == [[2, 3]]
    own = np.array([f.words[g.features[g.first[i] : g.first[i + 1]]].sum(axis=0) for i in range(5)])
    p, near, like = np.zeros((5, pii.N)), np.zeros((2, pii.N, pii.N)), np.zeros((1, pii.N, pii.N))
    for y in itertools.product(range(pii.N), repeat=5):
        s = sum(own[i, y[i]] for i in range(5)) + sum(f.steps[y[i], y[j]] for i, j in g.near) + f.likes[y[2], y[3]]
        s += sum(f.steps[0, y[i]] for i in range(5) if g.starts[i]) + sum(f.steps[y[i], 0] for i in range(5) if g.stops[i])
        w = np.exp(s)
        for i in range(5):
            p[i, y[i]] += w
        for n, (i, j) in enumerate(g.near):
            near[n, y[i], y[j]] += w
        like[0, y[2], y[3]] += w
    got = f.beliefs(g)
    assert np.allclose(got[0], p / p.sum(axis=1, keepdims=True), atol=1e-9)
    assert np.allclose(got[1], near / near.sum(axis=(1, 2), keepdims=True), atol=1e-9)
    assert np.allclose(got[2], like / like.sum(axis=(1, 2), keepdims=True), atol=1e-9)


def test_blocks_of_a_text_with_many_tokens(monkeypatch):
    monkeypatch.setattr(pii, "GRAPH", 7)
    text = " and ".join(["4111111111111111 5500005555555559"] * 20)
    base, extra = pii.all_spans(field(), pa.array([text, None, text]))[0]
    assert not base and len(extra) >= 36


@needs_tables
def test_query_equals_plain_patterns(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_personal_data"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    joined = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for r in got:
        want = plain_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        every = [x.split(":") for x in r["spans"].split(",") if x]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(r["spans"].split(",")) | {""}
        assert len(every) == len(want) + r["n_added"] and [int(x[1]) for x in every] == sorted(int(x[1]) for x in every)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_input(spark, rows):
    docs = odd_documents(spark).withColumns({"private": F.lit("clash"), "redacted": F.lit("clash"), "_text": F.lit("mine")})
    docs = docs.where("false") if rows == "none" else docs
    got = pii.find(docs, pii.train(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["redacted"] == r["text"] and r["private"] == [] and r["_text"] == "mine"


def test_redaction(spark):
    text = "é write to joe@a.example.com or 10.0.0.1, card 4111 1111 1111 1111."
    (r,) = pii.find(spark.createDataFrame([(text,)], "text string"), field()).collect()
    assert r["redacted"] == "é write to [email] or [ip], card [card]."
    assert [(s["kind"], text[s["start"] : s["end"]], s["added"]) for s in r["private"]][0] == ("email", "joe@a.example.com", False)
