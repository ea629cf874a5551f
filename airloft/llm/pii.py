"""Personal data in texts: patterns, and a skip-chain conditional random field that adds to them.

The patterns give the base spans. The field labels the tokens of a text that hold
a digit or an @; all other tokens are outside of any span by definition, so
only neighbours with nothing but blanks and brackets between them are tied to each
other. Further edges tie a token to the next one in the text that is the same
or has the same digits: they share a potential, and messages passed around the
graph let a clear place speak for an unclear one. The field learns from the base
spans of a bounded sample, and from texts spliced of them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, table

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: outside, and of each kind the first token and further ones. Emails and addresses have one token.
LABELS = ("", "email", "ip", "card", "card+", "phone", "phone+")
N = len(LABELS)
KIND_OF = np.array([-1, 0, 1, 2, 2, 3, 3])
BEGINS = np.array([True, True, True, True, False, True, False])
#: Texts of the sample (of at most so many characters), texts spliced of its spans, slots of features.
SAMPLE, SAMPLE_CHARS, SPLICED, SLOTS = 3000, 16_384, 3000, 1 << 14
STEPS, RATE, SHRINK = 60, 0.4, 1e-3
#: Passes of messages, as many for every text, whatever it is labelled with; tokens that one graph holds at most.
PASSES, GRAPH = 16, 40_000

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_TOKEN = re.compile(r"[0-9@][A-Za-z0-9@._%+-]*")
_BETWEEN = frozenset(" ().-")
_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, in order. Each pass over the text takes time in proportion to its length.

    A run of dotted numbers matches in groups of four, a run of spaced digits as a
    whole, an address from the first character that may stand before its @.
    """
    if not _HINT.search(text):
        return []
    out, free = [], 0
    if "@" in text:
        for m in _TAIL.finditer(text):
            at = m.start()
            while at > free and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((at, 0, m.end()))
                free = m.end()
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    out.append((at, 1, end))
                at = end + 1
    for m in _SPACED.finditer(text):
        if m.end() - m.start() >= 14 and is_card(_DIGITS.sub("", m[0])):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of letters, digits and @._%+- that hold a digit or an @, without marks at their ends (but a leading plus)."""
    last = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        last = b
        while b > a and text[b - 1] in "._%+-":
            b -= 1
        while a < b and text[a] in "._%-":
            a += 1
        if b > a:
            yield a, b


class Graph:
    """Tokens of some texts as nodes: features, edges to neighbours, edges to like tokens.

    first[i]:first[i + 1] are the features of node i. near and like are pairs of
    nodes (the earlier first); starts and stops flag nodes without a neighbour
    before or after them.
    """

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []
        self._features: list[int] = []
        self._counts: list[int] = []
        self._near: list[tuple[int, int]] = []
        self._like: list[tuple[int, int]] = []

    def add(self, owner: int, text: str, found: list[tuple[int, int]]) -> None:
        base, words, seen = len(self.spans), [text[a:b] for a, b in found], {}
        tied = [i > 0 and 0 < found[i][0] - found[i - 1][1] <= 3 and all(c in _BETWEEN for c in text[found[i - 1][1] : found[i][0]]) for i in range(len(found))]
        cards, dial = _card_runs(words, tied), _dialled(words, tied)
        for i, ((a, b), word) in enumerate(zip(found, words)):
            node = base + i
            after = i + 1 < len(found) and tied[i + 1]
            self.spans.append((owner, a, b))
            digits = _DIGITS.sub("", word)
            names = _features(word, digits, cards[i], dial[i])
            names.append(f"<{text[found[i - 1][1] : a]}{min(len(words[i - 1]), 17)}" if tied[i] else "<" + _word(text[max(0, a - 12) : a], -1))
            names.append(f">{text[b : found[i + 1][0]]}{min(len(words[i + 1]), 17)}" if after else ">" + _word(text[b : b + 12], 0))
            self._features += [zlib.crc32(x.encode()) % SLOTS for x in names]
            self._counts.append(len(names))
            if tied[i]:
                self._near.append((node - 1, node))
            if len(word) >= 3:
                key = digits if len(digits) >= 7 and not re.search("[A-Za-z@]", word) else word.lower()
                if key in seen and not (tied[i] and seen[key] == node - 1):
                    self._like.append((seen[key], node))
                seen[key] = node

    def close(self) -> Graph:
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        self.features, self.first = np.array(self._features, np.int64), np.concatenate([[0], np.cumsum(self._counts)]).astype(np.int64)
        self.near, self.like = pairs(self._near), pairs(self._like)
        self.starts, self.stops = np.ones(len(self), bool), np.ones(len(self), bool)
        self.starts[self.near[:, 1]] = False
        self.stops[self.near[:, 0]] = False
        return self

    def __len__(self) -> int:
        return len(self.spans)


def _word(text: str, which: int) -> str:
    found = re.findall(r"[^\W\d_]+|[=:#]", text)
    return found[which].lower() if found else ""


def _features(word: str, digits: str, card: bool, dial: str) -> list[str]:
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: f"d{min(len(m[0]), 20)}.", word))
    rough = re.sub("[0-9]+", "d", re.sub("[A-Za-z]+", "a", word))
    host = word.rpartition("@")[2]
    parts = word.split(".")
    address = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    mixed = bool(re.search("[A-Za-z]", word))
    return ["", f"s{shape[:40]}", f"r{rough[:24]}", f"n{min(len(digits), 20)}{mixed}", f"@{word.count('@') if '@' in word else ''}{'@' in word and '.' in host}", f"4{address}", f"c{card}", f"c{card}{min(len(digits), 20)}", f"p{dial}", f"+{word[0] == '+'}"]


def _card_runs(words: list[str], tied: list[bool]) -> list[bool]:
    """Whether a token lies in neighbouring all-digit tokens that make a card number together."""
    out = [False] * len(words)
    for i, word in enumerate(words):
        held, j = "", i
        while j < len(words) and (j == i or tied[j]) and len(held) < 19 and (bare := words[j].replace("-", "")).isdigit():
            held += bare[:20]
            if is_card(held):
                out[i : j + 1] = [True] * (j + 1 - i)
                break
            j += 1
    return out


def _dialled(words: list[str], tied: list[bool]) -> list[str]:
    """Where a token stands in a number that began with a plus: its place and the digits up to it; empty elsewhere."""
    out, place, held = [], -1, 0
    for word, joined in zip(words, tied):
        if word[0] == "+":
            place, held = 0, 0
        elif not joined or re.search("[A-Za-z@]", word):
            place = -1
        if place >= 0:
            held += sum(c.isdigit() for c in word)
            out.append(f"{min(place, 5)}:{min(held, 17)}")
            place += 1
        else:
            out.append("")
    return out


class Field:
    """Weights: of features by label, of neighbouring labels, of labels of like tokens (symmetric)."""

    def __init__(self, words: np.ndarray | None = None, steps: np.ndarray | None = None, likes: np.ndarray | None = None):
        self.words = np.zeros((SLOTS, N)) if words is None else words
        self.steps = np.zeros((N, N)) if steps is None else steps
        self.likes = np.zeros((N, N)) if likes is None else likes

    def beliefs(self, g: Graph, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of nodes, of pairs of neighbours and of pairs of like tokens, by messages along all edges at once."""
        own = np.add.reduceat(self.words[g.features], g.first[:-1], axis=0) if len(g) else np.zeros((0, N))
        own = own + g.starts[:, None] * self.steps[0] + g.stops[:, None] * self.steps[:, 0]
        edges = np.concatenate([g.near, g.like])
        tie = np.concatenate([np.broadcast_to(self.steps, (len(g.near), N, N)), np.broadcast_to(self.likes, (len(g.like), N, N))])
        tie = tie - tie.max(axis=(1, 2), keepdims=True) if len(edges) else tie
        power, (a, b) = np.exp(tie), edges.T
        right, left = np.zeros((len(edges), N)), np.zeros((len(edges), N))  # messages to b and to a

        def gathered() -> np.ndarray:
            total = own.copy()
            np.add.at(total, b, right)
            np.add.at(total, a, left)
            return total

        for _ in range(passes if len(edges) else 0):
            total = gathered()
            from_a, from_b = _softmax(total[a] - left), _softmax(total[b] - right)
            right = _centred(np.log(np.einsum("ei,eij->ej", from_a, power) + 1e-300))
            left = _centred(np.log(np.einsum("ej,eij->ei", from_b, power) + 1e-300))
        total = gathered()
        pair = _softmax(total[a] - left)[:, :, None] * power * _softmax(total[b] - right)[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return _softmax(total), pair[: len(g.near)], pair[len(g.near) :]

    def spans(self, g: Graph) -> list[tuple[int, int, int, int]]:
        """(owner, start, kind, end) of runs of labelled tokens."""
        best = self.beliefs(g)[0].argmax(axis=1) if len(g) else []
        tied = {int(j) for j in g.near[:, 1]}
        out: list[list[int]] = []
        for i, label in enumerate(best):
            kind = KIND_OF[label]
            owner, a, b = g.spans[i]
            if kind < 0:
                continue
            if not BEGINS[label] and i in tied and KIND_OF[best[i - 1]] == kind:
                out[-1][3] = b
            else:
                out.append([owner, a, int(kind), b])
        return [tuple(x) for x in out]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return x / x.sum(axis=1, keepdims=True)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.max(axis=1, keepdims=True)


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Runs of neighbouring tokens of a text, with the spans (start, kind, end) inside; not those in which a pattern failed for length or digits, which are neither one nor the other."""
    found = list(tokens(text))
    spans = base_spans(text)
    held = {(m.start(), m.end()) for m in _SPACED.finditer(text) if len(_DIGITS.sub("", m[0])) > 19} | {(m.start(), m.end()) for m in _PLUS.finditer(text) if len(_DIGITS.sub("", m[0])) > 15}
    i = 0
    while i < len(found):
        j = i + 1
        while j < len(found) and 0 < found[j][0] - found[j - 1][1] <= 3 and all(c in _BETWEEN for c in text[found[j - 1][1] : found[j][0]]):
            j += 1
        a, b = found[i][0], found[j - 1][1]
        inside = [(s, k, e) for s, k, e in spans if s < b and e > a]
        if not any(s < b and e > a for s, e in held) and all(s >= a and e <= b for s, _, e in inside):
            yield text[a:b], [(s - a, k, e - a) for s, k, e in inside]
        i = j


def _labelled(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Label of each token: those inside a span have its kind; a token inside two has the first by start."""
    out = []
    for a, b in found:
        s, kind, _ = next(((s, k, e) for s, k, e in spans if s < b and e > a), (0, -1, 0))
        at = -1 if kind < 0 else LABELS.index(KINDS[kind])
        out.append(0 if at < 0 else at if a <= s or kind < 2 else at + 1)
    return out


def examples(texts: list[str], spliced: int = SPLICED, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) to learn from: the runs of the texts, and texts spliced of runs.

    Spliced texts hold runs side by side or apart, some twice, and some numbers
    a second time without their first token: these count as numbers, since the
    text shows the whole one too, and alone they don't. Some cards are written in
    groups of four.
    """
    runs = [r for t in texts for r in _runs(t)]
    full = [r for r in runs if r[1]]
    bare = [r for r in runs if not r[1]]
    by_kind = {k: [r for r in full if r[1][0][1] == k] for k in range(len(KINDS))}
    kinds = [k for k, r in by_kind.items() if r]
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = [("x " + t + " x", [(s + 2, k, e + 2) for s, k, e in spans]) for t, spans in runs[: 2 * spliced]]
    for _ in range(spliced if kinds else 0):
        parts: list[tuple[str, list[tuple[int, int, int]]]] = []
        for _ in range(int(rng.integers(1, 4))):
            run = pick(bare) if bare and rng.random() < 0.3 else pick(by_kind[pick(kinds)])
            parts.append(run)
            if rng.random() < 0.25:
                parts.append(run)
            if run[0].isdigit() and run[1] and run[1][0][1] == 2 and rng.random() < 0.4:
                t = pick(" -").join(re.findall("[0-9]{1,4}", run[0]))
                parts.append((t, [(0, 2, len(t))]))
            phone = [x for x in run[1] if x[1] == 3]
            cutting = re.match(r"\+[0-9]+[ ().-]+", run[0]) if phone and len(run[1]) == 1 and phone[0][0] == 0 else None
            if cutting:
                rest, n = run[0][cutting.end() :], phone[0][2] - cutting.end()
                where = rng.random()
                if where < 0.3:
                    parts.append((rest, [(0, 3, n)]))
                elif where < 0.5 and parts.count(run) == 1:
                    parts[-1] = (rest, [])
        text, spans = "x", []
        for i, (t, found) in enumerate(parts):
            text += " " if i and rng.random() < 0.4 else " x "
            spans += [(s + len(text), k, e + len(text)) for s, k, e in found]
            text += t
        out.append((text, spans))
    return out


def fit(texts: list[str], spliced: int = SPLICED) -> Field:
    """Ascent of the likelihood, with the beliefs of message passing for the expected counts. Without a span to learn from, all stays outside."""
    g, want = Graph(), []
    for i, (text, spans) in enumerate(examples(texts, spliced)):
        found = list(tokens(text))
        g.add(i, text, found)
        want += _labelled(found, spans)
    g.close()
    y, field = np.array(want, np.int64), Field()
    if not (y > 0).any():
        field.words[:, 0] = 1.0
        return field
    tables = [field.words, field.steps, field.likes]
    squares = [np.full(x.shape, 1e-6) for x in tables]
    seen = [np.zeros_like(x) for x in tables]
    owner = np.repeat(np.arange(len(g)), np.diff(g.first))
    np.add.at(seen[0], (g.features, y[owner]), 1)
    np.add.at(seen[1], (y[g.near[:, 0]], y[g.near[:, 1]]), 1)
    np.add.at(seen[1], (0, y[g.starts]), 1)
    np.add.at(seen[1], (y[g.stops], 0), 1)
    np.add.at(seen[2], (y[g.like[:, 0]], y[g.like[:, 1]]), 1)
    for _ in range(STEPS):
        p, near, like = field.beliefs(g, passes=8)
        due = [np.zeros_like(x) for x in tables]
        for k in range(N):
            due[0][:, k] = np.bincount(g.features, p[owner, k], minlength=SLOTS)
        due[1] += near.sum(axis=0)
        due[1][0] += p[g.starts].sum(axis=0)
        due[1][:, 0] += p[g.stops].sum(axis=0)
        due[2] += like.sum(axis=0)
        for i, x in enumerate(tables):
            grad = (seen[i] - due[i]) - SHRINK * len(g) / 100 * x
            if i == 2:
                grad = (grad + grad.T) / 2
            squares[i] += grad * grad
            x += RATE * grad / np.sqrt(squares[i])
    return field


def added(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a span of the field is of use: it must be what its kind is made of."""
    word = text[start:end]
    digits = _DIGITS.sub("", word)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", word))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", word)) and all(int(x) <= 255 for x in word.split("."))
    return is_card(digits) if kind == 2 else 10 <= len(digits) <= 15


def train(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """Learns from the base spans of at most `sample` texts of at most `chars` characters that hold a digit or an @: those of the smallest hashes of doc_id and text.

    A share of the hashes that holds about twice as many is kept first, so that no task orders many texts.
    """
    fit_for = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= chars))
    share = min(1.0, (2 * sample + 200) / max(1, fit_for.count()))
    h = F.xxhash64("doc_id", "text")
    near = fit_for.select(h.alias("h"), "text").where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = near.orderBy(F.pmod("h", F.lit(1 << 20)), "h", "text").limit(sample)
    return fit(list(dict.fromkeys(rows.toArrow()["text"].to_pylist())))


def all_spans(field: Field, column: pa.Array) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, kind, end) in order. Graphs hold the tokens of many texts, or a block of those of one."""
    base: list[list] = []
    more: list[list] = [[] for _ in range(len(column))]
    texts: dict[int, str] = {}
    g = Graph()

    def settle(g: Graph) -> None:
        for owner, s, kind, e in field.spans(g.close()) if len(g) else ():
            text = texts[owner]
            if added(text, s, kind, e):
                more[owner].append((s - (kind == 3 and text[max(0, s - 1) : s] == "("), kind, e))

    for i, scalar in enumerate(column):
        text = scalar.as_py() or ""
        base.append(base_spans(text))
        if not _HINT.search(text):
            continue
        texts[i], block = text, []
        for token in tokens(text):
            block.append(token)
            if len(block) == GRAPH:
                g.add(i, text, block)
                settle(g)
                g, block = Graph(), []
        g.add(i, text, block)
        if len(g) >= GRAPH // 4 or sum(map(len, texts.values())) > 1 << 24:
            settle(g)
            g, texts = Graph(), {}
    settle(g)
    out = []
    for own, extra in zip(base, more):
        free, at = [], 0
        reach = 0
        for s, kind, e in sorted(extra):
            while at < len(own) and own[at][0] < s:
                reach = max(reach, own[at][2])
                at += 1
            if reach <= s and not (at < len(own) and own[at][0] < e):
                free.append((s, kind, e))
        out.append((own, free))
    return out


SPAN = "struct<kind:string,start:long,end:long,added:boolean>"


@shielded("text")
def find(docs: DataFrame, field: Field, with_text: bool = True) -> DataFrame:
    """docs (text, ...) with private: the spans in order of start and kind, and redacted: the text with each span, or group of spans that overlap, replaced by its first kind in brackets.

    start and end count code points, the end is exclusive; added tells that the
    field found it. Base spans of different kinds may overlap, added ones
    overlap nothing. Null texts have no spans and stay null, empty ones
    stay empty. Texts are read whole; one with more than 40,000 tokens with a
    digit or @ is labelled in blocks of so many. Equal texts get equal results. With with_text=False text and
    redacted are left out. Columns with the added names are replaced.
    """
    kept = docs if with_text else docs.drop("text")
    rows = docs.select(*kept.columns, F.col("text").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast((field.words, field.steps, field.likes))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*held.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [sorted([(*x, False) for x in own] + [(*x, True) for x in extra]) for own, extra in all_spans(field, texts)]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "added": extra} for s, k, e, extra in x] for x in found], pa.list_(kind))
            out = [spans, pa.array([redact(t.as_py(), x) for t, x in zip(texts, found)], pa.string())] if with_text else [spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "private", *["redacted"] * with_text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, f"private array<{SPAN}>", *["redacted string"] * with_text]))


def redact(text: str | None, spans) -> str | None:
    """text with spans (start, kind, end, ...) in order replaced by their kinds in brackets."""
    if not text:
        return text
    out, at = [], 0
    for s, kind, e, *_ in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs), with_text=False)
    base = F.filter("private", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("private")).alias("spans"), F.size(F.filter("private", lambda s: s["added"])).cast("long").alias("n_added"))
