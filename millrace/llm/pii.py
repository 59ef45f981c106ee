"""Personal data: base patterns, and a skip-chain conditional random field on top.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers; they always stay.  The field labels the tokens of a document that hold
a digit or an at sign (all others are outside).  Its potentials are

- node features of a token's shape,
- chain edges between marked tokens next to each other,
- skip edges from a token to the next one of the same form, and to the next one
  with the same digits or the same local part, however far away.

Loopy sum-product messages run on that graph, so a form that is personal data
in one place lends its label to the same or a similar form elsewhere.  A token
outside the base spans becomes a span of its own if its probability for a kind
is at least `sure` and a skip path ties it to a base span of that kind.

The weights are fitted here by pseudo-likelihood on a bounded sample of
documents (`sample_docs`, `sample_bytes`: ties of the hash go to smaller doc_ids, then texts), labelled by the base patterns; part
of the tokens have their own features hidden in training, so that the edges
carry weight.  Documents are labelled one by one, whole, inside tasks; skip
edges are one per token and form, not one per pair.

Defined results: null texts are empty ones; texts of any length are searched whole;
spans of one start are listed by kind, and equally likely labels go to the first; every row gives one row, repeated
doc_ids included; an empty table gives an empty result (and a field that adds
nothing); further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidied, uniform

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is outside

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digit runs are taken whole, which changes no match and keeps long runs linear
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z]+$")
MARK = "[0-9@]"

Span = tuple[int, int, int]  # start, kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; only what stands before an at sign is looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


@dataclass
class Graph:
    """Marked tokens of one text."""

    start: list[int]
    end: list[int]
    features: np.ndarray
    chain: np.ndarray  # (edges, 2)
    skip: np.ndarray
    base: np.ndarray  # label of the covering base span, 0 if none


def shape(core: str) -> list[float]:
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    dots = core.count(".")
    sizes = [digits == 0, 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 8, 9 <= digits <= 11, 12 <= digits <= 19, digits > 19]
    return [1.0, *map(float, sizes), "@" in core, "@" in core and "." in core.split("@")[-1], dots == 3 and letters == 0, core.startswith("+"), core.startswith("("), "-" in core, letters > 0, digits == len(core)]


N_FEATURES = len(shape("0"))


def graph(text: str, spans: list[Span]) -> Graph | None:
    start: list[int] = []
    end: list[int] = []
    rows: list[list[float]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    seen: dict[str, int] = {}
    before = -2
    for nth, m in enumerate(TOKEN.finditer(text)):
        token = m[0]
        if not any(c in "0123456789@" for c in token):
            continue
        core = EDGE.sub("", token) or token
        a = m.start() + token.find(core)
        i = len(start)
        start.append(a)
        end.append(a + len(core))
        rows.append(shape(core))
        if nth == before + 1:
            chain.append((i - 1, i))
        before = nth
        forms = {"=" + core.lower()}
        digits = NOT_DIGIT.sub("", core)
        if len(digits) >= 7:
            forms.add("#" + digits)
        if "@" in core:
            forms.add("@" + core.split("@")[0].lower())
        for linked in {seen[f] for f in forms if f in seen}:
            skip.append((linked, i))
        for f in forms:
            seen[f] = i
    if not start:
        return None
    base = np.zeros(len(start), np.int64)
    for a, kind, b in spans:
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        base[lo:hi] = np.where(base[lo:hi] == 0, kind + 1, base[lo:hi])
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(start, end, np.array(rows), pairs(chain), pairs(skip), base)


@dataclass(frozen=True)
class Field:
    node: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels): label of the token before, of the token after
    skip: np.ndarray  # (labels, labels), symmetric

    def beliefs(self, g: Graph, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of every token, by loopy messages; base labels are given."""
        n = len(g.start)
        local = g.features @ self.node
        local[g.base > 0] = -30.0
        local[g.base > 0, g.base[g.base > 0]] = 0.0
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            p = np.exp(local - local.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)
        potential = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            total = local.copy()
            np.add.at(total, target, messages)
            out = (total[source] - messages[back])[:, :, None] + potential
            top = out.max(1, keepdims=True)
            new = (np.log(np.exp(out - top).sum(1, keepdims=True)) + top)[:, 0]
            new -= new.max(1, keepdims=True)
            step = np.abs(new - messages).max()
            messages = damping * messages + (1 - damping) * new
            if step < 1e-4:
                break
        total = local.copy()
        np.add.at(total, target, messages)
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def tied_together(n: int, edges: np.ndarray) -> list[int]:
    """For each of n tokens, the smallest token that edges tie it to, over any number of them."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def added_spans(text: str, spans: list[Span], field: Field, sure: float) -> list[Span]:
    """Spans that the field adds to the base ones."""
    g = graph(text, spans)
    if g is None or not len(g.skip) or not (g.base == 0).any():
        return []
    group = tied_together(len(g.start), g.skip)
    tied: dict[int, set[int]] = {}
    for i in np.flatnonzero(g.base):
        tied.setdefault(group[i], set()).add(int(g.base[i]))
    open_ = [i for i in np.flatnonzero(g.base == 0) if group[i] in tied]
    if not open_:
        return []
    p = field.beliefs(g)
    out = []
    for i in open_:
        label = int(p[i].argmax())
        if label and p[i, label] >= sure and label in tied[group[i]]:
            out.append((g.start[i], label - 1, g.end[i]))
    return out


def fit_field(texts: list[str], *, steps: int = 200, rate: float = 0.5, hidden: float = 0.5, seed: int = 9) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels."""
    graphs = [g for g in (graph(t, base_spans(t)) for t in texts) if g is not None]
    none = Field(np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not graphs:
        return none
    rows, labels = [], []
    for g in graphs:
        y = np.eye(LABELS)[g.base]
        left, right, far = (np.zeros((len(y), LABELS)) for _ in range(3))
        for a, b in g.chain:
            left[b] += y[a]
            right[a] += y[b]
        for a, b in g.skip:
            far[a] += y[b]
            far[b] += y[a]
        rows.append(np.concatenate([g.features, left, right, far], 1))
        labels.append(y)
    x, y = np.concatenate(rows), np.concatenate(labels)
    masked = np.random.default_rng(seed).random(len(x)) < hidden
    x[masked, 1:N_FEATURES] = 0.0
    w = np.zeros((x.shape[1], LABELS))
    squares = np.full_like(w, 1e-8)
    for _ in range(steps):  # full-batch steps, scaled by past gradients
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = x.T @ (p - y) / len(x) + 1e-4 * w
        squares += gradient**2
        w -= rate * gradient / np.sqrt(squares)
    f, k = N_FEATURES, LABELS
    before, after, far = w[f : f + k], w[f + k : f + 2 * k], w[f + 2 * k :]
    return Field(w[:f], (before + after.T) / 2, (far + far.T) / 2)


def fit(docs: DataFrame, *, sample_docs: int = 1500, sample_bytes: int = 8 << 20, seed: str = "pii") -> Field:
    """Fit on the first `sample_docs` documents with a mark, by a hash of doc_id, up to `sample_bytes`."""
    prepare(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(MARK))
    ids = marked.select("doc_id").where("doc_id is not null").orderBy(uniform(F.col("doc_id"), seed), "doc_id").limit(sample_docs)
    # at most sample_docs ids: a proven bound
    chosen = marked.join(F.broadcast(ids.distinct()), "doc_id").orderBy(uniform(F.col("doc_id"), seed), "doc_id", "text")
    texts: list[str] = []
    held = 0
    for row in chosen.toLocalIterator():
        if held < sample_bytes:
            texts.append(row["text"])
            held += len(row["text"])
    return fit_field(texts)


SCHEMA = "doc_id long, base array<struct<start:int,kind:string,end:int>>, added array<struct<start:int,kind:string,end:int>>"


def find(docs: DataFrame, field: Field, *, sure: float = 0.9) -> DataFrame:
    """Per row: doc_id, base and added spans by start, then kind as listed (code points, ends exclusive)."""
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def named(spans: list[Span]) -> list[dict]:
        return [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            marked = pc.fill_null(pc.match_substring_regex(text, MARK), False).to_numpy(zero_copy_only=False)
            base: list[list[dict]] = [[] for _ in marked]
            added: list[list[dict]] = [[] for _ in marked]
            for i in np.flatnonzero(marked).tolist():
                t = text[i].as_py()
                spans = base_spans(t)
                if spans:
                    base[i] = named(spans)
                    added[i] = named(added_spans(t, spans, field, sure))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(tidied(run), SCHEMA)
