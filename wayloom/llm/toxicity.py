"""Toxicity: a linear-chain conditional random field tags toxic words, its marginals make document scores and offsets.

Labels are given per document only, so words are labelled weakly: forms (a word, or its first four, five or six
characters) that stand in far more toxic than clean documents of the sample, by a likelihood-ratio test, mark the
toxic words of toxic documents; every other word is clean. The field has two states; its features are the marked forms
of a word and of both neighbours, a bias and the transitions, fitted by gradient ascent on the penalised likelihood.
Forward-backward gives every word's marginal; the expected number of toxic words, their share and the highest marginal
go into a logistic document score; runs of words with a marginal of one half or more are the offending spans.

The fit runs on a bounded sample, by parameters of ``fit``: the ``sample_docs`` labelled rows with the smallest id hash whose
text has at most ``longest_text`` bytes, up to ``sample_bytes`` of text in all. Forms and document weights are learnt
from all of it, the field from its first texts in hash order that fit into ``chain_words`` words. The model, of at most ``MAX_FORMS`` forms, is what is broadcast. Scoring reads every whole
text; all texts of a batch are one chain with a restart at each text, solved blockwise (products inside blocks, one
pass over block ends, then inside again), so that a very long text costs no more per word than a short one.

Defined results: null and empty texts get the score of a text without any toxic word; rows are judged one by one;
labels without a document, null labels and repeated labels (toxic if any says so) are allowed; without labelled rows
of both kinds every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import plain_words

#: Bounds of the labelled sample, defaults of the parameters of ``fit``.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 64_000_000
LONGEST_TEXT = 640_000
CHAIN_WORDS = 500_000
MAX_FORMS = 20_000
LEAST_EVIDENCE = 25.0
STEPS = 40
RATE = 0.5
PENALTY = 1e-4
BLOCK = 64
WORDS_AT_ONCE = 600_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def forms_of(word: bytes) -> list[str]:
    """The word and its beginnings of four to six characters."""
    text = word.decode()
    return [f"={text}"] + [text[:n] for n in (4, 5, 6) if len(text) >= n]


@dataclass
class Model:
    prior: float
    forms: dict[str, int] = field(default_factory=dict)
    #: Weight of each form at the previous, the current and the next word; bias; log transitions.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 0)))
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic document score: intercept and three weights.
    document: np.ndarray | None = None


def _ratios(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward odds of the toxic state: a[t] = exp(e[t]) * (T01 + T11 a[t-1]) / (T00 + T10 a[t-1]), exp(e[t]) where first."""
    n = len(e)
    t = np.exp(moves)
    blocks = -(-n // BLOCK)
    grow = np.exp(np.concatenate([e, np.zeros(blocks * BLOCK - n)])).reshape(blocks, BLOCK)
    start = np.concatenate([first, np.zeros(blocks * BLOCK - n, bool)]).reshape(blocks, BLOCK)
    # A block maps the odds a to (p + q a) / (r + s a).
    p, q, r, s = np.zeros(blocks), np.ones(blocks), np.ones(blocks), np.zeros(blocks)
    for k in range(BLOCK):
        g, f = grow[:, k], start[:, k]
        up, uq = g * (t[0, 1] * r + t[1, 1] * p), g * (t[0, 1] * s + t[1, 1] * q)
        ur, us = t[0, 0] * r + t[1, 0] * p, t[0, 0] * s + t[1, 0] * q
        p, q, r, s = np.where(f, g, up), np.where(f, 0.0, uq), np.where(f, 1.0, ur), np.where(f, 0.0, us)
        size = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / size, q / size, r / size, s / size
    entry = np.ones(blocks)
    a = 1.0
    for b, (bp, bq, br, bs) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        entry[b] = a
        a = (bp + bq * a) / (br + bs * a)
    out = np.empty((blocks, BLOCK))
    a = entry
    for k in range(BLOCK):
        g = grow[:, k]
        a = np.where(start[:, k], g, g * (t[0, 1] + t[1, 1] * a) / (t[0, 0] + t[1, 0] * a))
        out[:, k] = a
    return out.reshape(-1)[:n]


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of the toxic state at every word, with the forward and backward odds."""
    if not len(e):
        return e, e, e
    ahead = _ratios(e, first, moves)
    last = np.concatenate([first[1:], [True]])
    # The backward odds times exp(e) obey the forward recursion of the reversed chain with transposed moves.
    behind = _ratios(e[::-1], last[::-1], moves.T)[::-1] / np.exp(e)
    odds = ahead * behind
    return odds / (1.0 + odds), ahead, behind


def _potentials(codes: list[np.ndarray], first: np.ndarray, model: Model) -> np.ndarray:
    """Emission of each word from (place, form) pairs of its own and its neighbours' forms; neighbours end at text ends."""
    at, form = codes
    n = len(first)
    e = np.full(n, model.bias)
    np.add.at(e, at, model.weights[1, form])
    after = at + 1
    ok = (after < n) & ~first[np.minimum(after, n - 1)]
    np.add.at(e, after[ok], model.weights[0, form[ok]])
    before = at - 1
    ok = (before >= 0) & ~first[at]
    np.add.at(e, before[ok], model.weights[2, form[ok]])
    return e


class Coder:
    """Finds the forms of words; remembers words it has seen."""

    def __init__(self, forms: dict[str, int]) -> None:
        self.forms = forms
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def pairs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        seen, forms = self.seen, self.forms
        if len(seen) > 1_000_000:
            seen.clear()
        at: list[int] = []
        form: list[int] = []
        for place, word in enumerate(words):
            found = seen.get(word)
            if found is None:
                found = tuple(forms[f] for f in forms_of(word) if f in forms)
                seen[word] = found
            if found:
                at.extend([place] * len(found))
                form.extend(found)
        return np.array(at, np.int64), np.array(form, np.int64)


def _evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Likelihood-ratio statistic of a form in ``a`` of ``toxic`` and ``b`` of ``clean`` documents, 0 if it does not speak for toxic."""
    if a * clean <= b * toxic:
        return 0.0
    share = (a + b) / (toxic + clean)

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    own = part(a, toxic, a / toxic) + part(b, clean, b / clean)
    return 2 * (own - part(a, toxic, share) - part(b, clean, share))


def _document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: log of 1 + expected toxic words, log of 1 + their number in a hundred words, highest marginal."""
    out = np.zeros((len(bounds) - 1, 3))
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = total[bounds[1:]] - total[bounds[:-1]]
    n = np.maximum(1, np.diff(bounds))
    out[:, 0] = np.log1p(np.maximum(0.0, expected))
    out[:, 1] = np.log1p(np.maximum(0.0, 100.0 * expected / n))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full, 2] = np.maximum.reduceat(p, bounds[:-1][full])
    return out


def _first(bounds: np.ndarray) -> np.ndarray:
    first = np.zeros(bounds[-1], bool)
    starts = bounds[:-1][np.diff(bounds) > 0]
    first[starts] = True
    return first


def train(texts: list[str], toxic: list[int], chain_words: int = CHAIN_WORDS) -> Model:
    """Model from labelled texts; the field is fitted on at most ``chain_words`` words of them."""
    n_toxic = sum(toxic)
    n_clean = len(toxic) - n_toxic
    model = Model((n_toxic + 0.5) / (len(toxic) + 5.0))
    if not n_toxic or not n_clean:
        return model
    # Equal words are one object, and of the clean documents only forms that could mark toxic ones are counted: this runs on the driver.
    same: dict[bytes, bytes] = {}
    words = [[same.setdefault(w, w) for w in plain_words(t)] for t in texts]
    del same
    for_toxic: Counter[str] = Counter()
    for w, label in zip(words, toxic, strict=True):
        if label:
            for_toxic.update({f for one in set(w) for f in forms_of(one)})
    often = {f: a for f, a in for_toxic.items() if a > 2}
    del for_toxic
    for_clean: Counter[str] = Counter()
    for w, label in zip(words, toxic, strict=True):
        if not label:
            for_clean.update({f for one in set(w) for f in forms_of(one) if f in often})
    found = sorted(((-_evidence(a, for_clean[f], n_toxic, n_clean), f) for f, a in often.items()))
    kept = [f for score, f in found[:MAX_FORMS] if score <= -LEAST_EVIDENCE]
    model.forms = {f: i for i, f in enumerate(kept)}
    model.weights = np.zeros((3, len(kept)))
    coder = Coder(model.forms)

    chain: list[bytes] = []
    bounds = [0]
    labels: list[int] = []
    for w, label in zip(words, toxic, strict=True):
        if len(chain) + len(w) <= chain_words:
            chain.extend(w)
            bounds.append(len(chain))
            labels.append(label)
    ends = np.array(bounds)
    first = _first(ends)
    at, form = coder.pairs(chain)
    in_toxic = np.repeat(np.array(labels, bool), np.diff(ends))
    y = np.zeros(len(chain))
    y[at[in_toxic[at]]] = 1.0
    model.bias = -2.0
    n = max(1, len(chain))
    scale = 1e-8 + np.zeros(3 * len(kept) + 5)
    inner = np.flatnonzero(~first)
    want = np.zeros((2, 2))
    np.add.at(want, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
    after = at + 1
    ok_after = (after < n) & ~first[np.minimum(after, n - 1)] if len(at) else np.zeros(0, bool)
    ok_before = (at >= 1) & ~first[at] if len(at) else np.zeros(0, bool)
    for _ in range(STEPS):
        e = _potentials([at, form], first, model)
        p, ahead, behind = marginals(e, first, model.moves)
        gap = y - p
        grad = np.zeros((3, len(kept)))
        grad[1] = np.bincount(form, gap[at], len(kept))
        grad[0] = np.bincount(form[ok_after], gap[after[ok_after]], len(kept))
        grad[2] = np.bincount(form[ok_before], gap[at[ok_before] - 1], len(kept))
        t = np.exp(model.moves)
        left, right = ahead[inner - 1], np.exp(e[inner]) * behind[inner]
        joint = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right])
        have = (joint / joint.sum(0)).sum(1).reshape(2, 2) if len(inner) else np.zeros((2, 2))
        step = np.concatenate([(grad - PENALTY * n * 0.01 * model.weights).ravel(), [gap.sum()], (want - have).ravel()])
        scale += step * step
        step = RATE * step / np.sqrt(scale)
        model.weights = model.weights + step[: 3 * len(kept)].reshape(3, len(kept))
        model.bias += float(step[3 * len(kept)])
        model.moves = np.clip(model.moves + step[3 * len(kept) + 1 :].reshape(2, 2), -8.0, 8.0)

    rows = []
    for batch in _chains(words):
        rows.append(_document_features(*_marginals_of(batch, coder, model)))
    x = np.concatenate([np.ones((len(words), 1)), np.concatenate(rows)], axis=1)
    target = np.array(toxic, float)
    w = np.array([math.log(model.prior / (1 - model.prior)), 0.0, 0.0, 0.0])
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.05 * np.array([0.0, 1.0, 1.0, 1.0])
        slope = x.T @ (target - guess) - ridge * w
        curve = (x * (guess * (1 - guess))[:, None]).T @ x + np.diag(ridge + 1e-6)
        move = np.linalg.solve(curve, slope)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    model.document = w
    return model


def _chains(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part: list[list[bytes]] = []
    n = 0
    for w in texts:
        part.append(w)
        n += len(w)
        if n >= WORDS_AT_ONCE:
            yield part
            part, n = [], 0
    if part:
        yield part


def _marginals_of(texts: list[list[bytes]], coder: Coder, model: Model) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts], dtype=np.int64)])
    first = _first(bounds)
    codes = coder.pairs([one for w in texts for one in w])
    p, _, _ = marginals(_potentials(list(codes), first, model), first, model.moves)
    return p, bounds


def _scores(features: np.ndarray, model: Model) -> np.ndarray:
    if model.document is None:
        return np.full(len(features), model.prior)
    return 1 / (1 + np.exp(-np.clip(model.document[0] + features @ model.document[1:], -30, 30)))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Character offsets of runs of words with a marginal of at least one half, with the highest marginal of the run."""
    toxic = np.flatnonzero(p >= 0.5)
    if not len(toxic):
        return []
    places = [m.span() for m in WORD.finditer(text)]
    spans: list[dict] = []
    previous = -2
    for i in toxic.tolist():
        start, end = places[i]
        if i == previous + 1:
            spans[-1]["end"] = end
            spans[-1]["p"] = max(spans[-1]["p"], float(p[i]))
        else:
            spans.append({"start": start, "end": end, "p": float(p[i])})
        previous = i
    return spans


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, longest_text: int = LONGEST_TEXT, chain_words: int = CHAIN_WORDS
) -> Model:
    """Model from the bounded sample of labelled rows that are not held out; longer texts than ``longest_text`` bytes are not in it."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ids = marked.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_docs)
    chosen = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")  # at most sample_docs rows of two numbers
        .filter(F.octet_length("text") <= longest_text)
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", F.xxhash64("text"))
        .limit(sample_docs)
    )
    kept: list[tuple[str, int]] = []
    room = sample_bytes
    for row in chosen.select("text", "toxic").toLocalIterator():
        room -= len(row["text"])
        if room < 0:
            break
        kept.append((row["text"], row["toxic"]))
    return train([t for t, _ in kept], [y for _, y in kept], chain_words)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
ADDED = ("score", "predicted", "n_words", "n_toxic", "spans")


def _judged(batches: Iterator[pa.RecordBatch], place: int, model: Model) -> Iterator[tuple[pa.RecordBatch, list, list, list, list]]:
    """Each batch with the scores, word counts, expected toxic words and spans of the texts in its column ``place``."""
    coder = Coder(model.forms)
    for batch in batches:
        texts = batch.column(place)
        scores: list[float] = []
        counts: list[int] = []
        expected: list[float] = []
        spans: list[list[dict]] = []
        pending: list[list[bytes]] = []
        size = 0
        for i in range(len(texts) + 1):
            if pending and (i == len(texts) or size >= WORDS_AT_ONCE):
                p, bounds = _marginals_of(pending, coder, model)
                features = _document_features(p, bounds)
                scores.extend(_scores(features, model).tolist())
                expected.extend(np.expm1(features[:, 0]).tolist())
                done = len(spans)
                for j in range(len(pending)):
                    spans.append(spans_of(texts[done + j].as_py(), p[bounds[j] : bounds[j + 1]]) if features[j, 2] >= 0.5 else [])
                pending, size = [], 0
            if i < len(texts):
                words = plain_words(texts[i].as_py())
                counts.append(len(words))
                pending.append(words)
                size += len(words)
        yield batch, scores, counts, expected, spans


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score, predicted (1 from ``THRESHOLD`` on), n_words, n_toxic (expected toxic words) and spans in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c not in ADDED])
    place = rows.columns.index(text_col)
    others = [c for c in rows.columns if keep_text or c != text_col]
    kept = [rows.columns.index(c) for c in others]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, counts, expected, spans in _judged(batches, place, shared.value):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32()),
                 pa.array(counts, pa.int64()), pa.array(expected, pa.float64()), pa.array(spans, SPANS)],
                [*others, *ADDED],
            )

    return rows.mapInArrow(
        judge, f"{_schema(rows, others)}, score double, predicted int, n_words long, n_toxic double, spans array<struct<start:long,end:long,p:double>>"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, _, _, _ in _judged(batches, place, shared.value):
            yield batch.filter(pa.array([x < THRESHOLD for x in scores], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
