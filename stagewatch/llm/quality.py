"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its score uses features of the line and of its two
neighbours; transitions tie neighbouring labels. Forward-backward gives each line's
marginal of being good; the length-weighted mean of the marginals, calibrated on the
training documents, is the document's score.

Lines carry no labels of their own, so in training every line takes its document's label.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, short_batches

THRESHOLD = 0.3         # predicted = 1 from here
TRAIN_DOCS = 6000       # documents fitted on, at most: those with the smallest hash of their id
TRAIN_LINES = 200       # lines of each of these, at most: a run of lines that starts at a hashed place
HELD_OUT_FOLDS = 5      # crc32(doc_id as text) mod this: 0 is held out, never learnt from
STEPS, RATE, L2 = 250, 0.08, 1e-3

#: Classes of bytes: upper case, lower case (with all beyond ASCII), digit, usual punctuation, space, other.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2
_CLASS[[ord(c) for c in ".,;:'?-\"()"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_FEATURES = 12
LINES = 1 << 14         # lines scored together, or those of one text


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(lines, features)`` and the lines' lengths in bytes. An empty text is one empty line."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    out = np.zeros((len(lines), _FEATURES))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _CLASS[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for k in range(6):
        below = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k] = (below[np.minimum(starts + sizes, len(raw))] - below[starts]) / np.maximum(sizes, 1)
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            n = len(w)
            out[i, 6] = len(set(w)) / n ** 0.9
            out[i, 7] = sum(map(operator.eq, w, w[1:])) / n
            out[i, 8] = sum(map(len, w)) / n / 10
            out[i, 9] = min(n, 60) / 60
            out[i, 10] = line.rstrip()[-1] in b".!?"
        else:
            out[i, 11] = 1
    return out, sizes


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after (zeros beyond the text), and 1."""
    blank = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([blank, x[:-1]]), np.vstack([x[1:], blank]), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    """Weights of the score of *good* (bad: 0), transition scores [from, to], and the calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    shift: float


def forward_backward(scores: np.ndarray, lengths: np.ndarray, tr: np.ndarray):
    """``scores (chains, lines, 2)`` padded -> marginals, expected transitions, log partition; each chain on its own."""
    n, t, _ = scores.shape
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = scores[:, 0]
    for i in range(1, t):
        live = (i < lengths)[:, None]
        a = alpha[:, i - 1, :, None] + tr
        alpha[:, i] = np.where(live, np.logaddexp(a[:, 0], a[:, 1]) + scores[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        live = (i + 1 < lengths)[:, None]
        b = tr + (scores[:, i + 1] + beta[:, i + 1])[:, None, :]
        beta[:, i] = np.where(live, np.logaddexp(b[:, :, 0], b[:, :, 1]), 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
    pairs = np.zeros((2, 2))
    if t > 1:
        live = np.arange(1, t) < lengths[:, None]
        for p in range(2):
            for q in range(2):
                e = alpha[:, :-1, p] + tr[p, q] + scores[:, 1:, q] + beta[:, 1:, q] - z[:, None]
                pairs[p, q] = np.exp(np.minimum(e, 0))[live].sum()
    return marginal, pairs, z


def _padded(chains: list[np.ndarray]):
    lengths = np.array([len(c) for c in chains])
    x = np.zeros((len(chains), lengths.max(), chains[0].shape[1]))
    for i, c in enumerate(chains):
        x[i, :len(c)] = c
    return x, lengths


def _grouped(lengths: np.ndarray, cells: int = 1 << 16) -> Iterator[np.ndarray]:
    """Chains of like length together, so many that padded they hold about ``cells`` lines."""
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * lengths[order[j]] <= cells and lengths[order[j]] <= 2 * lengths[order[i]] + 4:
            j += 1
        yield order[i:j]
        i = j


def line_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights times ``with_neighbours(x)``, whose rows are not made."""
    k = x.shape[1]
    out = x @ weights[:k] + weights[-1]
    out[1:] += x[:-1] @ weights[k:2 * k]
    out[:-1] += x[1:] @ weights[2 * k:3 * k]
    return out


def line_marginals(scores: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """P(good) of every line of every chain of scores."""
    out: list = [None] * len(scores)
    lengths = np.array([len(s) for s in scores])
    for group in _grouped(lengths):
        n = lengths[group]
        s = np.zeros((len(group), n.max(), 2))
        for k, i in enumerate(group):
            s[k, :n[k], 1] = scores[i]
        m = forward_backward(s, n, model.transitions)[0]
        for k, i in enumerate(group):
            out[i] = m[k, :n[k], 1]
    return out


def _aggregate(marginals: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    return np.array([np.average(m, weights=s + 1.0) for m, s in zip(marginals, sizes)])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> Model:
    """Maximum likelihood by Adam, then a logistic calibration of the documents' scores.

    Without chains, or with one label only, every line's marginal is the same and the
    score is the smoothed share of label 1."""
    width = 3 * _FEATURES + 1
    if len(chains) == 0 or len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, float(_logit(np.array([share]))[0]))
    lengths = np.array([len(c) for c in chains])
    groups = [(g, *_padded([chains[i] for i in g])) for g in _grouped(lengths)]
    total = lengths.sum()
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, tr = theta[:width], theta[width:].reshape(2, 2)
        grad = np.zeros_like(theta)
        for g, x, n in groups:
            s = np.zeros((*x.shape[:2], 2))
            s[:, :, 1] = x @ w
            m, pairs, _ = forward_backward(s, n, tr)
            live = np.arange(x.shape[1]) < n[:, None]
            y = labels[g]
            grad[:width] += np.einsum("nt,ntf->f", (y[:, None] - m[:, :, 1]) * live, x)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = ((n - 1) * (1 - y)).sum(), ((n - 1) * y).sum()
            grad[width:] += (seen - pairs).ravel()
        grad = grad / total - L2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    raw = Model(theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0)
    z = np.column_stack([_logit(_aggregate(line_marginals([x @ raw.weights for x in chains], raw), sizes)), np.ones(len(chains))])
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, z.T @ (labels - p) - 1e-2 * (b - [1.0, 0.0])), -2, 2)
    return Model(raw.weights, raw.transitions, float(max(b[0], 0.0)), float(b[1]))


def held_out(doc_id) -> "F.Column":
    """True for the rows that no label is learnt from; a null doc_id is among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, quality, feats, sizes = b.column(0).to_pylist(), b.column(2).to_pylist(), [], []
        for doc_id, text in zip(ids, b.column(1)):
            x, s = line_features(text.as_py())
            x = with_neighbours(x)
            at = (doc_id * 2654435761) % (len(x) - TRAIN_LINES + 1) if len(x) > TRAIN_LINES else 0
            feats.append(x[at:at + TRAIN_LINES].astype("<f4").tobytes())
            sizes.append(s[at:at + TRAIN_LINES].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(feats, pa.binary()), pa.array(sizes, pa.binary())],
            ["doc_id", "quality", "x", "sizes"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample: the ``TRAIN_DOCS`` labelled ids outside the held-out fold
    with the smallest hash, ``TRAIN_LINES`` lines of each at most. Null labels and ids do not
    count; an id with contradicting labels has the larger; of texts under one id all are learnt from."""
    ids = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
           .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS))
    sample = (id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality")
              .mapInArrow(_chain_rows, "doc_id long, quality int, x binary, sizes binary").dropDuplicates(["doc_id", "x"])
              .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(TRAIN_DOCS))
    with short_batches(docs.sparkSession):
        sample = sample.collect()
    width = 3 * _FEATURES + 1
    return fit([np.frombuffer(r["x"], "<f4").reshape(-1, width).astype(float) for r in sample],
               [np.frombuffer(r["sizes"], "<i8") for r in sample], np.array([r["quality"] for r in sample], float))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Scores of whole texts (null: empty). At most ``LINES`` lines' scores wait at a time, and one text's features."""
    scores, chains, sizes, lines = [], [], [], 0
    for i, text in enumerate(texts, 1):
        x, s = line_features(text.as_py() or "")
        chains.append(line_scores(x, model.weights))
        sizes.append(s)
        lines += len(s)
        if lines >= LINES or i == len(texts):
            z = model.slope * _logit(_aggregate(line_marginals(chains, model), sizes)) + model.shift
            scores.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            chains, sizes, lines = [], [], 0
    return np.concatenate(scores) if scores else np.empty(0)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(_scores(b.column(0), model), pa.float64())], ["doc_id", "__score"])


def _good(batches: Iterator[pa.RecordBatch], text: int, model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(_scores(b.column(text), model) >= THRESHOLD))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null text scores as an empty one, an empty text as one empty line; equal texts score
    equally. A long text is one chain of all its lines; it takes some 200 bytes a line. A null doc_id counts as held out. Other columns are ignored; no rows give no rows."""
    scored = (id_and_text(docs).select("text", "doc_id")
              .mapInArrow(lambda it: _score(it, model), "doc_id long, __score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns as they were."""
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _good(it, text, model), docs.schema)
