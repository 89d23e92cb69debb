"""Approximate nearest neighbours by collision counting (largest cosine).

Unit vectors are projected on ``LINES`` random lines; each line keeps its values sorted, per
block. A query starts with a narrow window around its own value on every line and counts,
for each vector, the lines on which it falls into the window. Virtual rehashing widens the
windows in proportion to a radius, adding only what is new at both ends. Whatever reaches the
collision threshold is verified in double precision; the search ends once ``k`` verified
vectors lie within the radius. A vector at the radius falls into a window with probability
0.866; the threshold lies two standard deviations below that, so about one in fifty of
the true neighbours is missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vectors

LINES = 64
HALF_WIDTH = 1.5     # of a window, in radii
IN_WINDOW = 0.8664   # probability of a collision at the radius
THRESHOLD = int(IN_WINDOW * LINES - 2 * np.sqrt(LINES * IN_WINDOW * (1 - IN_WINDOW)))
RADII = (0.25, 0.4, 0.6, 0.8, *np.arange(0.9, 2.0, 0.04).tolist(), 2.0)  # ever closer steps, relative to the radius; 2: every vector
SEED = 20240608
_REACH = 200.0       # no line of this length is drawn below some 30,000 dimensions


def _cosines(q: np.ndarray, norm: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (x * q).sum(axis=1) / (norms * norm)


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, so that no norm under- or overflows: cosines stay what they are, to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _nearest(q: np.ndarray, norm: float, own: np.ndarray, index, x: np.ndarray, norms: np.ndarray, k: int):
    """Row numbers and cosines of the k nearest found; ``own`` rows are no candidates."""
    values, order, at, shift = index  # of all lines, one after the other, each line's values in a range of its own
    n = len(x)
    counts = np.zeros(n, np.intp)
    counts[own] = -LINES - 1
    open_ = n - len(own)
    lo = hi = np.searchsorted(values, at + shift)
    done, rows, scores = np.zeros(n, bool), [], []
    for radius in RADII:
        h = np.minimum(HALF_WIDTH * radius, np.minimum(at + _REACH, _REACH - at))  # stay in the line's range
        a, b = np.searchsorted(values, [at + shift - h, at + shift + h])
        a, b = np.minimum(a, lo), np.maximum(b, hi)
        new = [order[i:j] for i, j in zip([*a.tolist(), *hi.tolist()], [*lo.tolist(), *b.tolist()]) if i < j]
        lo, hi = a, b
        if new:
            counts += np.bincount(np.concatenate(new), minlength=n)
        last = radius == RADII[-1]
        fresh = np.flatnonzero(((counts >= THRESHOLD) | (last & (counts >= 0))) & ~done)
        if len(fresh):
            done[fresh] = True
            rows.append(fresh)
            scores.append(_cosines(q, norm, x[fresh], norms[fresh]))
        found = np.concatenate(scores) if scores else np.empty(0)
        within = (found >= 1 - radius * radius / 2).sum()
        if within >= min(k, open_):
            break
    rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
    best = np.lexsort((rows, -found))[:k]
    return rows[best], found[best]


def _best(x: np.ndarray, qids: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int):
    lines = np.random.default_rng(SEED).standard_normal((y.shape[1], LINES))
    lines *= np.minimum(1, 0.99 * _REACH / _length(lines.T))  # no projection leaves the range
    x, y = _scaled(x), _scaled(y)
    norms = _length(y)
    projected = (y / norms[:, None]) @ lines
    ranks = np.argsort(projected, axis=0, kind="stable")
    shift = np.arange(LINES) * (2.0 * _REACH)
    values = (np.take_along_axis(projected, ranks, axis=0) + shift).T.ravel()
    order = ranks.T.ravel()
    own_norms = _length(x)
    out: list[list] = [[], [], []]
    for q, norm, qid, at in zip(x, own_norms, qids, (x / own_norms[:, None]) @ lines):
        own = np.arange(*np.searchsorted(ids, (qid, qid + 1)))  # ids are sorted
        rows, scores = _nearest(q, norm, own, (values, order, at, shift), y, norms, k)
        out[0] += [int(qid)] * len(rows)
        out[1] += ids[rows].tolist()
        out[2] += scores.tolist()
    return out


def nearest_neighbours(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each row whose vec_id ``every`` divides.

    Vectors that are null, zero, empty, or hold a null or non-finite component take no part, nor
    do rows without vec_id. Equal vectors tie and go by vec_id; each of several rows with one id
    is a candidate, save under the query's own id. No rows give no rows; other columns are ignored."""
    some = vectors.usable(rows).where("exists(v, x -> x != 0)")
    return vectors.search(some, every, k, "double", _best)
