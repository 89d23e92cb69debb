"""Exact largest integer inner products by the threshold algorithm.

Each block keeps, for every dimension, its rows sorted by that component. A query walks the
lists of all its non-zero components in step, from the end that its sign prefers, scores each
row when it first meets it, and stops when no unseen row can beat the k-th score: an unseen
row lies behind every list's current value, and within the longest row's norm. The bound is
the dual of that problem, valid for every multiplier tried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vectors

SCALE = 256
_EXACT = 2.0 ** 52
_FIRST_DEPTH = 64
_MULTIPLIERS = np.concatenate([[0.0], np.geomspace(0.05, 20, 25)])


def _bound(q: np.ndarray, limit: np.ndarray, longest: float) -> float:
    """No y with y <= limit and |y| <= longest has a larger q.y (q > 0)."""
    plain = float(q @ limit)
    if longest <= 0:
        return min(plain, 0.0)
    mu = _MULTIPLIERS[1:, None] * (np.sqrt(q @ q) / (2 * longest))
    y = np.minimum(limit, q / (2 * mu))
    dual = (q * y - mu * y * y).sum(axis=1) + mu[:, 0] * longest * longest
    least = min(plain, float(dual.min()))
    return least + 1e-9 * (1 + abs(least))


def _top(q: np.ndarray, own: np.ndarray, x: np.ndarray, order: np.ndarray, ranked: np.ndarray, longest: float, k: int):
    n = len(x)
    seen = np.zeros(n, bool)
    seen[own] = True
    used = np.flatnonzero(q)
    weight, up = np.abs(q[used]), q[used] < 0
    rows, scores = np.empty(0, np.int64), np.empty(0)
    depth, at = _FIRST_DEPTH, 0
    while True:
        end = min(depth, n)
        met = np.zeros(n, bool)
        for j, rising in zip(used, up):
            met[order[j, at:end] if rising else order[j, n - end:n - at]] = True
        if not len(used):
            met[:], end = True, n  # every row scores 0
        fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, x[fresh] @ q])
        best = np.lexsort((rows, -scores))[:k]
        rows, scores = rows[best], scores[best]
        if end == n or seen.all():
            return rows, scores
        # values at the lists' current ends, turned so that larger is better
        limit = np.where(up, -ranked[used, end - 1], ranked[used, n - end])
        if len(rows) == k and _bound(weight, limit, longest) < scores[-1]:
            return rows, scores
        at, depth = end, depth * 2


def _best(x: np.ndarray, qids: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int):
    largest = max(np.abs(x).max(), np.abs(y).max())
    out: list[list] = [[], [], []]
    order = np.ascontiguousarray(np.argsort(y, axis=0, kind="stable").T)
    ranked = np.take_along_axis(y.T, order, axis=1)
    longest = float(np.sqrt((y * y).sum(axis=1).max()))
    exact = largest * largest * y.shape[1] < _EXACT  # doubles hold every sum exactly
    for q, qid in zip(x, qids):
        own = np.arange(*np.searchsorted(ids, (qid, qid + 1)))  # ids are sorted
        if exact:
            rows, scores = _top(q, own, y, order, ranked, longest, k)
        else:  # components beyond 2**23 or so: Python integers, every row
            whole = y.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object)
            rest = [r for r in range(len(y)) if ids[r] != qid]
            rows = np.array(sorted(rest, key=lambda r: (-whole[r], r))[:k], np.int64)
            scores = [max(-2**63, min(2**63 - 1, whole[r])) for r in rows]
        out[0] += [int(qid)] * len(rows)
        out[1] += ids[rows].tolist()
        out[2] += [int(s) for s in scores]
    return out


def top_products(rows: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products of floor(scale * x) for each row
    whose vec_id ``every`` divides.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
    without vec_id; a zero vector does. Ties go by vec_id; each of several rows with one id is a
    candidate, save under the query's own id. Scores beyond a long are cut to it. No rows give
    no rows; other columns are ignored."""
    some = vectors.usable(rows).selectExpr("vec_id", f"transform(v, x -> double(floor({scale} * x))) as v")
    return vectors.search(some, every, k, "long", _best)
