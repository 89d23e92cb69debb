"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Components become whole numbers ``floor(SCALE * c) + SHIFT``, and a basis is fitted on each distinct
vector once. With A the centred rows over the square root of their number, the products Av and
A'u alternate, each one pass of Spark over the fit list; A V = U B with B small and upper
bidiagonal. B's singular values are the deviations along the components, V times its right
singular vectors are the components.

A left vector u has an entry for every row. It need not be kept: each is A y for a small y that
follows from the recurrence, so rows recompute their entries from y. The driver and every task
hold d x d numbers at most, whatever the number of rows, and a lost executor costs the tasks
that it ran, no state. Both sides are fully reorthogonalised in every step. A step that finds the
space exhausted goes on with a new direction, so that repeated deviations are found as often as
they occur; a space of lower rank has fewer components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
TOLERANCE = 1e-13   # of a triplet's residual, relative to the largest deviation
RANK = 1e-10        # deviations below this share of the largest are zeros
SEED = 20250712
SLIGHT = 1e-20      # a reorthogonalisation that moved less than this share (of the square) is not repeated
LARGEST = 2.0 ** 56 # components beyond it count as it, as their whole numbers are no longs
BLOCK_BYTES = 1 << 22
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the usable rows with their components as whole numbers."""
    v = vectors["embedding"].cast("array<double>")
    live = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where(
        "size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    within = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return live.select("vec_id", F.transform("v", lambda c: F.floor(within(c) * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(xs: pa.Array) -> np.ndarray:
    return xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), -1)


def _blocks(batches):
    """Distinct rows as blocks of bytes, which a pass reads without taking lists apart."""
    for batch in batches:
        for d in np.unique(batch.column("d").to_numpy()):
            x = _matrix(batch.filter(pa.compute.equal(batch.column("d"), d)).column("x")).astype("<i8")
            step = max(1, BLOCK_BYTES // (8 * int(d)))
            some = [x[i:i + step] for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(some), pa.int32()), "n": pa.array([len(b) for b in some], pa.int64()),
                                              "x": pa.array([b.tobytes() for b in some], pa.binary())})


def _sums(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of(block of rows)``, an array of fixed length: added up in each
    task, then over the tasks; the driver gets the sum alone."""

    def partial(batches):
        total = None
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x")):
                some = of(np.frombuffer(x.as_buffer(), "<i8").reshape(n, -1))
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total, pa.float64())})

    rows = fit.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.empty(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def _apart(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``w`` less its part in the rows of ``basis``, twice over."""
    for _ in range(2):
        w = w - basis.T @ (basis @ w)
    return w


def bidiagonalise(products: Callable, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of A, falling, and its right singular vectors as rows.

    ``products(z)`` gives, for w = A z, A'w and then |w|^2. The shares of w along earlier left vectors u = A y are
    y'A'w, and as A'u is known, what reorthogonalisation takes from w is taken from A'w without
    another pass, unless it was more than rounding. Steps go on until the residuals of the
    first ``wanted`` triplets are ``TOLERANCE``, or the space is spanned."""
    rng = np.random.default_rng(SEED)
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    right, left, images = np.empty((0, d)), np.empty((0, d)), np.empty((0, d))  # left: y of each u = A y; images: A'u
    alphas: list[float] = []
    betas: list[float] = []
    scale = 0.0
    while True:
        right = np.vstack([right, v])
        z = v - betas[-1] * left[-1] if betas else v
        for _ in range(2):
            found = products(z)
            back = found[:-1]
            shares = left @ back
            moved = float(shares @ shares)
            size = float(found[-1]) - moved
            z, back = z - left.T @ shares, back - images.T @ shares
            if moved <= SLIGHT * size:
                break
        alpha = float(np.sqrt(max(size, 0.0)))
        scale = max(scale, alpha)
        if alpha > RANK * scale:
            y, image = z / alpha, back / alpha
            w = _apart(image - alpha * v, right)
            beta = float(np.linalg.norm(w))
        else:
            alpha, y, image, w, beta = 0.0, np.zeros(d), np.zeros(d), np.zeros(d), 0.0
        alphas.append(alpha)
        left, images = np.vstack([left, y]), np.vstack([images, image])
        k = len(alphas)
        p, s, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        residual = beta * np.abs(p[-1])
        if k == d or (k >= wanted and beta > RANK * scale and (residual[:wanted] <= TOLERANCE * s[0]).all()):
            return s, qt @ right
        if beta <= RANK * scale:
            beta, w = 0.0, rng.standard_normal(d)
        betas.append(beta)
        v = _apart(w / np.linalg.norm(w), right)
        v /= np.linalg.norm(v)


def _totals(xs: DataFrame, d: int) -> tuple[int, list]:
    """The rows' number and the sum of each component, exact: tasks add halves of 32 bits, Spark adds theirs."""

    def partial(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for m, x in zip(batch.column("n").to_pylist(), batch.column("x")):
                x = np.frombuffer(x.as_buffer(), "<i8").reshape(m, -1)
                n, high, low = n + m, high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d + 1), pa.int32()), "high": pa.array(np.append(high, n)),
                                          "low": pa.array(np.append(low, 0))})

    whole = F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    rows = {r["i"]: (int(r["high"]), int(r["low"])) for r in xs.mapInArrow(partial, "i int, high long, low long").groupBy("i").agg(*whole).collect()}
    return rows[d][0], [(rows[i][0] << 32) + rows[i][1] for i in range(d)]


def fit(xs: DataFrame, d: int, components: int = COMPONENTS) -> dict:
    """The basis of the distinct vectors of length ``d``: count, sums, components as rows, deviations,
    explained shares, and the largest error of the whitened covariance. ``xs`` (blocks) is read some 2 d times."""
    n, sums = _totals(xs, d)

    def centred(x):
        return _less_mean(x, n, sums) / np.sqrt(n)

    def products(z):
        def of(x):
            a = centred(x)
            w = a @ z
            return np.append(a.T @ w, w @ w)

        return _sums(xs, of)

    trace = float(_sums(xs, lambda x: np.array([np.square(centred(x)).sum()]))[0])
    if trace == 0:
        return {"n": n, "sums": sums, "basis": np.empty((0, d)), "deviations": np.empty(0), "explained": np.empty(0), "error": 0.0}
    deviations, basis = bidiagonalise(products, d, min(components, d))
    some = (deviations > RANK * deviations[0]) & (np.arange(len(deviations)) < components)
    deviations, basis = deviations[some], basis[:len(some)][some]
    k = len(deviations)

    def covariance(x):
        w = _less_mean(x, n, sums) @ basis.T / deviations
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = _sums(xs, covariance)
    mean = found[k * k:] / n
    error = np.abs(found[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()
    return {"n": n, "sums": sums, "basis": basis, "deviations": deviations, "explained": deviations ** 2 / trace, "error": float(error)}


def _differences(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n x - S, exact: as longs, or as Python's integers where those may be too small."""
    most = max(abs(s) for s in sums) + n * int(np.abs(x).max(initial=1))
    if most < 2 ** 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _less_mean(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    return _differences(x, n, sums).astype(float) / n


def _deviations(x: np.ndarray, n: int, sums: list) -> list:
    """The sum of (n x - S)^2 of each row, exact; null beyond a long."""
    d = _differences(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) < 2 ** 63:
        return (d * d).sum(axis=1).tolist()
    return [t if t < 2 ** 63 else None for t in (sum(int(e) ** 2 for e in row) for row in d)]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries go; repeated rows and equal
    vectors count once in the fit and each come back; a null vec_id is kept. Vectors of different
    lengths are fitted apart. Components go by falling deviation, from 1; directions without any
    deviation are no components, so fewer may come back (none if all vectors are equal). A
    deviation beyond a long is null, components beyond ``LARGEST`` count as that. Other columns are ignored; no rows give none."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors).withColumn("d", F.size("x")), "scaled")
    distinct = stored(rows.select("d", "x").distinct().mapInArrow(_blocks, "d int, n long, x binary"), "fit")
    out = empty(spark, SCHEMA)
    for d in sorted(r["d"] for r in distinct.select("d").distinct().collect()):
        basis = fit(distinct.where(F.col("d") == d), d, components)
        out = out.unionByName(rows.where(F.col("d") == d).select("vec_id", "x").mapInArrow(_project(basis), SCHEMA))
    return out


def _project(basis: dict) -> Callable:
    n, sums, vs, deviations = basis["n"], basis["sums"], basis["basis"], basis["deviations"]
    k = len(deviations)

    def project(batches):
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column("x"))
            many = len(x)
            white = _less_mean(x, n, sums) @ vs.T / deviations
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                "n": pa.array(np.full(many * k, n), pa.int64()),
                "deviation": pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                "whitened": pa.array(white.ravel(), pa.float64()),
                "explained": pa.array(np.tile(basis["explained"], many), pa.float64()),
                "identity_error": pa.array(np.full(many * k, basis["error"]), pa.float64())})

    return project
