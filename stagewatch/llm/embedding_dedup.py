"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class first. Classes are dealt into shards by a hash of their id, so that a
crowd of near copies is spread over all shards. Each shard's graph is built once and written as a table;
every shard is then asked for the neighbours of every vector that belongs to it or to an earlier
shard, so each pair of vectors is met in one direction only. What the beams find counts
as a link if its cosine, in double precision, reaches the threshold.

A beam is as wide as it has to be: a query whose beam holds nothing but links is asked again with
a wider one, until it has come past the last link; and a sample of each task's queries is compared
with the whole shard, and all its beams are widened until that audit passes. The widest beam
is the shard itself. A task returns no pairs: per vector the number of its links, and a star over each
of its local components, whose union gives the components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

THRESHOLD = 0.9
SHARD = 32768              # vectors of a shard, or fewer of long ones, while no more than SHARDS shards come of it
SHARDS = 64
SHARD_BYTES = 64 << 20     # of a shard's vectors, at most
QUERIES = 8192             # vectors of a shard that one task asks for
DEGREE = 16                # neighbours a vector chooses; twice as many are kept on the ground layer
BUILD_BEAM, BEAM, WIDER = 48, 32, 4
AUDIT, RECALL = 256, 0.995 # queries of a task that are compared with the whole shard; the share of their links to be found
BATCH = 512                # queries that advance together
STEP = 4                   # of a beam's vectors expanded together
SEED = 20250913
SLACK = 1e-6               # single precision navigates; what lies this close to the threshold is still verified
NODE = "shard int, at int, d int, id long, weight long, level int, v array<double>, links array<int>"


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(near: np.ndarray, sims: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (ids, -1: none; with their cosines) ``keep`` that lie nearer to the row's vector than
    to any one kept before, nearest first, and then the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    some = x[np.maximum(near, 0)]
    between = some @ some.transpose(0, 2, 1)
    valid = near >= 0
    covered = ~valid
    rows = np.arange(len(near))
    rank = np.full(near.shape, np.inf)
    rank[valid] = (near.shape[1] + np.broadcast_to(np.arange(near.shape[1]), near.shape))[valid]
    for step in range(keep):
        first = np.argmin(covered, axis=1)
        live = ~covered[rows, first]
        if not live.any():
            break
        rank[rows[live], first[live]] = step
        covered[rows[live], first[live]] = True
        covered |= live[:, None] & (between[rows, first] > sims)
    best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(rank, best, 1) < np.inf, np.take_along_axis(near, best, 1), -1)


def _beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest found from its entry point on one layer: ids (-1: none) and cosines."""
    m, n = len(q), len(links)
    ids = np.full((m, width), -1, np.int32)
    sims = np.full((m, width), -np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], open_[:, 0] = entry, True
    sims[:, 0] = (x[entry] * q).sum(axis=1)
    seen[np.arange(m), entry] = True
    step = min(STEP, width)
    live = np.arange(m)
    while len(live):
        todo = np.where(open_[live], sims[live], -np.inf)
        best = np.argpartition(-todo, step - 1, axis=1)[:, :step]
        rows, cols = np.nonzero(np.take_along_axis(todo, best, 1) > -np.inf)
        at = best[rows, cols]
        open_[live[rows], at] = False
        fresh = links[ids[live[rows], at]]
        rows, fresh = np.repeat(rows, fresh.shape[1]), fresh.ravel()
        some = fresh >= 0
        rows, fresh = rows[some], fresh[some]
        some = ~seen[live[rows], fresh]
        key = np.unique(rows[some].astype(np.int64) * n + fresh[some])
        rows, fresh = key // n, (key % n).astype(np.int32)
        if len(key):
            seen[live[rows], fresh] = True
            found = np.einsum("ij,ij->i", x[fresh], q[live[rows]])
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            more = int(place.max()) + 1
            new_ids = np.full((len(live), more), -1, np.int32)
            new_sims = np.full((len(live), more), -np.inf, np.float32)
            new_ids[rows, place], new_sims[rows, place] = fresh, found
            all_ids = np.concatenate([ids[live], new_ids], axis=1)
            all_sims = np.concatenate([sims[live], new_sims], axis=1)
            all_open = np.concatenate([open_[live], new_ids >= 0], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
        live = live[open_[live].any(axis=1)]
    return ids, sims


class Graph:
    """Layers of neighbours over vectors that are sorted by falling level: a layer holds the first so many."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, layers: list[np.ndarray]):
        self.x, self.levels, self.layers = x, levels, layers

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray) -> Graph:
        graph = cls(x, levels, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            graph.layers.insert(0, graph._layer(int((levels >= level).sum()), 2 * DEGREE if level == 0 else DEGREE))
        return graph

    def entries(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """Where each query ends on its way down through ``layers``."""
        entry = np.zeros(len(q), np.int64)
        for links in reversed(layers):
            ids, sims = _beams(self.x, links, q, entry, 4)
            entry = ids[np.arange(len(q)), sims.argmax(axis=1)].astype(np.int64)
        return entry

    def _layer(self, n: int, most: int) -> np.ndarray:
        links = np.full((n, most), -1, np.int32)
        x, done = self.x, 0
        while done < n:
            new = np.arange(done, min(n, done + BATCH))
            q = x[new]
            inside = q @ q.T
            inside[np.triu_indices(len(new))] = -np.inf     # earlier ones of the batch only
            near, sims = np.broadcast_to(new, inside.shape).astype(np.int32), inside
            if done:
                ids, cos = _beams(x, links[:done], q, np.minimum(self.entries(q, self.layers), done - 1), BUILD_BEAM)
                near, sims = np.concatenate([ids, near], axis=1), np.concatenate([cos, sims], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            near, sims = np.take_along_axis(near, top, 1), np.take_along_axis(sims, top, 1)
            chosen = _spread(np.where(sims > -np.inf, near, -1), sims, x, DEGREE)
            links[new, :chosen.shape[1]] = chosen
            rows, cols = np.nonzero(chosen >= 0)
            self._answer(links, chosen[rows, cols], new[rows])
            done = int(new[-1]) + 1
        return links

    def _answer(self, links: np.ndarray, of: np.ndarray, to: np.ndarray) -> None:
        """Links back; a vector with too many keeps those that spread best."""
        sims = np.einsum("ij,ij->i", self.x[of], self.x[to])
        order = np.lexsort((-sims, of))
        of, to = of[order], to[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        some = place < links.shape[1]
        of, to, place = of[some], to[some], place[some]
        nodes, at = np.unique(of, return_inverse=True)
        both = np.full((len(nodes), links.shape[1] + int(place.max(initial=-1)) + 1), -1, np.int32)
        both[:, :links.shape[1]] = links[nodes]
        both[at, links.shape[1] + place] = to
        over = (both >= 0).sum(axis=1) > links.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :links.shape[1]]
        links[nodes[~over]] = packed[~over]
        for i in range(0, int(over.sum()), BATCH):
            rows = np.flatnonzero(over)[i:i + BATCH]
            near = both[rows]
            cos = np.where(near >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(near, 0)], self.x[nodes[rows]]), -np.inf)
            links[nodes[rows]] = _spread(near, cos, self.x, links.shape[1])

    def near(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return _beams(self.x, self.layers[0], q, self.entries(q, self.layers[1:]), width)


def _levels(n: int, seed: int) -> np.ndarray:
    u = np.random.default_rng([SEED, seed]).random(n)
    return np.sort(np.floor(-np.log1p(-u) / np.log(DEGREE)).astype(int))[::-1]


def _lists(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[column].chunks])


def _index(table: pa.Table) -> pa.Table:
    """A shard's graph as rows; ``links`` of a vector: those of its ground layer, then of each layer above."""
    if not table.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "at": pa.array([], pa.int32()), "d": pa.array([], pa.int32()), "id": pa.array([], pa.int64()),
                         "weight": pa.array([], pa.int64()), "level": pa.array([], pa.int32()), "v": pa.array([], pa.list_(pa.float64())),
                         "links": pa.array([], pa.list_(pa.int32()))})
    table = table.sort_by("id")
    shard, d, n = table["shard"][0].as_py(), table["d"][0].as_py(), table.num_rows
    # which vectors are high up must not hang on their ids' order
    table = table.take(pa.array(np.random.default_rng([SEED, shard, n]).permutation(n)))
    levels = _levels(n, shard)
    graph = Graph.build(_units(_lists(table, "v").reshape(n, d)).astype(np.float32), levels)
    links = [np.concatenate([layer[i] for layer in graph.layers[:levels[i] + 1]]) for i in range(n)]
    return pa.table({"shard": table["shard"], "at": pa.array(np.arange(n), pa.int32()), "d": table["d"], "id": table["id"], "weight": table["weight"],
                     "level": pa.array(levels, pa.int32()), "v": table["v"], "links": pa.array(links, pa.list_(pa.int32()))})


def _graph(table: pa.Table, x: np.ndarray) -> Graph:
    levels = table["level"].to_numpy()
    flat = _lists(table, "links")
    sizes = 2 * DEGREE + DEGREE * levels
    starts = (np.cumsum(sizes) - sizes)[:, None]
    layers = [flat[starts + np.arange(2 * DEGREE)]]
    for level in range(1, int(levels.max()) + 1):
        layers.append(flat[starts[levels >= level] + 2 * DEGREE + DEGREE * (level - 1) + np.arange(DEGREE)])
    return Graph(x.astype(np.float32), levels, layers)


def _confirmed(rows, ids, q, x, least: float):
    """Which of the pairs (query, vector) have a cosine of at least ``least``, in double precision."""
    return np.einsum("ij,ij->i", q[rows], x[ids]) >= least


def _links(graph: Graph, q: np.ndarray, x: np.ndarray, width: int, least: float):
    """Pairs (query, vector) found with beams of ``width`` and wider where a beam holds nothing but links; a beam as
    wide as the shard reads all of it."""
    if width >= len(x):
        rows, ids = np.nonzero(q @ x.T >= least - SLACK)
    else:
        near, sims = graph.near(q.astype(np.float32), width)
        inside = sims >= least - SLACK
        full = inside.all(axis=1)
        rows, cols = np.nonzero(inside & ~full[:, None])
        ids = near[rows, cols].astype(np.int64)
        if full.any():
            again = np.flatnonzero(full)
            more, wide = _links(graph, q[again], x, width * WIDER, least)
            rows, ids = np.concatenate([rows, again[more]]), np.concatenate([ids, wide])
    some = _confirmed(rows, ids, q, x, least)
    return rows[some], ids[some]


def _audited(graph: Graph, q: np.ndarray, x: np.ndarray, least: float, own: np.ndarray) -> int:
    """The narrowest beam with which a sample of the queries finds ``RECALL`` of its links in the shard. ``own``
    places the queries in the shard (-1: not there); a vector's finding itself is no link."""
    chosen = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    sample, own = q[chosen], own[chosen]
    rows, ids = np.nonzero(sample @ x.T >= least - SLACK)
    some = _confirmed(rows, ids, sample, x, least)
    true, width = int((ids[some] != own[rows[some]]).sum()), BEAM
    while width < len(x):
        rows, ids = _links(graph, sample, x, width, least)
        if (ids != own[rows]).sum() >= RECALL * true:
            break
        width *= 2
    return width


class _Stars:
    """Components of a task's vectors, as links come in."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.least[self.least]
            if (up == self.least).all():
                return up
            self.least = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))


def _meet(threshold: float):
    def meet(queries: pa.Table, shard: pa.Table) -> pa.Table:
        """Links between the queries (one shard's vectors) and another shard's, or within one shard."""
        none = {"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "star": pa.array([], pa.int64())}
        if not shard.num_rows or not queries.num_rows:
            return pa.table(none)
        shard, queries = shard.sort_by("at"), queries.sort_by("id")
        d = shard["d"][0].as_py()
        x, ids, weights = _units(_lists(shard, "v").reshape(-1, d)), shard["id"].to_numpy(), shard["weight"].to_numpy()
        q, qids, qweights = _units(_lists(queries, "v").reshape(-1, d)), queries["id"].to_numpy(), queries["weight"].to_numpy()
        within = queries["home"][0].as_py() == shard["shard"][0].as_py()
        own = np.full(len(q), -1)
        if within:
            order = np.argsort(ids)
            own = order[np.searchsorted(ids[order], qids)]
        graph = _graph(shard, x)
        width = _audited(graph, q, x, threshold, own)
        counts, stars = np.zeros(len(x) + len(q), np.int64), _Stars(len(x) + len(q))
        at = own if within else len(x) + np.arange(len(q))
        for i in range(0, len(q), BATCH):
            rows, found = _links(graph, q[i:i + BATCH], x, width, threshold)
            rows = rows + i
            if within:
                some = found < own[rows]       # each pair from one side
                rows, found = rows[some], found[some]
            np.add.at(counts, at[rows], weights[found])
            np.add.at(counts, found, qweights[rows])
            stars.add(at[rows], found)
        names = np.concatenate([ids, qids])
        roots, some = stars.roots(), counts > 0
        return pa.table({"id": pa.array(names[some], pa.int64()), "links": pa.array(counts[some]), "star": pa.array(names[roots[some]], pa.int64())})

    return meet


def _per_length(values: dict) -> Column:
    out = F.lit(1)
    for d, value in values.items():
        out = F.when(F.col("d") == d, F.lit(value)).otherwise(out)
    return out


def vector_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, links, star`` of ``classes`` (id, d, v, weight): the links of each class found by each task, by weight, and one
    member of its component there."""
    counts = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row per length
    most = {d: max(1, min(max(SHARD, n // SHARDS), SHARD_BYTES // (8 * d))) for d, n in counts.items()}
    shards = _per_length({d: -(-n // most[d]) for d, n in counts.items()})
    blocks = _per_length({d: -(-min(n, most[d]) // QUERIES) for d, n in counts.items()})
    dealt = classes.select(F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"), "d", "id", "weight", "v")
    index = stored(dealt.groupBy("d", "shard").applyInArrow(_index, NODE).withColumn("shards", shards).withColumn("blocks", blocks), "graphs")
    keys = ["d", "asked", "home", "block"]
    queries = index.select(*[F.col(c).alias(c) for c in ("d", "id", "weight", "v")], F.col("shard").alias("home"),
                           F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int").alias("block"),
                           F.explode(F.expr("sequence(shard, shards - 1)")).alias("asked"))
    targets = index.withColumn("home", F.explode(F.expr("sequence(0, shard)"))).withColumn(
        "block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "d", F.col("shard").alias("asked"), "home", "block", "shard", "at", "id", "weight", "level", "v", "links")
    return queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(_meet(threshold), "id long, links long, star long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: the other rows with a cosine of at least ``threshold``, and
    the smallest vec_id that links reach.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows are vectors of their own even where they share an id. Rows without vec_id link with
    nothing, have no component and are kept. No rows give none; other columns are ignored."""
    v = vectors["embedding"].cast("array<double>")
    usable = ("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
              " and exists(v, x -> x != 0)")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
    rows = stored(rows.withColumn("v", F.when(F.coalesce(F.expr(usable), F.lit(False)), F.col("v"))), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "classes")
    links = stored(vector_links(classes, threshold), "vector-links")
    groups = stored(connected_components(links.select(F.col("id").alias("u"), F.col("star").alias("v"))), "vector-groups")
    ids = classes.select("id", "least")
    firsts = groups.join(ids, groups["node"] == ids["id"]).groupBy("component").agg(F.min("least").alias("first"))
    found = groups.join(firsts, "component").select(F.col("node").alias("id"), "first")
    per_class = (classes.join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(found, "id", "left")
                 .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("first")))
    out = rows.join(per_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                   F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
