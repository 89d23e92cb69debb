"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct five-word shingles. Equal sets form a class with
one node (its smallest doc_id). Every node stands in ``TREES`` sorted signature orders;
its place in an order is the path of that tree's minima, and a *region* is what shares
a prefix of the path. Regions are entered at depth ``BASE`` and deepened, each as far as
its own crowding asks for, until at most ``LEAF`` nodes share the prefix; these are
compared with one another. Wherever a region holds more than that, its pivot (the node
whose paths are the most crowded in all trees, in a family of copies the text that they come
from) is compared with every node of the region, at every depth. So a family of copies costs
work in proportion to its nodes, and a copy that resembles only the original meets it.
A region that is crowded at depth ``BASE`` is then completed across components: of each member's shingles,
the rarest among all members come first, and two sets that are linked share one of the first
``n - ceil(threshold * n) + 1``. Members of different components meet where they share such a shingle, if
their sizes and the shingle's places leave room for a link. All these bounds are exact, so crowding costs no
link; what a crowd has in common stands behind everyone's first shingles and brings nobody together.

Candidates of the forest whose signatures agree in fewer than ``MARGIN`` below the threshold of the places
are left out; a link is lost so with a probability of 4e-7 at a similarity of 0.85, and of 5e-6
at 0.80 where that is the threshold. All others are confirmed on the full sets, and the
confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, stored, with_ids
from .components import connected_components

WORDS = 5
PERCENT = 85          # link: 100 * intersection >= PERCENT * union
TREES = 20
BASE, DEPTH = 4, 8    # path length at which regions are entered, and the longest
LEVELS = range(BASE, DEPTH + 1)
LEAF = 8
BLOCK = 1024          # holders of one shingle that one task's key holds in the completion
MARGIN = 0.14         # of the share of agreeing places, 4.4 standard deviations at 160 places or more
SEED = 20240607

_CHUNK = 4096
_FLUSH = 100_000      # shingles of one batch sent back, besides those of its last text


class _WordHashes(dict):
    """64-bit hash by word; emptied when it has grown large, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingles:
    """Distinct word-shingle hashes of a text (sorted unsigned 64-bit integers)."""

    def __init__(self, words: int = WORDS):
        import re

        self.n, self.find, self.of = words, re.compile(rb"[^\x20\x09-\x0D]+").findall, _WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        found = self.find(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower(): A-Z only
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.of.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        np.minimum(out, (shingles[i:i + _CHUNK, None] * a).min(axis=0), out=out)
    return out >> np.uint64(32)


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingles, a = Shingles(words), _multipliers()
    for b in batches:
        ids, rows = b.column(0).to_pylist(), []
        for doc_id, text in zip(ids, b.column(1)):
            s = shingles(text.as_py())
            if not len(s):
                rows.append((doc_id, 0, None, None, None, None))
                continue
            raw = s.tobytes()
            sig = _signature(s, a)
            path = np.arange(TREES, dtype=np.uint64)
            keys = []
            for d, column in enumerate(sig.reshape(TREES, DEPTH).T):
                path = (path ^ column) * np.uint64(0x9E3779B97F4A7C15)
                path ^= path >> np.uint64(31)
                if d + 1 >= BASE:
                    keys.append(path)
            rows.append((doc_id, len(s), xxhash.xxh3_64_intdigest(raw) - 2**63, xxhash.xxh64_intdigest(raw) - 2**63,
                         (sig & np.uint64(255)).astype(np.uint8).tobytes(), np.stack(keys, 1).view(np.int64).ravel()))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "fp1", "fp2", "sketch", "keys"])


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: set size, two 64-bit fingerprints of the set, one byte of each
    signature place, and the path keys of all trees and levels (null without words)."""
    return id_and_text(docs).mapInArrow(
        lambda it: _sign(it, words),
        "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary, keys array<long>")


def candidate_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, keys)`` -> distinct pairs ``(a, b)``, a < b, that the forest proposes, and
    ``(node, region)`` of the regions that are crowded where they are entered."""
    n = len(LEVELS)
    k = [f"k{d}" for d in LEVELS]
    rows = nodes.select("node", F.explode(F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> slice(keys, t * {n} + 1, {n}))")).alias("p")).select(
        "node", *[F.col("p")[i].alias(c) for i, c in enumerate(k)])
    shared = rows.groupBy(k[0]).count().where("count > 1").select(k[0])
    rows = stored(rows.join(shared, k[0], "left_semi"), "forest")

    # A node weighs what its paths are crowded with in all trees; each region's pivot is its heaviest node.
    crowd = rows.groupBy(k[-1]).agg(F.count("*").alias("c"))
    weight = rows.select("node", k[-1]).join(crowd, k[-1]).groupBy("node").agg(F.sum("c").alias("w"))
    rows = stored(rows.join(weight, "node"), "weighed")
    upper = stored(rows.groupBy(*k).agg(F.count("*").alias("c"), F.max(F.struct("w", -F.col("node"))).alias("p")), "regions")
    info = upper.select(*k, F.col("c").alias(f"c{DEPTH}"), F.col("p").alias(f"p{DEPTH}"))
    for d in reversed(range(BASE, DEPTH)):
        over = k[:d - BASE + 1]
        upper = upper.groupBy(*over).agg(F.sum("c").alias("c"), F.max("p").alias("p"))
        info = info.join(upper.select(over[-1], F.col("c").alias(f"c{d}"), F.col("p").alias(f"p{d}")), over[-1])
    info = info.select(k[-1], *k[:-1], *[f"c{d}" for d in LEVELS], *[(-F.col(f"p{d}").getField("col2")).alias(f"p{d}") for d in LEVELS])
    placed = stored(rows.select("node", k[-1]).join(info, k[-1]), "placed")

    pivots = placed.select("node", F.explode(F.array_distinct(F.array_compact(F.array(
        *[F.when(F.col(f"c{d}") > LEAF, F.col(f"p{d}")) for d in LEVELS])))).alias("other"))
    leaf = F.xxhash64(F.lit(DEPTH + 1), f"k{DEPTH}", F.pmod(F.xxhash64("node"), F.ceil(F.col(f"c{DEPTH}") / LEAF)))
    for d in reversed(LEVELS):
        leaf = F.when(F.col(f"c{d}") <= LEAF, F.when(F.col(f"c{d}") > 1, F.xxhash64(F.lit(d), f"k{d}"))).otherwise(leaf)
    leaves = (placed.select("node", leaf.alias("leaf")).where("leaf is not null")
              .groupBy("leaf").agg(F.collect_set("node").alias("m")).where("size(m) > 1"))
    pairs = leaves.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as node, y as other))))")
    ).alias("e")).select("e.node", "e.other")
    crowded = placed.where(F.col(f"c{BASE}") > LEAF).select("node", F.col(k[0]).alias("region"))
    return _ordered(pairs.unionByName(pivots)), crowded


def _ordered(pairs: DataFrame) -> DataFrame:
    return (pairs.where("node != other")
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


def _shingle_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingles = Shingles(words)
    for b in batches:
        sets, held, rows = [], [], 0
        for i, text in enumerate(b.column(0), 1):
            h = shingles(text.as_py())
            sets.append(np.full(len(h), xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63, np.int64))
            held.append(h.view(np.int64))
            rows += len(h)
            if rows >= _FLUSH or i == b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.concatenate(held))], ["fp1", "h"])
                sets, held, rows = [], [], 0


def _first_shingles(sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``sets(fp1, n)`` -> ``(fp1, h, at)``: the shared ones of each set's first shingles, rarest first, and their places."""
    ids = sets.select(F.col("node").alias("doc_id")).distinct()
    texts = with_ids(id_and_text(docs), ids).select("text").distinct()
    rows = texts.mapInArrow(lambda it: _shingle_rows(it, words), "fp1 long, h long").join(sets.select("fp1").distinct(), "fp1", "left_semi")
    rows = stored(rows, "member-shingles")
    counts = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    # Shingles that no other member holds come before all others and meet nobody: their number is what n exceeds the others by.
    order = Window.partitionBy("fp1").orderBy("c", "h")
    placed = (rows.join(counts, "h").withColumn("rank", F.dense_rank().over(order)).withColumn("shared", F.max("rank").over(Window.partitionBy("fp1")))
              .join(sets.groupBy("fp1").agg(F.max("n").alias("n")), "fp1"))
    return placed.select("fp1", "h", (F.col("n") - F.col("shared") + F.col("rank") - 1).alias("at"), "n").where(
        f"at <= n - ceil({percent} * n / 100)").select("fp1", "h", "at").distinct()


def links_across(crowded: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(a, b)`` of nodes in different components that may be linked, of those in crowded regions that hold
    several components: all that share one of their first shingles, but for those that sizes and places rule out.

    ``crowded(node, region)``; ``found(node, component)``, a node without one being its own; ``nodes(node, fp1,
    n_shingles)``, several rows where a doc_id has several texts. A shingle with holders of one component
    brings none together. Otherwise the holders outside its largest component meet all of other components, in
    blocks of about ``BLOCK`` holders."""
    placed = stored(crowded.join(found, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component")), "crowded")
    mixed = placed.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("region")
    members = placed.join(mixed, "region", "left_semi").select("node", "component").distinct()
    sets = stored(members.join(nodes.select("node", "fp1", F.col("n_shingles").alias("n")), "node"), "members")
    held = stored(_first_shingles(sets, docs, words, percent).join(sets, "fp1"), "first-shingles")
    parts = (held.groupBy("h", "component").agg(F.count("*").alias("c"))
             .groupBy("h").agg(F.max(F.struct("c", -F.col("component"))).alias("largest"), F.count("*").alias("parts"), F.sum("c").alias("size"))
             .where("parts > 1").select("h", (-F.col("largest.col2")).alias("largest"), F.ceil(F.col("size") / BLOCK).alias("blocks")))
    held = held.join(parts, "h")
    outside = held.where("component != largest").select(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        *[F.col(c).alias(f"o_{c}") for c in ("node", "component", "n", "at")])
    held = held.select("h", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", "component", "n", "at")
    return _ordered(held.join(outside, ["h", "block"]).where(
        f"component != o_component and {percent} * greatest(n, o_n) <= 100 * least(n, o_n)"
        f" and least(n - at, o_n - o_at) * (100 + {percent}) >= {percent} * (n + o_n)").select("node", F.col("o_node").alias("other")))


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for i in (2, 3))
        keep = pa.array((x == y).mean(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    shingles, last, of_a = Shingles(words), None, None
    for b in batches:
        keep = []
        for a, x, y in zip(b.column(0), b.column(2), b.column(3)):
            x = x.as_py()
            if x != last:
                last, of_a = x, shingles(x)
            of_b = shingles(y.as_py())
            both = len(np.intersect1d(of_a, of_b, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(of_a) + len(of_b) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, exact: bool = False) -> DataFrame:
    """The pairs that the full sets confirm; of those not ``exact`` (already bounded by shingles) only such whose
    signatures agree enough."""
    if not exact:
        left, right = (nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        least = percent / 100 - MARGIN
        pairs = (pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
                 .mapInArrow(lambda it: _agreeing(it, least), "a long, b long").distinct())
    pairs = stored(pairs, "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = with_ids(id_and_text(docs), wanted)
    texts = stored(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h"), "texts")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
                  .mapInArrow(lambda it: _confirmed(it, words, percent), "a long, b long"), "links")


def class_nodes(named: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each class of equal sets. It is picked before the shuffle too: signatures
    are long, and are dealt out once."""
    return (named.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "keys")).alias("s"))
            .select(F.col("s.doc_id").alias("node"), "fp1", "s.n_shingles", "s.sketch", "s.keys"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id are one document (of several texts, if these differ), and each gets its row. A row
    without doc_id cannot be named by a link: it is its own component, with a null
    component_id, and kept. No rows give no rows; other columns are ignored."""
    signed = stored(signatures(docs, words), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
    in_class = named.select("doc_id", "fp1", "fp2").distinct().join(classes, ["fp1", "fp2"])
    nodes = stored(class_nodes(named), "nodes")

    pairs, crowded = candidate_links(nodes.select("node", "keys"))
    links = _links(pairs, nodes, docs, words, percent)

    # Copies have their class's node; the classes of several texts under one doc_id are linked.
    several = in_class.groupBy("doc_id").count().where("count > 1").select("doc_id")
    shared = in_class.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(shared))

    # What crowded regions still keep apart: links between components.
    more = _links(links_across(crowded, found, nodes, docs, words, percent), nodes, docs, words, percent, exact=True)
    of_a, of_b = (found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = connected_components(more.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")))
    member = (in_class.select("doc_id", "node").join(found, "node", "left")
              .select("doc_id", F.coalesce("component", "node").alias("part"))
              .join(joined.select(F.col("node").alias("part"), "component"), "part", "left")
              .groupBy("doc_id").agg(F.min(F.coalesce("component", "part")).alias("component")))
    return (signed.select("doc_id", "n_shingles").join(member, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.expr("doc_id <=> component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they were.

    Rows with a null doc_id all stay; of rows that repeat a kept doc_id one stays."""
    kept = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where(docs["doc_id"].isNull()))).select(*docs.columns)
