"""Distributed connected components (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is hung on the smallest of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (near.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are hung on the smallest of them. ``edges`` hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable type, in any direction, repeated or not, loops and
    nulls ignored -> ``(node, component)``: for each node with an edge the smallest node it
    can reach. No edges: no rows.

    Minima are aggregated before the shuffle, so a node with very many neighbours is
    never gathered in one task; its edges meet its one minimum in a join whose large
    partitions Spark splits. Each round is a written table, so no lineage builds up."""
    cur = (edges.where("u is not null and v is not null and u != v")
           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur = stored(cur, "cc")
    before = None
    while True:
        digest = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(digest) == before or digest[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = tuple(digest)
        cur = stored(_small_star(_large_star(cur)), "cc")
