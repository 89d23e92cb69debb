"""Searches of a query set against all vectors, block against block.

Vectors are dealt into blocks of ``BLOCK`` rows by their place in the input, so that no value
decides where a row goes, and queries into blocks of ``QUERIES``. Every pair of blocks is
one group of bounded size, which returns its best few for each query; these are ranked."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 32768, 512


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part: an id, and a vector of finite numbers."""
    v = vectors["embedding"].cast("array<double>")
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def search(rows: DataFrame, every: int, k: int, score_type: str, best: Callable) -> DataFrame:
    """The ``k`` best rows for each query: ``query_id, rank, vec_id, score``, larger scores first, ties
    to the smaller vec_id.

    Queries are the rows whose id ``every`` divides; of several with one id, the one with the
    smallest vector. A query's own id is no candidate; vectors of another length are none either.
    ``best(queries, ids, vectors, k)`` gives (query index, vec_id, score) of a block."""
    n = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    nq = {r["d"]: r["n"] for r in asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}

    def blocks(counts: dict, size: int):
        out = F.lit(1)
        for d, c in counts.items():
            out = F.when(F.size("v") == d, F.lit(-(-c // size))).otherwise(out)
        return out

    at = F.monotonically_increasing_id()
    data = rows.withColumn("b", F.pmod(at, blocks(n, BLOCK)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), blocks(nq, QUERIES) - 1))).withColumn("d", F.size("v"))
    queries = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), blocks(nq, QUERIES)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), blocks(n, BLOCK) - 1))).withColumn("d", F.size("v"))
    kind = pa.float64() if score_type == "double" else pa.int64()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        cols: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            d = right["d"][0].as_py()
            x, y = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["v"].chunks]).reshape(-1, d) for t in (left, right))
            qids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            cols = best(x, qids, y[order], ids[order], k)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind))], ["query_id", "vec_id", "score"])

    keys = ["d", "b", "q"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(pair, f"query_id long, vec_id long, score {score_type}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
