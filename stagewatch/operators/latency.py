"""Latency analysis of benchmark runs.

Percentiles are exact and linear (the continuous quantile) without gathering a
group's values in one place: runs are first counted per (group, exec_time) value, map
side, and the values at the wanted ranks are then selected over ranges of values, so that
neither a group's runs nor its distinct times have to fit into one task.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import query_type_name, store_display_name
from ..session import scratch_path

BOX = (("min_ms", None), ("q1_ms", 0.25), ("median_ms", 0.5), ("q3_ms", 0.75), ("max_ms", None))


def read_runs(runs: DataFrame) -> DataFrame:
    """Reads only, friendly store names, query type and scale from the operation."""
    op = F.col("operation")
    qt = F.split_part(op, F.lit("__"), F.lit(1))
    return runs.where(F.col("num_records").isNull()).select(
        "record_id",
        store_display_name("data_store").alias("data_store"),
        qt.alias("query_type"),
        query_type_name(qt).alias("query_type_name"),
        F.split_part(op, F.lit("__"), F.lit(2)).alias("scale"),
        F.col("exec_time").alias("exec_time"),
        "is_first_query",
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[tuple[str, float]]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group, plus ``n``, ``min``, ``max``; null values do not count.

    Values are counted map side and stored once as (group, value, count). Range partitions over group and value are
    the *cells* of a group, intervals of values with a count each. A running count over the cells
    alone tells which of them hold the wanted ranks; the values of these are walked, cell by cell."""
    spark = df.sparkSession
    path = scratch_path(spark, "value-counts")
    df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).write.parquet(path)
    hist = spark.read.parquet(path)
    cells = (hist.repartitionByRange(*keys, "_v").groupBy(*keys, F.spark_partition_id().alias("_p"))
             .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    by_group, running = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_lo")
    cells = cells.select(*keys, "_p", "_lo", "_hi", (F.sum("_c").over(running) - F.col("_c")).alias("_before"), "_c",
                         F.sum("_c").over(by_group).alias("n"), F.min("_lo").over(by_group).alias("min"), F.max("_hi").over(by_group).alias("max"))
    position = {name: F.lit(q) * (F.col("n") - 1) for name, q in quantiles}
    ranks = [f(position[name]) for name, _ in quantiles for f in (F.floor, F.ceil)]
    cells = cells.withColumn("_ranks", F.array_distinct(F.array(F.lit(0).cast("long"), *ranks))).where(
        F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
    values = hist.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", F.col("_c").alias("_each"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_v").between(F.col("_lo"), F.col("_hi"))]
    rows = values.join(cells, functools.reduce(operator.and_, same)).select(*keys, "_p", "_v", "_before", "n", "min", "max", "_each")
    walk = Window.partitionBy(*keys, "_p").orderBy("_v")
    rows = rows.withColumn("_to", F.col("_before") + F.sum("_each").over(walk))
    aggs = [F.first(c).alias(c) for c in ("n", "min", "max")]
    for name, _ in quantiles:
        lo, hi = F.floor(position[name]), F.ceil(position[name])
        aggs += [F.min(F.when(F.col("_to") > lo, F.col("_v"))).alias(f"_{name}_lo"), F.min(F.when(F.col("_to") > hi, F.col("_v"))).alias(f"_{name}_hi")]
    out = rows.groupBy(*keys).agg(*aggs)
    cols = [*keys, "n", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max")]
    for name, _ in quantiles:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (position[name] - F.floor(position[name])) * (hi - lo)).cast("double").alias(name))
    return out.select(*cols)


def box_summary(reads: DataFrame, scale: str = "8x") -> DataFrame:
    """N2 + N5: min, quartiles, max per (query type, store) at one scale, and the axis
    bound of each query type (largest max over its stores)."""
    at = reads.where(F.col("scale") == scale)
    out = exact_quantiles(at, ["query_type", "data_store"], "exec_time",
                          [(n, q) for n, q in BOX if q is not None])
    out = out.withColumnRenamed("min", "min_ms").withColumnRenamed("max", "max_ms")
    axis = F.max("max_ms").over(Window.partitionBy("query_type"))
    return out.select("query_type", "data_store", "n", "min_ms", "q1_ms", "median_ms", "q3_ms", "max_ms",
                      axis.alias("axis_max_ms"))


def first_query_times(reads: DataFrame, scale: str = "8x") -> DataFrame:
    """Cold (first) query times at one scale."""
    return reads.where((F.col("scale") == scale) & F.col("is_first_query")).select(
        "query_type", "data_store", "record_id", "exec_time"
    )


def scaling_means(reads: DataFrame, digits: int = 6) -> DataFrame:
    """Mean warm query time per (query type, store, scale)."""
    return reads.where(~F.col("is_first_query")).groupBy("query_type", "data_store", "scale").agg(
        F.round(F.avg("exec_time"), digits).alias("mean_ms"), F.count(F.lit(1)).alias("n")
    )


def scaling_table(reads: DataFrame, scales: Sequence[str], digits: int = 6) -> DataFrame:
    """N4 as a table: one mean column per scale. The scale list is given, so the pivot
    needs no extra pass to find its values."""
    warm = reads.where(~F.col("is_first_query"))
    return warm.groupBy("query_type", "data_store").pivot("scale", list(scales)).agg(
        F.round(F.avg("exec_time"), digits)
    )
