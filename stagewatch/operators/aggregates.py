"""Generic aggregation operators (A7, A9, A11, A12) used by the queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import _after


def earliest_latest(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``earliest_x`` / ``latest_x`` of each value column by the event order."""
    o = F.struct(*[F.col(c) for c in order_by])
    aggs = []
    for v in value_cols:
        aggs.append(F.min_by(v, o).alias(f"earliest_{v}"))
        aggs.append(F.max_by(v, o).alias(f"latest_{v}"))
    return df.groupBy(*keys).agg(*aggs)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (unique for stable results).

    ``row_number() <= n`` becomes a WindowGroupLimit whose partial step keeps at most n
    rows per group and partition before the shuffle, so a hot group ships little.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", F.row_number().over(w).cast("long").alias(rank_col)).where(F.col(rank_col) <= n)


def composite_page(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], size: int = 100,
                   after: Sequence[Column | object] | None = None) -> DataFrame:
    """One page of ``size`` buckets in key order, starting after key ``after``."""
    out = df.groupBy(*keys).agg(*aggs)
    if after is not None:
        cur = [c if isinstance(c, Column) else F.lit(c) for c in after]
        out = out.where(_after(keys, cur))
    return out.orderBy(*keys).limit(size)


def composite_after_key(page: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``after_key`` of a composite page: its largest key, one row."""
    return page.agg(F.max(F.struct(*[F.col(k) for k in keys])).alias("after_key"))


def time_bins(df: DataFrame, ts: str, width: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Fixed-width time bins (``'1 minute'``, ``'1 hour'``, ...) with aggregates."""
    b = F.window(F.col(ts), width)
    out = df.groupBy(*keys, b.alias("_bin")).agg(*aggs)
    return out.select(*keys, F.col("_bin.start").alias("bin_start"), *[c for c in out.columns if c not in (*keys, "_bin")])
