"""Paging and ordered scans.

P1 ``offset_page``: rows page_after+1 .. page_after+page_size of an ordering, with
    ``row_num`` first, by rank selection (``ranks``) at every depth and in both directions.
P2 ``keyset_page`` / ``page_cursors``: cursor paging by a unique key; the predicate is
    an expanded lexicographic comparison that parquet can push down.
P3 ``sorted_scan``: filtered, projected, totally ordered scan (the full scroll).
S14 ``batch_numbers``: global 1-based row numbers and fixed-size batch numbers without
    a single-partition window: the sorted keys are checkpointed, each partition
    numbers its rows, and partition offsets come from a per-partition count.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .ranks import around, within


def offset_page(df: DataFrame, page_size: int, page_after: int, sort_by: str | Sequence[str],
                sort_order: str = "ASC") -> DataFrame:
    """P1. ``sort_by`` should be unique (add a tie-break column) for a stable page.

    The keys' ranges are counted when the page is built (``ranks.around``); the page itself reads and sorts only the
    rows of the interval that holds it, so a deep page costs what a shallow one does. A descending page is the
    ascending one of the ranks counted from the end; nulls are the smallest keys. The page comes in its order."""
    keys = [sort_by] if isinstance(sort_by, str) else list(sort_by)
    desc = sort_order.strip().upper() == "DESC"
    first, last = page_after + 1, page_after + page_size
    if desc:
        total = df.count()
        first, last = total - last + 1, total - first + 1
    interval, total = around(df, keys, first, last)
    order = [F.col(k).asc() for k in keys]
    rows = within(df, keys, interval).orderBy(*order).limit(max(min(last, total) - interval.before, 0))
    rank = F.row_number().over(Window.orderBy(*order)).cast("long") + interval.before
    page = rows.select(rank.alias("row_num"), *[F.col(c) for c in df.columns]).where(F.col("row_num").between(first, last))
    return page.withColumn("row_num", total + 1 - F.col("row_num")).orderBy("row_num") if desc else page.orderBy("row_num")


def _after(keys: Sequence[str], cursor: Sequence[Column], strict: bool = True, forward: bool = True) -> Column:
    """(k1, k2, ...) > (c1, c2, ...) (or < when not forward), expanded for pushdown."""
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        k, c = F.col(keys[i]), cursor[i]
        cmp = (k > c) if forward else (k < c)
        if i == len(keys) - 1:
            here = cmp if strict else (cmp | (k == c))
        else:
            here = cmp | ((k == c) & cond)
        cond = here
    return cond


def keyset_page(df: DataFrame, keys: Sequence[str], page_size: int,
                cursor: Sequence[object] | Column | None = None, direction: str = "next") -> DataFrame:
    """P2. The page after (``next``) or before (``prev``) ``cursor``, in key order.

    ``cursor`` is either key values (a client's token: expanded into a lexicographic
    predicate that parquet can push down) or a struct Column such as ``cursor_value``
    (compared as one struct, so its subquery runs once)."""
    forward = direction == "next"
    page = df
    if isinstance(cursor, Column):
        k = F.struct(*[F.col(c) for c in keys])
        page = df.where(k > cursor if forward else k < cursor)
    elif cursor is not None:
        cur = [c if isinstance(c, Column) else F.lit(c) for c in cursor]
        page = df.where(_after(keys, cur, forward=forward))
    order = [F.col(k).asc() if forward else F.col(k).desc() for k in keys]
    page = page.orderBy(*order).limit(page_size)
    return page if forward else page.orderBy(*[F.col(k).asc() for k in keys])


def page_cursors(page: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``prev_cursor`` = smallest key of the page, ``next_cursor`` = largest."""
    s = F.struct(*[F.col(k) for k in keys])
    return page.agg(F.min(s).alias("prev_cursor"), F.max(s).alias("next_cursor"))


def cursor_token(page: DataFrame, keys: Sequence[str], which: str) -> list | None:
    """A cursor of ``page`` as the key values that a client hands back with its next request: one row is read.
    None for an empty page. ``keyset_page`` pushes these values to the scan."""
    token = page_cursors(page, keys).first()[which]
    return None if token is None else list(token)


def cursor_value(cursor_df: DataFrame, which: str) -> Column:
    """A cursor of ``page_cursors`` (``prev_cursor``/``next_cursor``) as a struct-valued
    scalar subquery: nothing is collected to the driver."""
    return cursor_df.select(F.col(which)).scalar()


def sorted_scan(df: DataFrame, query: Column | None = None, sort_by: Sequence[Column | str] | None = None,
                fields: Sequence[str] | None = None, filter_fn: Column | None = None) -> DataFrame:
    """where(query).where(filter_fn).select(fields).orderBy(sort_by)."""
    out = df
    if query is not None:
        out = out.where(query)
    if filter_fn is not None:
        out = out.where(filter_fn)
    if fields is not None:
        out = out.select(*fields)
    if sort_by:
        out = out.orderBy(*sort_by)
    return out


def batch_numbers(df: DataFrame, order_by: Sequence[str], batch_size: int = 100) -> DataFrame:
    """``row_no`` (1-based, global order) and ``batch_no`` = (row_no - 1) // size.

    ``order_by`` must be a unique key. Only the keys are sorted and checkpointed, to the shared
    checkpoint folder, so the partition layout numbered by the two passes is one and the same
    and survives executor loss; the other columns join their numbers by key.
    """
    checkpoint_root(df.sparkSession)
    ordered = df.select(*order_by).orderBy(*order_by).checkpoint(eager=True)
    pid = F.spark_partition_id()
    # monotonically_increasing_id = partition index << 33 | row index in partition
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off")
    ).fillna(0, subset=["_off"])
    # One row per partition: a size bound known before the join.
    numbered = ordered.select("*", pid.alias("_pid"), local.alias("_local")).join(F.broadcast(offsets), "_pid")
    row_no = F.col("_off") + F.col("_local") + 1
    numbered = numbered.select(*order_by, row_no.alias("row_no"), F.floor((row_no - 1) / batch_size).cast("long").alias("batch_no"))
    if set(df.columns) > set(order_by):
        keys = numbered.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(order_by)], "row_no", "batch_no")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(order_by)]
        numbered = df.join(keys, functools.reduce(operator.and_, same))
    return numbered.select(*df.columns, "row_no", "batch_no")


def iter_pages(df: DataFrame, page_size: int = 100):
    """S16 at the edge: hand a result to a client page by page. Rows arrive one
    partition at a time (``toLocalIterator``), so the driver never holds the result."""
    page = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == page_size:
            yield page
            page = []
    if page:
        yield page
