"""Row predicates and lookups.

All but ``filter_fn`` callables are Column expressions, so they stay in whole-stage
codegen and push down to parquet where the source allows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_range(df: DataFrame, start: Column, end: Column, part_col: str = "event_date",
                    unit: str = "day") -> Column | None:
    """The partition predicate implied by ``start <= time <= end`` on a table whose
    ``part_col`` is the day (or the first day of the ``unit``) of ``time``; None when
    the table has no such column. It lets a time filter prune partition folders."""
    if part_col not in df.columns:
        return None
    lo = F.to_date(start) if unit == "day" else F.trunc(F.to_date(start), unit)
    return (F.col(part_col) >= lo) & (F.col(part_col) <= F.to_date(end))


def time_range(df: DataFrame, start, end, col: str = "time", part_col: str = "event_date",
               unit: str = "day") -> DataFrame:
    """rows with ``start <= col <= end`` (literals or Columns). On a time-partitioned
    table the implied partition predicate is added, so only the partitions in range
    are listed and read."""
    s = start if isinstance(start, Column) else F.lit(start).cast(df.schema[col].dataType)
    e = end if isinstance(end, Column) else F.lit(end).cast(df.schema[col].dataType)
    cond = F.col(col).between(s, e)
    parts = partition_range(df, s, e, part_col, unit)
    return df.where(cond if parts is None else parts & cond)


def search_terms(pattern: str) -> list[str]:
    """Terms of a filter pattern: words and double-quoted phrases, all required. Only blanks and
    double quotes have a meaning; an open quote reaches to the end."""
    return [phrase or word for phrase, word in re.findall(r'"([^"]*)"?|([^\s"]+)', pattern) if phrase or word]


def text_search(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """rows whose text contains every term of ``pattern`` (case-sensitive)."""
    terms = search_terms(pattern)
    if not terms:
        return df
    cond = None
    for t in terms:
        c = F.col(text_col).contains(F.lit(t))
        cond = c if cond is None else cond & c
    return df.where(cond)


def search_page(df: DataFrame, text_col: str, pattern: str, key: str, page_size: int = 10,
                after: Column | object | None = None) -> DataFrame:
    """F7 paged: ``page_size`` matches after the cursor ``after`` in key order."""
    hits = text_search(df, text_col, pattern)
    if after is not None:
        hits = hits.where(F.col(key) > (after if isinstance(after, Column) else F.lit(after)))
    return hits.orderBy(key).limit(page_size)


def apply_predicate(df: DataFrame, filter_fn: Column | str | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """F8: keep rows matching a Column predicate, a SQL expression string (a user's
    bucket script such as ``"successful_jobs = num_jobs"``), or an opaque vectorised
    pandas predicate (a function of a pandas batch returning a boolean Series; the slow
    path, run batch-wise through Arrow)."""
    if isinstance(filter_fn, str):
        return df.where(F.expr(filter_fn))
    if isinstance(filter_fn, Column):
        return df.where(filter_fn)

    def run(batches):
        for pdf in batches:
            yield pdf[filter_fn(pdf).fillna(False).astype(bool).values]

    return df.mapInPandas(run, schema=df.schema)


def select_fields(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """source-field selection; the scan reads only these columns."""
    return df if not fields else df.select(*fields)


def get_one(df: DataFrame, id_col: str, doc_id) -> DataFrame:
    """the row(s) with the given id (pushed down as an equality filter)."""
    return df.where(F.col(id_col) == F.lit(doc_id))


def multi_get(df: DataFrame, id_col: str, ids: DataFrame, pos_col: str | None = None,
              fields: Sequence[str] | None = None) -> DataFrame:
    """one result row per requested id, in request order, with a ``found`` flag.

    ``ids`` has the requested ids in column ``id_col`` (and an optional position
    column) and may be of any size. The table is first reduced to the requested ids
    by a semi join (whose build side is the request list, broadcast by AQE when it
    measures it small), and only those hits are joined back to the request list, so a
    short list never shuffles the whole table.
    """
    keep = [c for c in (fields or df.columns) if c != id_col]
    wanted = ids.select(id_col).distinct()
    hits = df.join(wanted, id_col, "left_semi").select(F.col(id_col), *[F.col(c) for c in keep],
                                                        F.lit(True).alias("found"))
    out = ids.join(hits, id_col, "left").select(
        *([pos_col] if pos_col else []), id_col, F.coalesce(F.col("found"), F.lit(False)).alias("found"), *keep
    )
    return out.orderBy(pos_col) if pos_col else out
