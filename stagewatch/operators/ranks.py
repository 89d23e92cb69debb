"""Global order statistics: which rows stand at given ranks of a total order.

Keys are range-partitioned once, keys alone, and every range tells its number of rows and its greatest key.
Ranges are intervals of key values, so what they say holds whatever the sampled bounds were. The
interval that holds the wanted ranks is narrowed the same way until it holds few rows besides; only its
rows are then read and sorted. Comparisons with an interval's ends are expanded column by column, so
that scans skip files and row groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW = 20_000  # rows besides the wanted ones at which an interval is no longer narrowed


@dataclass(frozen=True)
class Interval:
    """Keys above ``low`` (None: from the first) up to and with ``high`` (None: to the last): ``rows`` of them, after ``before`` others."""

    low: tuple | None
    high: tuple | None
    before: int
    rows: int


def _portable(c: str, kind: T.DataType) -> Column:
    """A key as the driver can hold it without loss, whatever its time zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.col(c).cast("string") if isinstance(kind, T.TimestampNTZType) else F.col(c)


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def beyond(df: DataFrame, keys: Sequence[str], bound: tuple, inclusive: bool = False) -> Column:
    """(k1, k2, ...) > bound, nulls first, as a comparison of columns that a scan can use."""
    out = F.lit(inclusive)
    for k, value in reversed(list(zip(keys, bound))):
        kind = df.schema[k].dataType
        if value is None:
            out = F.col(k).isNotNull() | (F.col(k).isNull() & out)
        else:
            v = _literal(value, kind)
            out = (F.col(k) > v) | ((F.col(k) == v) & out)
    return out


def up_to(df: DataFrame, keys: Sequence[str], bound: tuple) -> Column:
    """(k1, k2, ...) <= bound, nulls first."""
    out = F.lit(True)
    for k, value in reversed(list(zip(keys, bound))):
        kind = df.schema[k].dataType
        if value is None:
            out = F.col(k).isNull() & out
        else:
            v = _literal(value, kind)
            out = F.col(k).isNull() | (F.col(k) < v) | ((F.col(k) == v) & out)
    return out


def within(df: DataFrame, keys: Sequence[str], interval: Interval) -> DataFrame:
    out = df if interval.low is None else df.where(beyond(df, keys, interval.low))
    return out if interval.high is None else out.where(up_to(df, keys, interval.high))


def ranges(df: DataFrame, keys: Sequence[str], interval: Interval | None = None) -> list[Interval]:
    """The interval (default: all keys) in parts of about equal size, in order: one range partition each. Reads the keys only."""
    inside = within(df, keys, interval) if interval else df
    # a given number, or small intervals would be coalesced to one range
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ks = inside.select(*keys).repartitionByRange(max(n, 2), *keys)
    greatest = F.max(F.struct(*keys)).alias("k")
    rows = ks.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), greatest).select(
        "p", "n", *[F.col(f"k.{k}").alias(k) for k in keys])
    rows = rows.select("p", "n", *[_portable(k, df.schema[k].dataType).alias(k) for k in keys]).collect()  # one row a partition
    out, low, before = [], interval.low if interval else None, interval.before if interval else 0
    for r in sorted(rows, key=lambda r: r["p"]):
        high = tuple(r[k] for k in keys)
        out.append(Interval(low, high, before, r["n"]))
        low, before = high, before + r["n"]
    return out


def around(df: DataFrame, keys: Sequence[str], first: int, last: int, few: int = FEW) -> tuple[Interval, int]:
    """An interval that holds the ranks ``first`` to ``last`` (from 1) and at most ``few`` rows besides, and the number of
    all rows. A key that more than ``few`` rows share cannot be parted; the interval then holds them."""
    parts = ranges(df, keys)
    total = parts[-1].before + parts[-1].rows if parts else 0
    wanted = max(0, min(last, total) - max(first, 1) + 1)
    while True:
        some = [p for p in parts if p.before < last and p.before + p.rows >= first]
        if not some:
            return Interval(None, None, total, 0), total
        found = Interval(some[0].low, some[-1].high, some[0].before, sum(p.rows for p in some))
        if found.rows <= wanted + few:
            return found, total
        # both ends' ranges are narrowed; what lies between is wanted as a whole
        ends = [some[0]] if len(some) == 1 else [some[0], some[-1]]
        finer = {e: ranges(df, keys, e) for e in ends}
        if all(len(f) < 2 for f in finer.values()):
            return found, total
        parts = [x for p in some for x in finer.get(p, [p])]
