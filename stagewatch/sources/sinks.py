"""Writers for the event table.

Paths are never overwritten while read: an upsert writes a new generation next to
the old one and returns it. Writes are plain DataFrame writers, so a lost executor
only re-runs its tasks; the commit protocol keeps half-written files invisible.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import folders

MAX_RECORDS_PER_FILE = 1_000_000
# Id columns of the stored event table that get parquet bloom filters: job ids are not
# the leading sort key, so min/max statistics alone cannot skip for a job lookup.
BLOOM_COLUMNS = ("job_id", "ingestion_batch_id")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema (strict casts: bad values fail the write)."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def spread_for_write(df: DataFrame, partition_by: Sequence[str], within: Sequence[Column | str] = ()) -> DataFrame:
    """Cluster rows for a partitioned write without hot tasks.

    Hash-repartitioning by the partition column alone sends every row of a value (one
    day, say) to one task. Range partitioning on (partition columns, finer key) lets
    the sampled bounds split a big value over many tasks while small values share
    one, so files per value stay few and no task holds a hot value alone. The finer
    key defaults to a hash of the whole row (deterministic, so retries agree)."""
    finer = [F.col(c) if isinstance(c, str) else c for c in within] or [F.xxhash64(*[F.col(c) for c in df.columns])]
    return df.repartitionByRange(*[F.col(c) for c in partition_by], *finer)


def append_rows(df: DataFrame, path: str, schema: T.StructType | None = None,
                partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """S3: typed append. With ``partition_by``, rows are range-clustered by the
    partition columns first (``spread_for_write``) so each task writes few files."""
    out = conform(df, schema) if schema is not None else df
    w = out
    if partition_by:
        w = spread_for_write(out, partition_by)
    writer = w.write.mode("append").format(fmt).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def with_event_date(df: DataFrame, col: str = "time", name: str = "event_date", unit: str = "day") -> DataFrame:
    """Partition column for time-partitioned storage and retention: the day (default;
    tens of GB per day at full scale), or the month's first day for sparse tables."""
    d = F.to_date(F.col(col))
    return df.withColumn(name, d if unit == "day" else F.trunc(d, unit))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (last write wins).

    A max over a struct of (order, payload): an aggregate, so every task combines its
    rows before the shuffle and a hot key never gathers all of its versions."""
    payload = [c for c in df.columns if c not in keys]
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.max(F.struct(*[x.alias(f"_o{i}") for i, x in enumerate(o)], *[F.col(c) for c in payload])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], dest: str | None = None,
           order: Sequence[str] = ()) -> DataFrame:
    """Upsert by key, last write wins; written as a new generation (see ``merge_updates``).

    Returns the re-read result at ``dest`` (a fresh scratch path by default)."""
    spark = base.sparkSession
    merged = merge_updates(base, updates, keys, order)
    dest = dest or scratch_path(spark, "upsert")
    merged.write.mode("overwrite").parquet(dest)
    return spark.read.schema(merged.schema).parquet(dest)


def merge_updates(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``base`` with ``updates`` applied by key.

    Of several updates of a key the one with the greatest ``order`` counts, and a base row only if its order is
    greater still. Updates of a key between which nothing decides (the same order, or no order given, and
    other values) raise, whatever columns are read. The base keeps its rows without an update by an anti join, so
    while the updates are small no base row is shuffled."""
    cols = base.columns
    updates = updates.select(*cols)
    if order:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        updates = updates.withColumn("_rank", F.rank().over(w)).where("_rank = 1").select(*cols)
    once = updates.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols if c not in keys])
    undecided = F.raise_error(F.lit("updates hold a key twice and no order decides between them")).cast("boolean")
    once = once.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(undecided)).select(*cols)
    same = [base[k].eqNullSafe(updates[k]) for k in keys]
    kept = base.join(updates, same, "left_anti")
    if not order:
        return kept.unionByName(once)
    met = base.join(updates, same, "left_semi").withColumn("_gen", F.lit(0)).unionByName(once.withColumn("_gen", F.lit(1)))
    return kept.unionByName(latest_per_key(met, keys, [*order, "_gen"]).select(*cols))


def read_partitioned(spark, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned table by its declared types: inferred ones turn a text like ``0011`` into a number."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def append_with_ids(df: DataFrame, path: str, id_col: str = "_id") -> None:
    """S6 without ids: append with a generated unique id. Ids are most of what is stored; snappy would leave them as long as they are."""
    df.withColumn(id_col, F.expr("uuid()")).write.mode("append").option("compression", "zstd").parquet(path)


def fan_out(df: DataFrame, writers: Sequence[Callable[[DataFrame], None]]) -> None:
    """One event set to several sinks, each with its own encoding; the input is
    persisted once so the sinks do not recompute it."""
    cached = df.persist()
    try:
        for w in writers:
            w(cached)
    finally:
        cached.unpersist()


def copy_table(src: DataFrame, dest: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Copy with an optional field list; returns the copy."""
    out = src.select(*fields) if fields else src
    out.write.mode("errorifexists").parquet(dest)
    return src.sparkSession.read.parquet(dest)


def retained(df: DataFrame, as_of: Column, hours: int = 168, col: str = "time", part_col: str = "event_date",
             unit: str = "day") -> DataFrame:
    """Rows inside the retention window ending at ``as_of``; on a time-partitioned
    table only the partitions of the window are read."""
    from ..operators.predicates import partition_range

    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    cond = (F.col(col) >= start) & (F.col(col) <= as_of)
    parts = partition_range(df, start, as_of, part_col, unit)
    return df.where(cond if parts is None else parts & cond)


def expire_partitions(df: DataFrame, as_of_date: Column, days: int = 7, part_col: str = "event_date") -> DataFrame:
    """S15 on a day-partitioned table: keep partitions newer than the cut-off; the
    predicate is on the partition column, so expired folders are never listed for
    reading."""
    return df.where(F.col(part_col) > F.date_sub(as_of_date, days))


def drop_expired(spark: SparkSession, table_path: str, as_of_date: datetime.date, days: int = 7, part_col: str = "event_date") -> list[str]:
    """Removes the day partitions of a table that are older than ``days`` before ``as_of_date``, from storage; returns
    their names. Only folder names are looked at, no data are read or rewritten, and a day that is
    kept is not touched.

    What is to go is written down first, in one file beside the table. A run that fails halfway leaves that marker, and the next one
    finishes its removals before its own, so a day that has begun to go never stays half there."""
    marker = f"{table_path.rstrip('/')}-expiring"
    cut = as_of_date - datetime.timedelta(days=days)

    def day(name: str) -> datetime.date | None:
        try:
            return datetime.date.fromisoformat(name.removeprefix(f"{part_col}="))
        except ValueError:  # the null partition and other folders stay
            return None

    there = [n for n in folders.children(spark, table_path) if n.startswith(f"{part_col}=")]
    old = [n for n in there if (d := day(n)) is not None and d <= cut]
    if folders.exists(spark, f"{marker}/_SUCCESS"):
        old = sorted({*old, *(r["name"] for r in spark.read.parquet(marker).collect())})  # one row a day folder
    if not old:
        return []
    spark.createDataFrame([(n,) for n in old], "name string").coalesce(1).write.mode("overwrite").parquet(marker)
    gone = [n for n in old if folders.remove(spark, f"{table_path}/{n}")]
    folders.remove(spark, marker)
    spark.catalog.refreshByPath(table_path)
    return gone


def store_events(events: DataFrame, path: str, unit: str = "day") -> None:
    """Append to the event table as stored for reading, once per round of events (the first
    call makes the table): time-partitioned, and inside every
    partition range-clustered and sorted by (user, batch, job, time), so each file
    covers a narrow user and batch-id range and user/batch/job predicates skip files
    and row groups by their min/max statistics. One range shuffle; a hot day, user or
    batch is split across tasks."""
    part = with_event_date(events, unit=unit)
    order = ["user_id", "ingestion_batch_id", "job_id", "time"]
    w = (spread_for_write(part, ["event_date"], order)
         .sortWithinPartitions("event_date", *order)
         .write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))
    for c in BLOOM_COLUMNS:  # point lookups by id test a bloom filter before reading pages
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w = w.option("parquet.bloom.filter.adaptive.enabled", "true")  # sized by the actual ids
    w.partitionBy("event_date").parquet(path)


def append_to_table(df: DataFrame, name: str) -> None:
    """S3 into a catalog table: columns matched by name (insertInto is positional)."""
    spark = df.sparkSession
    cols = spark.table(name).columns
    df.select(*cols).write.insertInto(name)


def _journal(table_path: str) -> str:
    return f"{table_path.rstrip('/')}-upserting"


def _staged(spark: SparkSession, table_path: str) -> tuple[DataFrame, list[str]] | None:
    """The rows and partition columns of an upsert that is decided but perhaps not yet in the table's folders."""
    if not folders.exists(spark, f"{_journal(table_path)}/_SUCCESS"):
        return None
    entry = spark.read.parquet(_journal(table_path)).first()  # the journal has one row
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    # explicit schema: an empty update writes no files
    return read_partitioned(spark, entry["staging"], schema), list(entry["partition_by"])


def current_rows(spark: SparkSession, table_path: str, schema: T.StructType) -> DataFrame:
    """A table that ``upsert_partitions`` writes, never half of an upsert: while one is being published, its
    partitions are read from where they are staged and only the others from the table."""
    table = read_partitioned(spark, table_path, schema)
    pending = _staged(spark, table_path)
    if pending is None:
        return table
    rows, partition_by = pending
    touched = rows.select(*partition_by).distinct()
    same = [table[c].eqNullSafe(touched[c]) for c in partition_by]
    return table.join(touched, same, "left_anti").unionByName(rows.select(*schema.names))


def stage_upsert(table_path: str, updates: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
                 order: Sequence[str] = ()) -> T.StructType:
    """The first half of ``upsert_partitions``: everything but the replacement of the folders. The journal, written last,
    decides the upsert: readers by ``current_rows`` see all of it from then on, and none of it before."""
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be part of the key")
    spark = updates.sparkSession
    finish_upsert(spark, table_path)
    stored = spark.read.parquet(table_path).schema
    schema = T.StructType([updates.schema[f.name] if f.name in partition_by else f for f in stored])
    base = read_partitioned(spark, table_path, schema)
    touched = updates.select(*partition_by).distinct()
    same = [base[c].eqNullSafe(touched[c]) for c in partition_by]
    merged = merge_updates(base.join(touched, same, "left_semi").select(*schema.names), updates, keys, order)
    staging = scratch_path(spark, "upsert-staging")
    spread_for_write(merged, partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(staging)
    entry = (staging, list(partition_by), json.dumps(merged.schema.jsonValue()))
    (spark.createDataFrame([entry], "staging string, partition_by array<string>, schema string")
     .coalesce(1).write.mode("overwrite").parquet(_journal(table_path)))
    return schema


def finish_upsert(spark: SparkSession, table_path: str) -> bool:
    """The second half: the staged partitions replace the table's, then the journal goes. Repeatable: a run that failed
    anywhere in it is finished by the next one, from the same staged files. False if nothing was pending."""
    pending = _staged(spark, table_path)
    if pending is None:
        return False
    rows, partition_by = pending
    (spread_for_write(rows, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(table_path))
    folders.remove(spark, _journal(table_path))
    spark.catalog.refreshByPath(table_path)
    return True


def upsert_partitions(table_path: str, updates: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
                      order: Sequence[str] = ()) -> DataFrame:
    """S6 on a partitioned parquet table: last write wins, rewriting only the
    partitions the updates touch.

    1. The base rows of the touched partitions are read through a semi join on the
       partition columns (dynamic partition pruning skips untouched folders when its
       cost check finds the table large next to the updates).
    2. Base and updates are merged (``merge_updates``) into a staging folder under the
       shared checkpoint folder, so no path is overwritten while it is read.
    3. A journal beside the table, written in one commit, names the staged folder.
    4. The staged partitions replace the touched ones by dynamic partition overwrite;
       all other partitions stay as they are. Then the journal goes.
    A run that fails before 3 leaves the table as it was; after it, the next upsert finishes it first, and
    ``current_rows`` reads the whole result at any time. One writer at a time.
    Keys must not move between partitions, so the partition columns belong to the key. The
    partition columns' types are those of the updates, not inferred from folder names."""
    spark = updates.sparkSession
    schema = stage_upsert(table_path, updates, keys, partition_by, order)
    finish_upsert(spark, table_path)
    return read_partitioned(spark, table_path, schema)
