"""Bounded output of update-mode streams: generations of the newest rows.

A stream's micro-batches go to ``dest/batch_id=b``. From time to time all complete batches are merged with the
last generation into a new one, the newest row of each key, under ``dest-generations``. A row of the manifest names
the generation and the last batch in it. The manifest row is written, in one file, after the generation
is whole, so readers see the old state or the new one; they take the named generation and the
batches after it. A batch that is replayed writes a folder that its generation already stands for,
or one that it does not yet: either way nothing changes.

What a generation replaced is removed one compaction later, for the readers that still use it. So a stream's
folders and the rows read stay bounded by its keys and the batches between compactions.

A sink compacts once the batches since the last generation hold twice the bytes of that generation, so all
rewriting together stays in proportion to what the stream has written, however many micro-batches it takes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders
from ..sources.sinks import latest_per_key

MANIFEST = "upto long, path string"


def manifest(spark: SparkSession, dest: str) -> list[tuple[int, str]]:
    """(last batch, path) of each generation, oldest first; those replaced twice are removed."""
    if not folders.exists(spark, f"{dest}-manifest"):
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{dest}-manifest").collect()  # a row a generation that still is
    return sorted((r["upto"], r["path"]) for r in rows)


def _batches(spark: SparkSession, dest: str) -> list[int]:
    return sorted(int(n.removeprefix("batch_id=")) for n in folders.children(spark, dest) if n.startswith("batch_id="))


def updates(spark: SparkSession, dest: str) -> DataFrame:
    """The last generation and the batches after it, with the ``_batch`` that each row came with."""
    found = manifest(spark, dest)
    if not found:
        return spark.read.parquet(dest).drop("batch_id")
    upto, path = found[-1]
    merged = spark.read.parquet(path)
    later = [f"{dest}/batch_id={b}" for b in _batches(spark, dest) if b > upto]
    return merged.unionByName(spark.read.schema(merged.schema).parquet(*later)) if later else merged


def compact(spark: SparkSession, dest: str, keys: Sequence[str]) -> int | None:
    """Merges the batches that are complete into a new generation and switches to it; the last batch in it, or None where
    there is nothing new. One compaction of a stream runs at a time (its sink's)."""
    found = manifest(spark, dest)
    upto = found[-1][0] if found else -1
    last = upto
    for b in _batches(spark, dest):
        if b > upto:
            if not folders.exists(spark, f"{dest}/batch_id={b}/_SUCCESS"):
                break  # half written: its replay comes first
            last = b
    if last == upto:
        return None
    rows = updates(spark, dest).where(F.col("_batch") <= last)
    path = f"{dest}-generations/upto={last}-{uuid.uuid4().hex}"
    latest_per_key(rows, keys, ["_batch"]).write.parquet(path)
    entry = spark.createDataFrame([(last, path)], MANIFEST).coalesce(1)
    entry.write.mode("append").parquet(f"{dest}-manifest")
    if found:
        _forget(spark, dest, found[-1])
    return last


def _forget(spark: SparkSession, dest: str, replaced: tuple[int, str]) -> None:
    """Removes the batches that the generation before held already, and generations older than it."""
    for b in _batches(spark, dest):
        if b <= replaced[0]:
            folders.remove(spark, f"{dest}/batch_id={b}")
    named = {p.rsplit("/", 1)[-1] for u, p in manifest(spark, dest) if u >= replaced[0]}
    for name in folders.children(spark, f"{dest}-generations"):
        if name not in named:
            folders.remove(spark, f"{dest}-generations/{name}")


def pays(spark: SparkSession, dest: str) -> bool:
    """Whether the batches after the last generation hold twice its bytes (true before the first generation)."""
    found = manifest(spark, dest)
    if not found:
        return True
    upto, path = found[-1]
    return sum(folders.size(spark, f"{dest}/batch_id={b}") for b in _batches(spark, dest) if b > upto) >= 2 * folders.size(spark, path)


def compacting_sink(write: Callable[[DataFrame, int], None], dest: str, keys: Sequence[str], every: int) -> Callable[[DataFrame, int], None]:
    """``write``, and at every ``every``-th micro-batch a compaction if it ``pays``."""

    def sink(df: DataFrame, batch_id: int) -> None:
        write(df, batch_id)
        if (batch_id + 1) % every == 0 and pays(df.sparkSession, dest):
            compact(df.sparkSession, dest, keys)

    return sink
