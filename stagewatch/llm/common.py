"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewatch.session import scratch_path


#: Places of the bitmap by which rows are left out before they are shuffled.
BITS = 1 << 23
#: Rows of an Arrow batch, and bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and nothing else: other columns, whatever
    their names, cannot clash with what an operator adds."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def maybe_with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hashed doc_id is in the bitmap of ``ids(doc_id)``: all whose doc_id is among them, and
    few others while the ids are far fewer than ``BITS``, which bounds what is broadcast."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.expr("__place div 64"), F.expr("cast(__place % 64 as int)")
    held = (ids.select(place.alias("__place")).groupBy(word.alias("__word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits")))
    maybe = (docs.withColumn("__place", place).withColumn("__word", word).join(F.broadcast(held), "__word")
             .where(F.expr("getbit(__bits, cast(__place % 64 as int)) = 1")))
    return maybe.select(*docs.columns)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids(doc_id)``; most others are left out before texts are shuffled.
    An inner join with distinct ids: Spark would do a semi join before the one with the bitmap."""
    return maybe_with_ids(docs, ids).join(ids.distinct(), "doc_id").select(*docs.columns)


def shorten_batches(spark: SparkSession) -> dict[str, str]:
    """From now on Arrow batches of the session hold at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``: a batch of
    texts is held several times, in the executor and in its Python worker, and what it took there is hardly given
    back. Smaller limits stay. Returns the settings that were changed, as they were."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not ((n := now.rstrip("b")).isdigit() and 0 < int(n) <= most):
            before[key] = now
            spark.conf.set(key, most)
    return before


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """``shorten_batches`` while it lasts."""
    before = shorten_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: cuts the lineage,
    survives lost executors, and everything read from it is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def crc32_of(ids) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def comma_joined(parts: Sequence[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), ",")
