"""How the source of the registered streams is laid out: its micro-batches must keep all cores busy."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stagewatch.schema import EVENT_COLUMNS, EVENT_SCHEMA
from stagewatch.session import scratch_path
from stagewatch.sources import jsonlog as JL
from stagewatch.streaming import monitor as T


def _round(spark, n, tasks):
    """``n`` events of stage 0."""
    given = {"job_id": F.concat(F.lit("job-"), F.xxhash64("id").cast("string")), "stage_progress": F.lit(0),
             "time": F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
             "ingestion_batch_id": F.concat(F.lit("b"), F.col("id") % 100)}
    return spark.range(0, n, 1, tasks).select(*[given.get(c, F.lit(None)).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in EVENT_COLUMNS])


def test_a_file_of_the_source_is_read_by_many_tasks(spark):
    ev = _round(spark, 600_000, 1)
    dest = T.stage_rounds_source(ev, scratch_path(spark, "row-groups"))
    meta = [pq.read_metadata(f) for f in glob.glob(f"{dest}/part-*")]
    largest = max(meta, key=lambda m: m.num_rows)
    assert sum(m.num_rows for m in meta) == largest.num_rows == 600_000
    assert max(largest.row_group(i).num_rows for i in range(largest.num_row_groups)) <= 600_000 / 2
    assert spark.read.schema(EVENT_SCHEMA).parquet(dest).exceptAll(ev).isEmpty()


def test_many_tasks_leave_no_crowd_of_small_files(spark):
    cores = spark.sparkContext.defaultParallelism
    dest = T.stage_rounds_source(_round(spark, 5_000, 5 * cores), scratch_path(spark, "few-files"))
    meta = [pq.read_metadata(f) for f in glob.glob(f"{dest}/part-*")]
    assert sum(m.num_rows for m in meta) == 5_000 and sum(m.num_rows > 0 for m in meta) <= max(cores, T.MIN_SOURCE_FILES)


def test_a_log_is_not_written_by_the_slow_level(spark):
    """A faster level shows by its size, which is somewhat more than the default's."""
    ev, sizes = _round(spark, 50_000, 1), {}
    for level, options in {"used": JL.COMPRESSED, "default": {"compression": "gzip"}}.items():
        path = scratch_path(spark, "level")
        JL.to_log_records(ev).write.options(**options).json(path)
        sizes[level] = sum(len(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert sizes["default"] < sizes["used"] < 2 * sizes["default"]
