"""Hot keys: one value holding most rows must still spread over many tasks."""

import pytest
from pyspark.sql import functions as F

from stagewatch.operators import lifecycle as L
from stagewatch.operators import monitoring as M
from stagewatch.sources.sinks import spread_for_write


@pytest.fixture(autouse=True)
def no_coalescing(spark):
    """Measure partitions as planned: AQE would merge these tiny partitions into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def _largest_task_share(df) -> float:
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(counts) / sum(counts)


def test_partitioned_write_splits_a_hot_day(spark):
    hot = spark.range(0, 60_000).select(
        F.when(F.col("id") % 10 < 9, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2024-02-"), (F.col("id") % 9 + 10).cast("string"))).alias("event_date"),
        F.col("id"))
    naive = hot.repartition("event_date")
    assert _largest_task_share(naive) >= 0.9  # what a hash repartition by day does
    spread = spread_for_write(hot, ["event_date"])
    assert _largest_task_share(spread) < 0.25


def test_hot_batch_pair_expands_in_many_tasks(spark):
    pairs = spark.createDataFrame([("r", "v", "0011", "1110", 200_000, 25), ("r", "w", "0001", "1000", 10, 50)],
                                  "repo_id string, repo_version string, first_user_id string, "
                                  "second_user_id string, num_jobs long, split_pct int")
    jobs = L.split_batch_pairs(pairs, chunk=1000)
    assert _largest_task_share(jobs) < 0.25
    assert jobs.count() == 200_010


def test_rollup_of_a_hot_batch_is_exact(spark):
    # one batch with a third of all events, the rest spread over many batches
    ev = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("b"), (F.col("id") % 500).cast("string"))).alias("ingestion_batch_id"),
        F.concat(F.lit("j"), (F.col("id") % 7000).cast("string")).alias("job_id"),
        (F.col("id") % 7 == 6).alias("finished"), F.lit(False).alias("errored"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("time"))
    r = {x.ingestion_batch_id: x for x in M.batch_rollup(ev, limit=None).collect()}
    assert r["hot"].num_jobs == ev.where("ingestion_batch_id = 'hot'").select("job_id").distinct().count()
    assert r["hot"].successful_jobs == ev.where("ingestion_batch_id = 'hot' AND finished").count()
