"""Derive the event tables from the driver's data (FIXTURES.md).

``monitoring_events``: one order is one ingestion job; the job is expanded into its
stage events by the lifecycle operator (L1). ``benchmark_runs``: one ``events`` row is
one timed store operation. Both are narrow projections of a scan (no shuffle), so they
scale with their input and leave predicate pushdown to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import expand_jobs
from ..schema import JOB_TYPES, REPO_IDS
from .tables import read_table

# Fixture values (FIXTURES.md): user by o_custkey % 7, orgs by o_custkey % 7 < 5.
FIXTURE_USERS = ["0011", "0111", "1111", "1110", "1100", "0001", "1000"]
FIXTURE_STORES = ["ts", "rds", "elasticsearch", "cloudwatch_logs"]


def _pick(values: list[str], index: Column) -> Column:
    """values[index] with a literal array; index is a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def jobs_from_orders(orders: DataFrame) -> DataFrame:
    """One job row per order with its batch attributes and the stage it stops at."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    user_id = _pick(FIXTURE_USERS, c % 7)
    repo_id = _pick(REPO_IDS, k % 3)
    repo_version = (F.year(d) * 100 + F.month(d)).cast("string")
    failed = (k % 10) == 0
    return orders.select(
        F.concat_ws("__", repo_id, repo_version, user_id).alias("ingestion_batch_id"),
        F.when(c % 7 < 5, F.lit("1")).otherwise(F.lit("2")).alias("org_id"),
        user_id.alias("user_id"),
        repo_id.alias("repo_id"),
        repo_version.alias("repo_version"),
        F.when(prio.isin("1", "2"), "HIGH").when(prio == "3", "MEDIUM").otherwise("LOW").alias("priority"),
        F.concat(F.lit("job-"), k.cast("string")).alias("job_id"),
        _pick(JOB_TYPES, k % 3).alias("job_type"),
        d.alias("created_at"),
        F.concat(F.lit("DS"), c.cast("string")).alias("dataset_id"),
        F.when(failed, 1 + k % 7 % 5).otherwise(6).cast("int").alias("last_stage"),
        failed.alias("fails"),
        (k % 3600).cast("int").alias("start_offset_s"),
        d.alias("start_time"),
    )


def monitoring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``monitoring_events`` table derived from ``orders``."""
    orders = read_table(spark, sf_dir, "orders")
    return expand_jobs(jobs_from_orders(orders), step_seconds=20)


def benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``benchmark_runs`` table derived from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    is_write = (eid % 11) == 0
    op = F.when(is_write, F.lit("basic_write")).otherwise(
        F.format_string("query_type_%d__%dx", (1 + uid % 5).cast("int"), (1 + F.floor(val) % 8).cast("int"))
    )
    return ev.select(
        eid.cast("string").alias("record_id"),
        _pick(FIXTURE_STORES, eid % 4).alias("data_store"),
        op.alias("operation"),
        F.floor(val * 100).cast("long").alias("exec_time"),
        F.when(is_write, (1 + eid % 500).cast("int")).alias("num_records"),
        F.when(~is_write, (eid % 10) == 1).alias("is_first_query"),
    )
