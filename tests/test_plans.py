"""Physical-plan properties the design relies on, checked on the stored event table."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stagewatch.operators import aggregates as A
from stagewatch.operators import monitoring as M
from stagewatch.operators import paging as P
from stagewatch.session import scratch_path
from stagewatch.sources.derive import monitoring_events
from stagewatch.sources.sinks import store_events


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "plan-test")
    store_events(monitoring_events(spark, SF_SMALL), path, unit="month")
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_user_filter_reaches_parquet(stored):
    p = plan(M.completed_batches(stored, "1110"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,1110)]" in p


def test_batch_filter_and_pruning_reach_parquet(stored):
    p = plan(M.latest_job_status(stored, "16311212173__199501__1110"))
    assert "EqualTo(ingestion_batch_id,16311212173__199501__1110)" in p
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", p).group(1)
    cols = sorted(c.split("#")[0] for c in scanned.split(","))
    assert cols == ["errored", "event_date", "ingestion_batch_id", "job_id", "stage", "stage_progress", "time"]


def test_latest_status_combines_before_its_one_shuffle(stored):
    p = plan(M.latest_job_status(stored))
    # the row's own stage text is carried, a text: a sorted aggregate, with a partial step before the shuffle
    assert p.count("SortAggregate(key=[job_id") == 2 and p.count("Exchange hashpartitioning(job_id") == 1 and "Window" not in p


def test_top_k_rollup_broadcasts_only_the_key_set(stored):
    p = plan(M.batch_rollup(stored))
    assert "LeftSemi" in p and "BroadcastExchange" in p
    assert "TakeOrderedAndProject(limit=100" in p
    assert "SortMergeJoin" not in p


def test_top_one_per_group_limits_before_the_shuffle(stored):
    for df in (M.latest_job_status_page(stored), A.top_n_per_group(stored, ["job_id"], [F.col("time").desc()], 2),
               M.latest_job_status_lateral(stored, stored.select("job_id"))):
        p = plan(df)
        assert "WindowGroupLimit" in p and "Partial" in p


def test_lateral_rollup_meets_the_ids_once(stored):
    p = plan(M.batch_rollup_lateral(stored))
    assert p.count("LeftSemi") == 1 and "Inner" not in p and "SortMergeJoin" not in p
    # the distinct ids; their rows by batch and job (distinct jobs); the roll-up by batch
    assert p.count("Exchange hashpartitioning(ingestion_batch_id") == 3


def test_a_clients_token_is_pushed_to_the_scan(stored):
    keys = ["time", "job_id", "stage_progress"]
    token = P.cursor_token(P.keyset_page(stored, keys, 10), keys, "next_cursor")
    assert P.cursor_token(stored.where("false"), keys, "next_cursor") is None
    page = P.keyset_page(stored, keys, 10, token)
    assert "GreaterThan(time," in plan(page).split("PushedFilters")[1][:300] and "ubquery" not in plan(page)
    rows = [tuple(r) for r in stored.select(*keys).orderBy(*keys).limit(20).collect()]
    assert [tuple(r) for r in page.select(*keys).collect()] == rows[10:]


def test_offset_page_is_bounded(stored):
    p = plan(P.offset_page(stored, 100, 100, ["job_id", "stage_progress"]))
    assert "TakeOrderedAndProject(limit=200" in p


def test_single_distinct_has_no_expand(stored):
    p = plan(M.finished_per_minute(stored))
    assert "Expand" not in p and "PushedFilters: [IsNotNull(stage), EqualTo(stage,Finished)" in p


def test_earliest_event_rollup_is_hash_aggregate(stored):
    for df in (M.batch_rollup_earliest(stored), M.completed_batches_by_user(stored)):
        p = plan(df)
        assert "SortAggregate" not in p and "ObjectHashAggregate" not in p


def test_filter_on_group_key_after_aggregate_is_pushed_to_the_scan(stored):
    p = plan(M.completed_batches_by_user(stored, "1110"))
    assert "EqualTo(user_id,1110)" in p.split("FileScan")[1]


def test_time_filters_prune_partitions(spark):
    from stagewatch.operators.predicates import time_range
    from stagewatch.sources.sinks import retained

    path = scratch_path(spark, "plan-days")
    store_events(monitoring_events(spark, SF_SMALL), path, unit="day")
    days = spark.read.parquet(path)
    q = time_range(days, "1996-01-01 00:00:00", "1996-01-07 23:59:59")
    p = plan(q)
    assert "PartitionFilters: [isnotnull(event_date" in p and "(event_date" in p.split("PartitionFilters")[1][:200]
    full = monitoring_events(spark, SF_SMALL)
    assert sorted(q.drop("event_date").collect()) == sorted(
        time_range(full, "1996-01-01 00:00:00", "1996-01-07 23:59:59").collect())
    as_of = F.lit("1996-01-07 12:00:00").cast("timestamp_ntz")
    r = retained(days, as_of, hours=48)
    assert "(event_date" in plan(r).split("PartitionFilters")[1][:200]
    assert r.count() == retained(full, as_of, hours=48).count()
