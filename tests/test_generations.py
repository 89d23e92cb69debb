"""Stream output in generations, open minutes, and retention that removes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewatch.operators import monitoring as M
from stagewatch.session import scratch_path
from stagewatch.sources import folders
from stagewatch.sources import sinks as SK
from stagewatch.sources.derive import monitoring_events
from stagewatch.streaming import compaction as G
from stagewatch.streaming import monitor as T
from conftest import SF_SMALL


def _batch(spark, b, keys=10):
    """Every batch updates half of the keys."""
    return spark.range(keys).where(F.col("id") % 2 == b % 2).select("id", F.lit(b).alias("v"))


def _state(spark, dest):
    return {r["id"]: r["v"] for r in T.read_latest(spark, dest, ["id"]).collect()}


def test_output_stays_bounded_over_many_batches(spark):
    dest = scratch_path(spark, "gen")
    sink = G.compacting_sink(T.batch_folder_sink(dest), dest, ["id"], 5)
    for b in range(40):
        sink(_batch(spark, b), b)
        if b % 13 == 0:
            assert _state(spark, dest) == {i: max(x for x in range(b + 1) if x % 2 == i % 2) for i in range(10) if b or i % 2 == 0}
    assert _state(spark, dest) == {i: 38 + i % 2 for i in range(10)}
    assert len(folders.children(spark, dest)) <= 10 and len(folders.children(spark, f"{dest}-generations")) == 2
    assert G.updates(spark, dest).count() <= 10 + 5 * 5


def test_replayed_and_half_written_batches(spark):
    dest = scratch_path(spark, "replay")
    sink = T.batch_folder_sink(dest)
    for b in range(4):
        sink(_batch(spark, b), b)
    assert G.compact(spark, dest, ["id"]) == 3 and G.compact(spark, dest, ["id"]) is None
    want = _state(spark, dest)
    sink(_batch(spark, 3), 3)                       # a replay of what the generation holds
    assert _state(spark, dest) == want
    sink(_batch(spark, 4), 4)
    sink(_batch(spark, 5), 5)
    folders.remove(spark, f"{dest}/batch_id=5/_SUCCESS")
    assert G.compact(spark, dest, ["id"]) == 4      # the half-written one waits for its replay
    sink(_batch(spark, 5), 5)
    assert _state(spark, dest) == {i: 4 + i % 2 for i in range(10)}
    assert G.compact(spark, dest, ["id"]) == 5 and _state(spark, dest) == {i: 4 + i % 2 for i in range(10)}


def test_a_compaction_that_fails_changes_nothing(spark, monkeypatch):
    dest = scratch_path(spark, "crash")
    sink = T.batch_folder_sink(dest)
    for b in range(3):
        sink(_batch(spark, b), b)
    want = _state(spark, dest)
    with monkeypatch.context() as m:
        m.setattr(G, "MANIFEST", "broken schema !")  # after the generation, before the manifest
        with pytest.raises(Exception):
            G.compact(spark, dest, ["id"])
    assert G.manifest(spark, dest) == [] and _state(spark, dest) == want
    assert G.compact(spark, dest, ["id"]) == 2 and _state(spark, dest) == want


def test_final_and_open_minutes_are_the_batch_answer(spark):
    ev = monitoring_events(spark, SF_SMALL)
    src, sink, ckpt = T.scratch_stream_paths(spark, "open")
    T.stage_rounds_source(ev, src)
    with T.state_partitions(spark, 2):
        T.finished_per_minute_stream(T.event_stream(spark, src, 1), sink, ckpt, lateness="365 days")
    got = T.finished_per_minute_result(spark, sink, ckpt)
    assert {r["final"] for r in got.select("final").distinct().collect()} == {True, False}
    want = sorted((r["repo_id"], r["interval_start"], r["num_jobs"]) for r in M.finished_per_minute(ev).collect())
    assert sorted(tuple(r)[:3] for r in got.collect()) == want


def _days(spark):
    path = scratch_path(spark, "days")
    df = spark.range(40).select("id", F.expr("timestampadd(DAY, cast(id % 10 as int), timestamp_ntz'2024-01-01 12:00:00')").alias("time"))
    df = df.unionByName(spark.createDataFrame([(99, None)], df.schema))
    SK.append_rows(SK.with_event_date(df), path, partition_by=["event_date"])
    return path


def test_expired_days_go(spark):
    path = _days(spark)
    before = {n: folders.children(spark, f"{path}/{n}") for n in folders.children(spark, path) if n >= "event_date=2024-01-07"}
    gone = SK.drop_expired(spark, path, dt.date(2024, 1, 10), 4)
    assert gone == [f"event_date=2024-01-0{d}" for d in range(1, 7)]
    assert {n: folders.children(spark, f"{path}/{n}") for n in before} == before
    left = spark.read.schema("id long, event_date date").parquet(path)
    assert left.count() == 4 * 4 + 1 and left.agg(F.min("event_date")).first()[0] == dt.date(2024, 1, 7)
    assert SK.drop_expired(spark, path, dt.date(2024, 1, 10), 4) == []


def test_an_interrupted_removal_is_finished(spark, monkeypatch):
    path = _days(spark)
    real, calls = folders.remove, []

    def failing(spark, p):
        calls.append(p)
        if len(calls) == 3:
            raise OSError("lost")
        return real(spark, p)

    with monkeypatch.context() as m:
        m.setattr(folders, "remove", failing)
        with pytest.raises(OSError):
            SK.drop_expired(spark, path, dt.date(2024, 1, 10), 4)
    assert SK.drop_expired(spark, path, dt.date(2024, 1, 2), 400) == [f"event_date=2024-01-0{d}" for d in range(3, 7)]
    assert not folders.exists(spark, f"{path}-expiring")
