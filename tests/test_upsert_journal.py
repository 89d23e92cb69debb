"""Partitions published through a journal: no reader sees half of an upsert, whatever fails."""

import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F
from stagewatch.operators import monitoring as M
from stagewatch.session import scratch_path
from stagewatch.sources import folders
from stagewatch.sources import sinks as SK
from stagewatch.sources.derive import monitoring_events

BEFORE = [("a", "1", 1), ("b", "1", 10), ("c", "1", 100), (None, "1", 7)]
AFTER = [("a", "1", 2), ("b", "1", 11), ("b", "2", 12), ("c", "1", 100), (None, "1", 8)]


def _rows(df):
    return sorted(map(tuple, df.select("p", "k", "v").collect()), key=repr)


@pytest.fixture
def table(spark):
    path = scratch_path(spark, "test-journal")
    SK.append_rows(spark.createDataFrame(BEFORE, "p string, k string, v long"), path, partition_by=["p"])
    return path, spark.createDataFrame([("a", "1", 2), ("b", "1", 11), ("b", "2", 12), (None, "1", 8)], "p string, k string, v long")


def test_a_failure_before_the_journal_changes_nothing(spark, table, monkeypatch):
    path, updates = table
    monkeypatch.setattr(SK, "_journal", lambda p: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        SK.upsert_partitions(path, updates, ["p", "k"], ["p"])
    monkeypatch.undo()
    assert _rows(SK.current_rows(spark, path, updates.schema)) == sorted(BEFORE, key=repr)
    assert not SK.finish_upsert(spark, path)


def test_a_failure_between_staging_and_publishing(spark, table):
    path, updates = table
    schema = SK.stage_upsert(path, updates, ["p", "k"], ["p"])
    assert _rows(SK.read_partitioned(spark, path, schema)) == sorted(BEFORE, key=repr)  # not a folder touched
    assert _rows(SK.current_rows(spark, path, schema)) == sorted(AFTER, key=repr)
    # half of the folders are replaced, then the run is lost
    half = SK._staged(spark, path)[0].where("p = 'a'")
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path)
    assert _rows(SK.current_rows(spark, path, schema)) == sorted(AFTER, key=repr)
    # the next upsert finishes it before its own
    more = spark.createDataFrame([("c", "1", 101)], updates.schema)
    out = SK.upsert_partitions(path, more, ["p", "k"], ["p"])
    assert _rows(out) == sorted([r for r in AFTER if r[0] != "c"] + [("c", "1", 101)], key=repr)
    assert _rows(SK.current_rows(spark, path, schema)) == _rows(out)
    assert not folders.exists(spark, SK._journal(path)) and not SK.finish_upsert(spark, path)


def test_publishing_twice_changes_nothing(spark, table):
    path, updates = table
    schema = SK.stage_upsert(path, updates, ["p", "k"], ["p"])
    rows, by = SK._staged(spark, path)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    assert SK.finish_upsert(spark, path)
    assert _rows(SK.read_partitioned(spark, path, schema)) == sorted(AFTER, key=repr)


def test_the_latest_stage_is_the_rows_own_text(spark):
    events = monitoring_events(spark, SF_CHECK).withColumn("stage", F.concat(F.lit("step "), F.col("stage_progress")))
    for r in M.latest_job_status(events).limit(50).collect():
        assert r["stage"] == f"step {r['stage_progress']}"
    odd = events.withColumn("stage", F.lit(None).cast("string"))
    assert {r["latest_stage"] for r in M.latest_by_batch_job(odd).limit(5).collect()} == {None}
