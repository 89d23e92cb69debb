"""Cases that the sample tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewatch.functions.strings import stage_name
from stagewatch.operators import lifecycle as L
from stagewatch.operators import monitoring as M
from stagewatch.operators.predicates import search_terms
from stagewatch.schema import EVENT_SCHEMA, STAGE_NAMES
from stagewatch.session import checkpoint_root, scratch_path
from stagewatch.sources import csv, jsonlog
from stagewatch.sources import sinks as SK


def events(spark, year, us=123457, stages=range(7)):
    """One good job of that year with microseconds."""
    start = dt.datetime(year, 5, 17, 3, 4, 5, us)
    rows = []
    for s in stages:
        values = {"ingestion_batch_id": "b", "org_id": "1", "user_id": "0011", "repo_id": "r", "repo_version": "1", "priority": "LOW",
                  "job_id": f"j{year}", "job_type": "ADD", "created_at": start, "dataset_id": "d", "num_stages": 6, "stage_progress": s,
                  "time": start + dt.timedelta(seconds=s, microseconds=s), "stage": STAGE_NAMES[s] if 0 <= s < 7 else "?",
                  "errored": False, "finished": s == 6}
        rows.append(tuple(values[f.name] for f in EVENT_SCHEMA.fields))
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.mark.parametrize("year", [1931, 1969, 2024, 2042, 2262])
def test_latest_status_in_any_year(spark, year):
    ev = events(spark, year)
    want = [("j%d" % year, "Finished", 6, False, dt.datetime(year, 5, 17, 3, 4, 11, 123463))]
    assert [tuple(r) for r in M.latest_job_status(ev).collect()] == want
    assert [tuple(r) for r in M.latest_job_status_page(ev).collect()] == want
    assert [tuple(r) for r in M.latest_job_status_lateral(ev, ev).collect()] == want
    assert L.lifecycle_checks(ev).select("ok").first()[0]


def test_stages_outside_the_scale(spark):
    bad = events(spark, 2024, stages=[0, 1, 7])
    with pytest.raises(Exception, match="stage outside"):
        M.latest_job_status(bad).collect()
    assert not L.lifecycle_checks(bad).select("ok").first()[0]
    got = spark.createDataFrame([(i,) for i in (-2, -1, 0, 6, 7)], "s int").select(stage_name("s")).collect()
    assert [r[0] for r in got] == [None, None, STAGE_NAMES[0], STAGE_NAMES[6], None]


def test_search_terms():
    assert search_terms("don't \"two words\" it's x") == ["don't", "two words", "it's", "x"]
    assert search_terms('open "to the end') == ["open", "to the end"] and search_terms("  ") == []


def test_log_keeps_microseconds(spark):
    ev = events(spark, 2024)
    path = scratch_path(spark, "log-us")
    jsonlog.write_log(ev, path)
    back = jsonlog.from_log_records(jsonlog.read_log(spark, path), ev.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, ev.collect()), key=repr)


def test_csv_with_a_cell_that_does_not_parse(spark):
    path = scratch_path(spark, "bad-csv")
    cols = csv.BENCHMARK_RUN_SCHEMA.names
    row = {"record_id": "a", "data_store": "ts", "operation": "basic_write", "exec_time": "5", "num_records": "500.0"}
    spark.createDataFrame([tuple(row.get(c, "") for c in cols)], ", ".join(f"{c} string" for c in cols)).write.option("header", True).csv(path)
    with pytest.raises(Exception):
        csv.read_runs_csv(spark, path).collect()


def test_upsert_needs_an_order_for_two_updates_of_a_key(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept"), (None, 1, "null key")], "k string, n int, v string")
    twice = spark.createDataFrame([("a", 9, "first"), ("a", 2, "last")], "k string, n int, v string")
    with pytest.raises(Exception, match="hold a key twice"):
        SK.upsert(base, twice, ["k"])
    one = spark.createDataFrame([("a", 2, "last"), (None, 2, "new"), ("c", 2, "added")], "k string, n int, v string")
    assert sorted(map(tuple, SK.upsert(base, one, ["k"]).collect()), key=repr) == [
        ("a", 2, "last"), ("b", 1, "kept"), ("c", 2, "added"), (None, 2, "new")]
    plan = SK.merge_updates(base, one, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_upsert_into_text_partitions(spark):
    rows = [("0011", 1, "x"), ("1110", 1, "y"), ("0001", 1, "z")]
    base = spark.createDataFrame(rows, "user_id string, k int, v string")
    path = scratch_path(spark, "text-parts")
    SK.append_rows(base, path, partition_by=["user_id"])
    out = SK.upsert_partitions(path, base.where("user_id = '0011'").withColumn("v", F.lit("new")), ["user_id", "k"], ["user_id"])
    assert sorted((r["user_id"], r["k"], r["v"]) for r in out.collect()) == [("0001", 1, "z"), ("0011", 1, "new"), ("1110", 1, "y")]
    with pytest.raises(ValueError):
        SK.upsert_partitions(path, base, ["k"], ["user_id"])


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        checkpoint_root(Session)
