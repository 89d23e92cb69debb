"""Operator unit tests on the hand-made rows of FIXTURES.md."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from events_fixture import B1, B2, T0, event, frame, job, standard_rows
from stagewatch.operators import aggregates as A
from stagewatch.operators import latency as N
from stagewatch.operators import lifecycle as L
from stagewatch.operators import monitoring as M
from stagewatch.operators import paging as P
from stagewatch.operators.ranks import around
from stagewatch.operators import predicates as PR
from stagewatch.schema import EVENT_SCHEMA


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_rollup_good_and_failed_jobs(spark):
    ev = frame(spark, standard_rows())
    r = rows_by(M.batch_rollup(ev), "ingestion_batch_id")
    assert (r[B1]["num_jobs"], r[B1]["successful_jobs"], r[B1]["errored_jobs"]) == (3, 1, 2)
    assert (r[B2]["num_jobs"], r[B2]["successful_jobs"], r[B2]["errored_jobs"]) == (2, 2, 0)
    assert r[B1]["creation_time"] == T0
    assert r[B1]["last_updation_time"] == T0 + dt.timedelta(seconds=60)


def test_events_per_batch_counts(spark):
    ev = frame(spark, standard_rows())
    r = rows_by(M.events_per_batch(ev), "ingestion_batch_id")
    assert r[B1]["unique_events"] == 7 + 2 + 6 and r[B2]["unique_events"] == 14


def test_completed_batches_and_variants_agree(spark):
    ev = frame(spark, standard_rows())
    assert M.completed_batches(ev, "1110").count() == 0
    done = M.completed_batches(ev, "0011").collect()
    assert [x.ingestion_batch_id for x in done] == [B2]
    semi = M.completed_batches_semi(ev, "0011").collect()
    assert done == semi
    by_user = M.completed_batches_by_user(ev, "0011").collect()
    assert [x.ingestion_batch_id for x in by_user] == [B2]


def test_shared_batch_id_earliest_vs_min(spark):
    late = T0 + dt.timedelta(hours=1)
    rows = job(B1, "a", created=late, t=None) + job(B1, "b", created=T0 + dt.timedelta(hours=2))
    # job b's events happen before job a's, but its batch was created later
    rows = [dict(r, time=r["time"] - dt.timedelta(hours=3)) if r["job_id"] == "b" else r for r in rows]
    ev = frame(spark, rows)
    q2 = M.batch_rollup(ev).first()
    q2c = M.batch_rollup_earliest(ev).first()
    assert q2.creation_time == late  # MIN(created_at)
    assert q2c.created_at_ == T0 + dt.timedelta(hours=2)  # created_at of the earliest event


def test_leading_zeros_are_text(spark):
    rows = job("r__v__0001", "j1", user="0001") + job("r__v__1", "j2", user="1")
    ev = frame(spark, rows)
    assert [r.ingestion_batch_id for r in M.completed_batches(ev, "0001").collect()] == ["r__v__0001"]
    assert [r.ingestion_batch_id for r in M.completed_batches(ev, 1).collect()] == ["r__v__1"]
    assert M.finished_per_minute(ev, ["0011"]).count() == 0


def test_latest_status_time_tie_and_late_rows(spark):
    tie = T0 + dt.timedelta(seconds=30)
    rows = job(B1, "j", 3)
    rows[2]["time"] = tie
    rows[3]["time"] = tie  # stages 2 and 3 at the same time
    rows = list(reversed(rows))  # late arrival order must not matter
    ev = frame(spark, rows)
    for df in (M.latest_job_status(ev, B1), M.latest_job_status_page(ev, B1)):
        r = df.first()
        assert (r.stage_progress, r.stage, r.last_updation_time) == (3, "Staged", tie)
    c = M.latest_by_batch_job(ev, B1).first()
    assert (c.latest_progress, c.latest_stage) == (3, "Staged")
    lat = M.latest_job_status_lateral(ev, ev.select("job_id")).first()
    assert lat.stage_progress == 3


def test_latest_status_failed_job(spark):
    ev = frame(spark, job(B1, "f", 5, True))
    r = M.latest_job_status(ev, B1).first()
    assert (r.stage_progress, r.errored) == (5, True)


def test_finished_per_minute_distinct(spark):
    rows = job(B1, "a") + job(B1, "b") + [event(B1, "a", 6)]  # duplicate finished event
    ev = frame(spark, rows)
    r = M.finished_per_minute(ev, ["1110"]).collect()
    assert len(r) == 1 and r[0].num_jobs == 2
    assert r[0].interval_start == T0 + dt.timedelta(minutes=1)  # stage 6 is at T0 + 60 s


def test_empty_input_everywhere(spark):
    ev = spark.createDataFrame([], EVENT_SCHEMA)
    for df in (M.events_per_batch(ev), M.batch_rollup(ev), M.batch_rollup_lateral(ev), M.batch_rollup_earliest(ev),
               M.completed_batches(ev), M.completed_batches_semi(ev), M.completed_batches_by_user(ev),
               M.completed_batches_page(ev), M.latest_job_status(ev, B1), M.latest_job_status_page(ev, B1),
               M.latest_by_batch_job(ev), M.finished_per_minute(ev), M.finished_per_minute_page(ev),
               L.lifecycle_checks(ev), A.earliest_latest(ev, ["job_id"], ["stage"], ["time"]),
               P.offset_page(ev, 10, 0, "time")):
        assert df.count() == 0


def test_lifecycle_checks_flag_bad_jobs(spark):
    gap = [r for r in job(B1, "gap") if r["stage_progress"] != 2]
    two_terminal = job(B1, "two", 3, True)
    two_terminal[1]["errored"] = True
    after = job(B1, "after", 2, True) + [event(B1, "after", 0, t=T0 + dt.timedelta(hours=1))]
    ev = frame(spark, job(B1, "good") + job(B1, "fail", 4, True) + gap + two_terminal + after)
    r = rows_by(L.lifecycle_checks(ev), "job_id")
    assert r["good"]["ok"] and r["fail"]["ok"]
    assert not r["gap"]["gap_free"] and not r["gap"]["ok"]
    assert not r["two"]["one_terminal"]
    assert not r["after"]["terminal_last"] and not r["after"]["gap_free"]
    assert {x.job_id for x in L.lifecycle_violations(ev).collect()} == {"gap", "two", "after"}


def test_expand_jobs_cuts_at_failure(spark):
    jobs = spark.createDataFrame(
        [("b", "1", "u", "r", "v", "LOW", "j1", "ADD", T0, "d", 6, False, 0, T0),
         ("b", "1", "u", "r", "v", "LOW", "j2", "ADD", T0, "d", 3, True, 5, T0)],
        "ingestion_batch_id string, org_id string, user_id string, repo_id string, repo_version string, "
        "priority string, job_id string, job_type string, created_at timestamp_ntz, dataset_id string, "
        "last_stage int, fails boolean, start_offset_s int, start_time timestamp_ntz")
    ev = L.expand_jobs(jobs)
    assert ev.columns == EVENT_SCHEMA.fieldNames()
    r = ev.where("job_id = 'j2'").orderBy("stage_progress").collect()
    assert [x.stage_progress for x in r] == [0, 1, 2, 3]
    assert [x.errored for x in r] == [False, False, False, True]
    assert r[3].time == T0 + dt.timedelta(seconds=5 + 60)
    assert ev.where("job_id = 'j1' AND finished").count() == 1
    assert L.lifecycle_violations(ev).count() == 0


def test_split_batch_pairs_chunks(spark):
    pairs = spark.createDataFrame([("r", "v", "0011", "1110", 10_001, 25), ("r", "w", "0001", "0001", 7, 50)],
                                  "repo_id string, repo_version string, first_user_id string, "
                                  "second_user_id string, num_jobs long, split_pct int")
    jobs = L.split_batch_pairs(pairs, chunk=1000)
    r = rows_by(L.jobs_per_batch(jobs), "ingestion_batch_id")
    assert r["r__v__0011"]["num_jobs"] == 2500 and r["r__v__1110"]["num_jobs"] == 7501
    assert r["r__v__1110"]["first_job_no"] == 2501 and r["r__v__1110"]["last_job_no"] == 10_001
    assert r["r__w__0001"]["num_jobs"] == 7  # same user twice: one batch id
    assert jobs.select("job_no").distinct().count() == 10_001


def test_offset_and_keyset_pages(spark):
    df = spark.range(1, 1001).select(F.col("id"), (F.col("id") % 7).alias("g"))
    p = P.offset_page(df, 100, 100, "id").collect()
    assert [x.row_num for x in p][:2] == [101, 102] and p[0].id == 101 and len(p) == 100
    first = P.keyset_page(df, ["g", "id"], 50)
    cur = P.cursor_value(P.page_cursors(first, ["g", "id"]), "next_cursor")
    second = P.keyset_page(df, ["g", "id"], 50, cur).collect()
    expect = df.orderBy("g", "id").collect()[50:100]
    assert second == expect
    back_cur = P.cursor_value(P.page_cursors(P.keyset_page(df, ["g", "id"], 50, cur), ["g", "id"]), "prev_cursor")
    assert P.keyset_page(df, ["g", "id"], 50, back_cur, "prev").collect() == first.collect()
    token = (second[-1].g, second[-1].id)  # a client's literal token: pushed-down predicate
    assert P.keyset_page(df, ["g", "id"], 50, token).collect() == df.orderBy("g", "id").collect()[100:150]


def test_batch_numbers_global_order(spark):
    df = spark.range(0, 2345, numPartitions=7).select((F.col("id") * 7919 % 2345).alias("k"))
    out = P.batch_numbers(df.repartition(5), ["k"], 100).orderBy("row_no").collect()
    assert [x.k for x in out] == list(range(2345))
    assert [x.row_no for x in out] == list(range(1, 2346))
    assert out[-1].batch_no == 23 and out[99].batch_no == 0 and out[100].batch_no == 1


def test_top_n_and_composite_pages(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("g"), F.col("id"))
    top = A.top_n_per_group(df, ["g"], [F.col("id").desc()], 2).orderBy("g", "rank").collect()
    assert [(x.g, x.id) for x in top] == [(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)]
    aggs = [F.count(F.lit(1)).alias("n")]
    p1 = A.composite_page(df, ["id"], aggs, 40)
    after = A.composite_after_key(p1, ["id"]).select("after_key.id").scalar()
    p2 = A.composite_page(df, ["id"], aggs, 40, [after]).collect()
    assert [x.id for x in p2] == list(range(40, 80))


def test_text_search_terms_and_phrases(spark):
    docs = spark.createDataFrame([(1, "the cat of the hat"), (2, "the dog"), (3, "cat of")], "doc_id long, text string")
    assert PR.search_terms('the "of the"') == ["the", "of the"]
    assert [r.doc_id for r in PR.text_search(docs, "text", 'the "of the"').collect()] == [1]
    assert sorted(r.doc_id for r in PR.text_search(docs, "text", "cat").collect()) == [1, 3]
    assert [r.doc_id for r in PR.search_page(docs, "text", "the", "doc_id", 1, after=1).collect()] == [2]


def test_multi_get_absent_id(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ids = spark.createDataFrame([(0, 2), (1, 9), (2, 1)], "pos int, doc_id long")
    out = PR.multi_get(docs, "doc_id", ids, pos_col="pos").collect()
    assert [(r.doc_id, r.found, r.text) for r in out] == [(2, True, "b"), (9, False, None), (1, True, "a")]
    assert PR.get_one(docs, "doc_id", 9).count() == 0


def test_pandas_predicate_equals_column_predicate(spark):
    df = spark.range(0, 500).select("id", (F.col("id") % 5).alias("m"))
    a = PR.apply_predicate(df, (F.col("m") == 2) & (F.col("id") > 100)).collect()
    b = PR.apply_predicate(df, lambda p: (p["m"] == 2) & (p["id"] > 100)).collect()
    c = PR.apply_predicate(df, "m = 2 AND id > 100").collect()
    assert sorted(a) == sorted(b) == sorted(c) and len(a) == 80


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = [(int(g), int(v)) for g, v in zip(rng.integers(0, 3, 2000), rng.integers(0, 50, 2000))]
    df = spark.createDataFrame(vals, "g long, v long")
    got = {r.g: r for r in N.exact_quantiles(df, ["g"], "v", [("q1", .25), ("med", .5), ("q3", .75)]).collect()}
    for g in range(3):
        xs = np.array([v for gg, v in vals if gg == g])
        for name, q in (("q1", 25), ("med", 50), ("q3", 75)):
            assert got[g][name] == pytest.approx(np.percentile(xs, q))
        assert got[g].n == len(xs)


def test_time_bins(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(minutes=59),), (T0 + dt.timedelta(minutes=61),)],
                               "ts timestamp_ntz")
    out = A.time_bins(df, "ts", "1 hour", [F.count(F.lit(1)).alias("n")]).orderBy("bin_start").collect()
    assert [(r.bin_start, r.n) for r in out] == [(T0, 2), (T0 + dt.timedelta(hours=1), 1)]


def test_sql_with_bind_parameter_equals_dataframe_form(spark):
    ev = frame(spark, standard_rows())
    for user in ("0011", "1110"):
        assert M.completed_batches_sql(ev, user).collect() == M.completed_batches(ev, user).collect()


def test_cross_variants_agree_on_derived_data(spark):
    from conftest import SF_SMALL
    from stagewatch.sources.derive import monitoring_events

    ev = monitoring_events(spark, SF_SMALL)
    assert M.batch_rollup(ev).collect() == M.batch_rollup_lateral(ev).orderBy("ingestion_batch_id").collect()
    assert M.completed_batches(ev).collect() == M.completed_batches_semi(ev).collect()
    mine = ev.where(F.col("user_id") == "1110")
    a = sorted(M.latest_job_status(mine).collect())
    b = sorted(M.latest_job_status_lateral(ev, mine.select("job_id")).collect())
    assert a == b
    unlimited = M.batch_rollup(ev, limit=None).orderBy("ingestion_batch_id").limit(100).collect()
    assert unlimited == M.batch_rollup(ev).collect()


def test_expanded_data_satisfies_the_lifecycle_invariants(spark):
    from conftest import SF_SMALL
    from stagewatch.sources.derive import monitoring_events

    ev = monitoring_events(spark, SF_SMALL)
    assert L.lifecycle_violations(ev).count() == 0
    assert L.lifecycle_checks(ev).count() == ev.select("job_id").distinct().count()


def test_first_groups_really_restricts_rows(spark):
    """The semi join against a set derived from the same DataFrame must not collapse
    into an always-true self comparison (results alone would not show it)."""
    df = spark.range(0, 5000).select((F.col("id") % 250).alias("k"), F.col("id"))
    kept = M.first_groups(df, ["k"], [F.col("k")], 10)
    assert kept.select("k").distinct().count() == 10
    assert kept.count() == 200
    with_null = df.select(F.when(F.col("k") == 0, None).otherwise(F.col("k")).alias("k"), "id")
    kept = M.first_groups(with_null, ["k"], [F.col("k").asc_nulls_first()], 3)
    assert sorted(r.k for r in kept.select("k").distinct().collect() if r.k is not None) == [1, 2]
    assert kept.where("k IS NULL").count() == 20


def test_deep_offset_page_holds_no_prefix(spark):
    df = spark.range(0, 3000, numPartitions=6).select((F.col("id") * 7 % 3000).alias("k"), F.col("id"))
    deep = P.offset_page(df, 50, 2000, "k").collect()
    assert [r.row_num for r in deep] == list(range(2001, 2051)) and [r.k for r in deep] == list(range(2000, 2050))
    deep_desc = P.offset_page(df, 50, 2000, "k", "DESC").collect()
    assert [r.row_num for r in deep_desc] == list(range(2001, 2051)) and [r.k for r in deep_desc] == list(range(999, 949, -1))
    interval, total = around(df, ["k"], 2001, 2050, few=10)
    assert total == 3000 and interval.rows <= 60  # no task holds the 2,050-row prefix
