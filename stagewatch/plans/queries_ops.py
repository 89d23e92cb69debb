"""Registered queries for paging, predicates, generic aggregates and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lifecycle as L
from ..operators import monitoring as M
from ..operators import paging as P
from ..operators import predicates as PR
from ..sources.derive import monitoring_events
from ..sources.tables import read_table
from .oracle import MONITORING_EVENTS_CTE, with_me
from .queries_core import ROLLUP_SQL
from .registry import register

EV_KEYS = ["ts", "event_id"]


# ------------------------------------------------------------------ paging
@register("p1_offset_page", with_me(f"""
SELECT * FROM (
    SELECT ROW_NUMBER() OVER (ORDER BY r.ingestion_batch_id ASC) AS row_num, r.*
    FROM (SELECT ingestion_batch_id, {ROLLUP_SQL} FROM monitoring_events GROUP BY ingestion_batch_id) r)
WHERE row_num BETWEEN 101 AND 200"""))
def p1(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    rolled = ev.groupBy("ingestion_batch_id").agg(*M._rollup_columns())
    return P.offset_page(rolled, page_size=100, page_after=100, sort_by="ingestion_batch_id")


@register("p1_offset_page_deep", """
SELECT ROW_NUMBER() OVER (ORDER BY ts, event_id) AS row_num, event_id, ts, user_id, value
FROM events QUALIFY row_num BETWEEN (SELECT COUNT(*) * 3 // 4 + 1 FROM events) AND (SELECT COUNT(*) * 3 // 4 + 100 FROM events)""")
def p1_deep(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return P.offset_page(ev, 100, ev.count() * 3 // 4, EV_KEYS)


@register("p1_offset_page_desc", """
SELECT ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS row_num, event_id, ts, user_id, value
FROM events QUALIFY row_num BETWEEN (SELECT COUNT(*) // 3 + 1 FROM events) AND (SELECT COUNT(*) // 3 + 100 FROM events)""")
def p1_desc(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return P.offset_page(ev, 100, ev.count() // 3, EV_KEYS, "DESC")


@register("p2_page_next", """
WITH p1 AS (SELECT * FROM events ORDER BY ts, event_id LIMIT 100),
     c AS (SELECT max(ts) AS ts FROM p1),
     cur AS (SELECT p1.ts, max(p1.event_id) AS event_id FROM p1, c WHERE p1.ts = c.ts GROUP BY p1.ts)
SELECT e.* FROM events e, cur
WHERE e.ts > cur.ts OR (e.ts = cur.ts AND e.event_id > cur.event_id)
ORDER BY e.ts, e.event_id LIMIT 100""")
def p2_next(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    first = P.keyset_page(ev, EV_KEYS, 100)
    return P.keyset_page(ev, EV_KEYS, 100, P.cursor_token(first, EV_KEYS, "next_cursor"), "next")


@register("p2_page_prev", """
SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn BETWEEN 101 AND 200""".replace("SELECT * FROM (", "SELECT event_id, ts, user_id, event_type, value, props FROM ("))
def p2_prev(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    last = P.keyset_page(ev, EV_KEYS, 100, None, "prev")
    return P.keyset_page(ev, EV_KEYS, 100, P.cursor_token(last, EV_KEYS, "prev_cursor"), "prev")


@register("p3_sorted_scan", with_me("""
SELECT job_id, ingestion_batch_id, stage, time FROM monitoring_events
WHERE errored ORDER BY time DESC, job_id"""))
def p3(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    return P.sorted_scan(ev, F.col("errored"), [F.col("time").desc(), F.col("job_id")],
                         ["job_id", "ingestion_batch_id", "stage", "time"])


@register("s14_batch_numbers", """
SELECT event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS row_no,
       CAST((ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1) // 100 AS BIGINT) AS batch_no
FROM events""")
def s14(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return P.batch_numbers(ev, EV_KEYS, 100).select("event_id", "row_no", "batch_no")


# ------------------------------------------------------------------ predicates
F6_START, F6_END = "1996-01-01 00:00:00", "1996-01-07 23:59:59"


@register("f6_time_range", with_me(f"""
SELECT * FROM monitoring_events
WHERE time BETWEEN TIMESTAMP '{F6_START}' AND TIMESTAMP '{F6_END}'"""))
def f6(spark, sf_dir):
    return PR.time_range(monitoring_events(spark, sf_dir), F6_START, F6_END)


F7_PATTERN = 'the "of the"'


@register("f7_text_search", """
SELECT doc_id, lang, n_chars FROM documents
WHERE contains(text, 'the') AND contains(text, 'of the')""")
def f7(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return PR.text_search(docs, "text", F7_PATTERN).select("doc_id", "lang", "n_chars")


@register("f7_text_search_page", """
SELECT doc_id, lang, n_chars FROM documents
WHERE contains(text, 'the') AND contains(text, 'of the') ORDER BY doc_id LIMIT 10""")
def f7_page(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return PR.search_page(docs, "text", F7_PATTERN, "doc_id", 10).select("doc_id", "lang", "n_chars")


F8_SQL = with_me("""
SELECT job_id, stage_progress, time FROM monitoring_events
WHERE stage_progress >= 3 AND NOT finished AND priority = 'HIGH'""")


@register("f8_predicate", F8_SQL)
def f8(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    pred = (F.col("stage_progress") >= 3) & ~F.col("finished") & (F.col("priority") == "HIGH")
    return PR.apply_predicate(ev, pred).select("job_id", "stage_progress", "time")


@register("f8_predicate_pandas", F8_SQL)
def f8_pandas(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir).select("job_id", "stage_progress", "time", "finished", "priority")

    def opaque(pdf):
        return (pdf["stage_progress"] >= 3) & ~pdf["finished"].astype(bool) & (pdf["priority"] == "HIGH")

    return PR.apply_predicate(ev, opaque).select("job_id", "stage_progress", "time")


@register("f9_scan_fields", with_me("SELECT job_id, stage, stage_progress, errored FROM monitoring_events"))
def f9(spark, sf_dir):
    return PR.select_fields(monitoring_events(spark, sf_dir), ["job_id", "stage", "stage_progress", "errored"])


@register("f10_multi_get", """
SELECT l.doc_id, d.doc_id IS NOT NULL AS found, d.lang, d.n_chars
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def f10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    ids = read_table(spark, sf_dir, "labels").select("doc_id")
    return PR.multi_get(docs, "doc_id", ids, fields=["lang", "n_chars"])


# ------------------------------------------------------------------ aggregates
@register("a7_earliest_latest", with_me("""
SELECT ingestion_batch_id,
       arg_min(stage, {'t': time, 's': stage_progress, 'j': job_id}) AS earliest_stage,
       arg_max(stage, {'t': time, 's': stage_progress, 'j': job_id}) AS latest_stage,
       arg_min(job_id, {'t': time, 's': stage_progress, 'j': job_id}) AS earliest_job_id,
       arg_max(job_id, {'t': time, 's': stage_progress, 'j': job_id}) AS latest_job_id
FROM monitoring_events GROUP BY ingestion_batch_id"""))
def a7(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    return A.earliest_latest(ev, ["ingestion_batch_id"], ["stage", "job_id"], ["time", "stage_progress", "job_id"])


@register("a9_top_n_per_group", """
SELECT user_id, event_id, value, rank FROM (
    SELECT user_id, event_id, value,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
    FROM events)
WHERE rank <= 3""")
def a9(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    top = A.top_n_per_group(ev, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)
    return top.select("user_id", "event_id", "value", "rank")


@register("a11_composite_page2", with_me("""
SELECT ingestion_batch_id, COUNT(*) AS unique_events FROM monitoring_events
GROUP BY ingestion_batch_id ORDER BY ingestion_batch_id LIMIT 100 OFFSET 100"""))
def a11(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("unique_events")]
    page1 = A.composite_page(ev, ["ingestion_batch_id"], aggs, 100)
    after = A.composite_after_key(page1, ["ingestion_batch_id"]).select("after_key.ingestion_batch_id").scalar()
    return A.composite_page(ev, ["ingestion_batch_id"], aggs, 100, [after])


@register("a12_bins", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS bin_start, COUNT(*) AS n_events,
       MAX(value) AS max_value, MIN(ts) AS first_ts
FROM events GROUP BY 1""")
def a12(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return A.time_bins(ev, "ts", "1 hour",
                       [F.count(F.lit(1)).alias("n_events"), F.max("value").alias("max_value"),
                        F.min("ts").alias("first_ts")])


# ------------------------------------------------------------------ lifecycle
@register("l1_lifecycle_expand", with_me("SELECT * FROM monitoring_events"))
def l1(spark, sf_dir):
    return monitoring_events(spark, sf_dir)


L2_SQL = f"""
WITH {MONITORING_EVENTS_CTE.strip()},
pairs AS (
    SELECT repo_id, repo_version, MIN(user_id) AS first_user_id, MAX(user_id) AS second_user_id,
           COUNT(DISTINCT job_id) AS num_jobs,
           [10, 25, 50][(COUNT(DISTINCT job_id) % 3) + 1] AS split_pct
    FROM monitoring_events GROUP BY repo_id, repo_version, org_id
),
jobs AS (
    SELECT repo_id, repo_version,
           CASE WHEN job_no <= (num_jobs * split_pct) // 100 THEN first_user_id ELSE second_user_id END AS user_id,
           job_no
    FROM pairs CROSS JOIN LATERAL (SELECT unnest(range(1, num_jobs + 1)) AS job_no) AS s
)
SELECT repo_id || '__' || repo_version || '__' || user_id AS ingestion_batch_id, user_id,
       COUNT(*) AS num_jobs, MIN(job_no) AS first_job_no, MAX(job_no) AS last_job_no
FROM jobs GROUP BY 1, 2"""


def batch_pairs(ev):
    """Batch pairs as the writer would see them: one per (repo, version, org)."""
    g = ev.groupBy("repo_id", "repo_version", "org_id").agg(
        F.min("user_id").alias("first_user_id"), F.max("user_id").alias("second_user_id"),
        F.count_distinct("job_id").alias("num_jobs"),
    )
    pct = F.element_at(F.array(F.lit(10), F.lit(25), F.lit(50)), (F.col("num_jobs") % 3 + 1).cast("int"))
    return g.select("repo_id", "repo_version", "first_user_id", "second_user_id", "num_jobs", pct.alias("split_pct"))


@register("l2_batch_jobs", L2_SQL)
def l2(spark, sf_dir):
    pairs = batch_pairs(monitoring_events(spark, sf_dir))
    return L.jobs_per_batch(L.split_batch_pairs(pairs))


@register("l3_lifecycle_violations", with_me("""
SELECT job_id, n_events,
       coalesce(min_stage = 0 AND n_stages = max_stage + 1 AND n_events = n_stages, false) AS gap_free,
       n_terminal = 1 AS one_terminal,
       coalesce(terminal_stage = max_stage AND terminal_time = last_time AND stage_at_last = max_stage, false)
           AS terminal_last,
       coalesce(min_stage = 0 AND n_stages = max_stage + 1 AND n_events = n_stages AND n_terminal = 1
                AND terminal_stage = max_stage AND terminal_time = last_time AND stage_at_last = max_stage, false) AS ok
FROM (
    SELECT job_id, COUNT(*) AS n_events, COUNT(DISTINCT stage_progress) AS n_stages,
           MIN(stage_progress) AS min_stage, MAX(stage_progress) AS max_stage,
           COUNT(*) FILTER (WHERE finished OR errored) AS n_terminal,
           MAX(CASE WHEN finished OR errored THEN stage_progress END) AS terminal_stage,
           MAX(CASE WHEN finished OR errored THEN time END) AS terminal_time,
           MAX(time) AS last_time,
           arg_max(stage_progress, {'t': time, 's': stage_progress}) AS stage_at_last
    FROM monitoring_events GROUP BY job_id)"""))
def l3(spark, sf_dir):
    return L.lifecycle_checks(monitoring_events(spark, sf_dir))
