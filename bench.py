"""Benchmark: the five monitoring query types (and variants) on the stage-event table.

Mirrors the monitoring read benchmark: events are written once to the store (here a
parquet table, time-partitioned and clustered by batch id), then every query type
runs ``BENCH_REPEATS`` times; the first run is reported apart (cold), with the mean
and median of the warm runs and a box (min, quartiles, max) over all runs per query. Each run executes the full plan into a no-op
sink, so nothing is collected. Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 10).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from stagewatch.operators import monitoring as M  # noqa: E402
from stagewatch.operators import paging as PG  # noqa: E402
from stagewatch.plans.queries_core import first_batch_of  # noqa: E402
from stagewatch.session import local_session, scratch_path  # noqa: E402
from stagewatch.sources.derive import monitoring_events  # noqa: E402
from stagewatch.schema import DIMENSIONS, MEASURES, RECORD_TYPE_NAMES  # noqa: E402
from stagewatch.sources import jsonlog as JL  # noqa: E402
from stagewatch.sources import records as R  # noqa: E402
from stagewatch.sources import sinks as SK  # noqa: E402
from stagewatch.sources.sinks import store_events  # noqa: E402


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 4)


def write_benchmarks(spark, ev) -> dict:
    """One write of the event set per encoding, as the four store writers do."""
    return {
        "append_table": timed(lambda: SK.append_rows(ev, scratch_path(spark, "bw-append"))),
        "json_log": timed(lambda: JL.write_log(ev, scratch_path(spark, "bw-log"), unit="month")),
        "records": timed(lambda: R.to_records(ev, RECORD_TYPE_NAMES, "time", MEASURES, DIMENSIONS)
                         .write.parquet(scratch_path(spark, "bw-records"))),
        "upsert": timed(lambda: SK.upsert(ev, ev.where("finished"), ["job_id", "stage_progress"]).count()),
    }


def operator_benchmarks(spark, ev, n_events: int) -> dict:
    """One run each of operators beside the query types: pages, global numbers, an upsert of some partitions."""
    keys = ["time", "job_id", "stage_progress"]
    table = scratch_path(spark, "bench-upserted")
    ev.write.partitionBy("event_date").parquet(table)
    first = PG.keyset_page(ev, keys, 100)
    updates = ev.where("event_date between date'1995-01-01' and date'1995-03-31' and finished")
    return {
        "offset_page_deep": timed(lambda: run(PG.offset_page(ev, 100, n_events // 2, keys))),
        "keyset_page_next": timed(lambda: run(PG.keyset_page(ev, keys, 100, PG.cursor_token(first, keys, "next_cursor")))),
        "batch_numbers": timed(lambda: run(PG.batch_numbers(ev.select(*keys), keys))),
        "upsert_partitions": timed(lambda: SK.upsert_partitions(table, updates, ["event_date", "job_id", "stage_progress"], ["event_date"])),
    }


def run(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "10"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2)), app="stagewatch-bench")
    spark.sparkContext.setLogLevel("ERROR")

    # Write path: derive the events and store them once.
    path = scratch_path(spark, "bench-events")
    t0 = time.perf_counter()
    store_events(monitoring_events(spark, sf_dir), path, unit="month")
    write_s = time.perf_counter() - t0
    ev = spark.read.parquet(path)

    qs = {
        "q1_events_per_batch": lambda: M.events_per_batch(ev),
        "q2_batch_rollup": lambda: M.batch_rollup(ev),
        "q2_batch_rollup_lateral": lambda: M.batch_rollup_lateral(ev),
        "q3_completed_batches": lambda: M.completed_batches(ev, "1110"),
        "q3_completed_batches_semi": lambda: M.completed_batches_semi(ev, "1110"),
        "q4_latest_job_status": lambda: M.latest_job_status(ev, first_batch_of(ev)),
        "q4_latest_job_status_page": lambda: M.latest_job_status_page(ev, first_batch_of(ev)),
        "q5_finished_per_minute": lambda: M.finished_per_minute(ev),
        "q5_finished_per_minute_page": lambda: M.finished_per_minute_page(ev),
    }
    warm_mean, warm_median, first, box = {}, {}, {}, {}
    for name, build in qs.items():
        times = [run(build()) for _ in range(repeats)]
        first[name] = round(times[0], 4)
        warm = times[1:] or times
        warm_mean[name] = round(statistics.mean(warm), 4)
        warm_median[name] = round(statistics.median(warm), 4)
        # box over all runs, linear quartiles (as the latency analysis summarises them)
        q1, med, q3 = statistics.quantiles(times, n=4, method="inclusive") if len(times) > 1 else times * 3
        box[name] = [round(x, 4) for x in (min(times), q1, med, q3, max(times))]
    n_events = ev.count()
    writes = write_benchmarks(spark, ev)
    operators = operator_benchmarks(spark, ev, n_events)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "warm_mean_query_seconds_total",
        "value": round(sum(warm_mean.values()), 4),
        "unit": "sec",
        "queries": warm_mean,
        "warm_median_total": round(sum(warm_median.values()), 4),
        "first_run": first,
        "box_all_runs": box,
        "warm_median": warm_median,
        "write_events_sec": round(write_s, 4),
        "writes_sec": writes,
        "operators_sec": operators,
        "events": n_events,
        "repeats": repeats,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
