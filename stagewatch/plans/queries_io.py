"""Registered queries for scalar functions, encodings, sinks and latency analysis.

Sink queries write to a fresh folder under the shared checkpoint folder and return
the re-read result, so the check covers the write and the read path."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts as C
from ..functions import jsonfns as J
from ..functions import strings as S
from ..functions import timefns as TF
from ..operators import latency as N
from ..schema import (DIMENSIONS, EVENT_COLUMNS, EVENT_SCHEMA, EVENT_TYPE_NAMES, MEASURES, QUERY_TYPE_NAMES, RECORD_TYPE_NAMES, SCALES,
                      STAGE_NAMES, STORE_NAMES)
from ..session import scratch_path
from ..sources import csv as CSV
from ..sources import jsonlog as JL
from ..sources import records as R
from ..sources import sinks as SK
from ..sources.derive import benchmark_runs, monitoring_events
from ..sources.tables import read_table
from .oracle import with_me, with_runs
from .registry import register


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


# ------------------------------------------------------------------ functions
@register("c_casts", """
SELECT event_id, event_id AS id_back, value AS value_back, ts AS ts_back,
       event_type = 'click' AS flag_back, CAST(ts AS DATE) AS day_back, strftime(ts, '%H:%M:%S.%f') AS time_back
FROM events""")
def c_casts(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    txt = ev.select(
        "event_id",
        F.col("event_id").cast("string").alias("id_txt"),
        F.col("value").cast("string").alias("value_txt"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000")).alias("ts_txt"),
        F.when(F.col("event_type") == "click", F.lit("TRUE")).otherwise(F.lit("t")).alias("flag_txt"),
        F.date_format("ts", "yyyy-MM-dd").alias("day_txt"),
        F.concat(F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lit("000")).alias("time_txt"),
    )
    return txt.select(
        "event_id",
        C.cast_text("id_txt", "BIGINT").alias("id_back"),
        C.cast_text("value_txt", "DOUBLE").alias("value_back"),
        C.cast_text("ts_txt", "TIMESTAMP").alias("ts_back"),
        C.cast_text("flag_txt", "BOOLEAN").alias("flag_back"),
        C.cast_text("day_txt", "DATE").alias("day_back"),
        C.cast_text("time_txt", "TIME").alias("time_back"),
    )


@register("c_time", """
SELECT event_id,
       CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS ts_ms,
       ts AS ts_back,
       CAST(round(epoch_us(ts + INTERVAL 7 DAY) / 1000.0) AS BIGINT) AS plus_7d_ms,
       CAST(epoch_us(ts - INTERVAL 30 MINUTE) // 1000000 AS BIGINT) AS minus_30m_s,
       date_trunc('minute', ts) AS minute_start,
       date_trunc('hour', ts) AS hour_start
FROM events""")
def c_time(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    ms = TF.to_epoch_ms("ts")
    return ev.select(
        "event_id",
        ms.alias("ts_ms"),
        TF.from_epoch_us(TF.to_epoch_us("ts")).alias("ts_back"),
        TF.with_offset("ts", days=7).alias("plus_7d_ms"),
        TF.with_offset("ts", minutes=30, ahead=False, ms=False).alias("minus_30m_s"),
        TF.truncate("ts", "minute").alias("minute_start"),
        TF.truncate("ts", "hour").alias("hour_start"),
    )


@register("c_strings", with_me("""
SELECT DISTINCT ingestion_batch_id,
       split_part(ingestion_batch_id, '__', 1) AS repo_part,
       split_part(ingestion_batch_id, '__', 2) AS version_part,
       split_part(ingestion_batch_id, '__', 3) AS user_part,
       repo_id || '__' || repo_version || '__' || user_id AS rebuilt,
       upper(lower(job_type) || '_' || user_id) AS code,
       strftime(created_at, '%Y/%-m/%-d/%-H/%-M') AS log_stream
FROM monitoring_events"""))
def c_strings(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    return ev.select(
        "ingestion_batch_id",
        S.batch_id_part("ingestion_batch_id", 1).alias("repo_part"),
        S.batch_id_part("ingestion_batch_id", 2).alias("version_part"),
        S.batch_id_part("ingestion_batch_id", 3).alias("user_part"),
        S.batch_id("repo_id", "repo_version", "user_id").alias("rebuilt"),
        S.dataset_code(F.lower("job_type"), "user_id").alias("code"),
        S.log_stream_name("created_at").alias("log_stream"),
    ).distinct()


@register("c_stage_names", with_me(f"""
SELECT stage_progress, {_sql_list(STAGE_NAMES)}[stage_progress + 1] AS name,
       list_position({_sql_list(STAGE_NAMES)}, stage) - 1 AS number_back,
       least(stage_progress + 1, 6) AS next_stage, COUNT(*) AS n_events
FROM monitoring_events GROUP BY ALL"""))
def c_stage_names(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    return ev.groupBy(
        "stage_progress",
        S.stage_name("stage_progress").alias("name"),
        S.stage_number("stage").alias("number_back"),
        S.next_stage("stage_progress").alias("next_stage"),
    ).agg(F.count(F.lit(1)).alias("n_events"))


@register("c_json", """
SELECT event_id, user_id AS user_id_back, event_type AS event_type_back,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""")
def c_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    enc = ev.select("event_id", "props", J.encode(["user_id", "event_type"]).alias("j"))
    dec = J.decode("j", "user_id long, event_type string")
    return enc.select(
        "event_id",
        dec["user_id"].alias("user_id_back"),
        dec["event_type"].alias("event_type_back"),
        J.decode("props", "k int")["k"].alias("k"),
    )


# ------------------------------------------------------------------ encodings and sinks
# The derived test tables span seven years at a few dozen events per day, so their
# stored copies are partitioned by month; production tables use day partitions.
SPARSE_UNIT = "month"

@register("s4_json_log_fields", with_me("""
SELECT *, strftime(time, '%Y/%-m/%-d/%-H/%-M') AS log_stream FROM monitoring_events"""))
def s4(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    path = scratch_path(spark, "jsonlog")
    JL.write_log(ev, path, unit=SPARSE_UNIT)
    raw = JL.read_log(spark, path)
    return _decode_with_stream(raw)


def _decode_with_stream(raw):
    from pyspark.sql import types as T

    msg = T.StructType([f for f in EVENT_SCHEMA.fields if f.name != "time"])
    dec = raw.select("log_stream", F.col("timestamp").alias("time"), F.from_json("message", msg).alias("_m"))
    return dec.select(*[F.col("time") if c == "time" else F.col(f"_m.{c}").alias(c) for c in EVENT_COLUMNS], "log_stream")


LOG_ORDER = "CAST(time AS DATE), time, strftime(time, '%Y/%-m/%-d/%-H/%-M'), ingestion_batch_id, org_id, user_id, repo_id, repo_version, priority, job_id"


def _stored_log(spark, sf_dir):
    path = scratch_path(spark, "jsonlog")
    JL.write_log(monitoring_events(spark, sf_dir), path, unit=SPARSE_UNIT)
    return JL.read_log(spark, path)


def _log_page(page):
    schema = T.StructType([f for f in EVENT_SCHEMA.fields if f.name in ("job_id", "stage_progress", "time")])
    return JL.decode_log(page, schema, keep=["log_stream"])[0].drop(JL.MALFORMED)


@register("p2_log_page_next", with_me(f"""
SELECT job_id, stage_progress, time, strftime(time, '%Y/%-m/%-d/%-H/%-M') AS log_stream
FROM monitoring_events ORDER BY {LOG_ORDER} LIMIT 100 OFFSET 100"""))
def p2_log_next(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    return _log_page(JL.log_page(log, 100, JL.log_cursor(JL.log_page(log, 100))))


@register("p2_log_page_prev", with_me(f"""
SELECT job_id, stage_progress, time, strftime(time, '%Y/%-m/%-d/%-H/%-M') AS log_stream
FROM monitoring_events
QUALIFY ROW_NUMBER() OVER (ORDER BY {LOG_ORDER}) BETWEEN (SELECT COUNT(*) - 199 FROM monitoring_events) AND (SELECT COUNT(*) - 100 FROM monitoring_events)"""))
def p2_log_prev(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    return _log_page(JL.log_page(log, 100, JL.log_cursor(JL.log_page(log, 100, None, "prev"), "prev"), "prev"))


@register("f7_log_search", with_me(f"""
SELECT job_id, stage_progress, time, strftime(time, '%Y/%-m/%-d/%-H/%-M') AS log_stream
FROM monitoring_events WHERE errored AND priority = 'HIGH' ORDER BY {LOG_ORDER} LIMIT 10 OFFSET 10"""))
def f7_log_search(spark, sf_dir):
    log, pattern = _stored_log(spark, sf_dir), "errored HIGH :true,"  # errored comes before finished
    first = JL.log_page(log, 10, pattern=pattern)
    return _log_page(JL.log_page(log, 10, JL.log_cursor(first), pattern=pattern))


@register("s5_json_decode", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k_variant,
       CAST(json_extract(props, '$.missing') AS VARCHAR) AS missing
FROM events""")
def s5(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        J.decode("props", "k int")["k"].alias("k"),
        J.field("props", "k", "int").alias("k_variant"),
        J.field("props", "missing", "string").alias("missing"),
    )


@register("s3_append_roundtrip", with_me("SELECT * FROM monitoring_events"))
def s3(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    path = scratch_path(spark, "events")
    part = SK.with_event_date(ev, unit=SPARSE_UNIT)
    SK.append_rows(part.where(F.col("stage_progress") < 3), path, partition_by=["event_date"])
    SK.append_rows(part.where(F.col("stage_progress") >= 3), path, partition_by=["event_date"])
    stored = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(stored).parquet(path).select(*EVENT_COLUMNS)


@register("s3_stored_append", with_me("SELECT * FROM monitoring_events"))
def s3_stored(spark, sf_dir):
    """The stored layout written in two rounds, read back by its declared types."""
    ev = monitoring_events(spark, sf_dir)
    path = scratch_path(spark, "stored-events")
    for stages in ("stage_progress < 3", "stage_progress >= 3"):
        SK.store_events(ev.where(stages), path, unit=SPARSE_UNIT)
    stored = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
    return SK.read_partitioned(spark, path, stored).select(*EVENT_COLUMNS)


RUN_KEYS = ["data_store", "operation", "record_id"]


@register("s6_upsert_last_wins", with_runs("""
SELECT record_id, data_store, operation,
       CASE WHEN coalesce(is_first_query, false) THEN exec_time + 1000 ELSE exec_time END AS exec_time,
       num_records, is_first_query
FROM benchmark_runs"""))
def s6(spark, sf_dir):
    runs = benchmark_runs(spark, sf_dir)
    updates = runs.where(F.col("is_first_query")).withColumn("exec_time", F.col("exec_time") + 1000)
    return SK.upsert(runs, updates, RUN_KEYS)




def _entries_sql(cols) -> str:
    # By hand, not from the library's table: all are text but these.
    types = {"stage_progress": "BIGINT", "errored": "BOOLEAN", "finished": "BOOLEAN"}
    parts = [f"'{c}=' || CAST({c} AS VARCHAR) || ':{types.get(c, 'VARCHAR')}'" for c in cols]
    return " || ',' || ".join(parts)


@register("s8_to_records", with_me(f"""
SELECT time, 'record' AS measure_name, 'MULTI' AS measure_value_type,
       {_entries_sql(DIMENSIONS)} AS dimensions_text,
       {_entries_sql(MEASURES)} AS measures_text
FROM monitoring_events"""))
def s8_to(spark, sf_dir):
    recs = R.to_records(monitoring_events(spark, sf_dir), RECORD_TYPE_NAMES, "time", MEASURES, DIMENSIONS)

    def text(c):
        return F.array_join(F.transform(c, lambda e: F.concat(e["Name"], F.lit("="), e["Value"], F.lit(":"), e["Type"])), ",")

    return recs.select("time", "measure_name", "measure_value_type",
                       text(F.col("dimensions")).alias("dimensions_text"), text(F.col("measures")).alias("measures_text"))


@register("s8_from_records", with_me("SELECT * FROM monitoring_events"))
def s8_from(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    recs = R.to_records(ev, RECORD_TYPE_NAMES, "time", MEASURES, DIMENSIONS)
    return R.from_records(recs, [(c, EVENT_TYPE_NAMES[c]) for c in EVENT_COLUMNS])


@register("s8_records_time_units", with_me("SELECT * FROM monitoring_events"))
def s8_units(spark, sf_dir):
    """Records whose times are numbers, in another unit for each type of job, read back together."""
    ev = monitoring_events(spark, sf_dir)
    kinds = {"ADD": "SECONDS", "UPDATE": "MILLISECONDS", "DELETE": "NANOSECONDS"}
    unit = F.coalesce(*[F.when(F.col("job_type") == k, F.lit(u)) for k, u in kinds.items()], F.lit("MICROSECONDS"))
    recs = R.to_records(ev, RECORD_TYPE_NAMES, "time", MEASURES, DIMENSIONS, time_unit=unit)
    return R.from_records(recs, [(c, EVENT_TYPE_NAMES[c]) for c in EVENT_COLUMNS])


@register("s9_rejected_records", """
SELECT event_id AS record_index,
       concat_ws('; ',
         CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 168 HOUR THEN 'time outside retention window' END,
         CASE WHEN try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NULL THEN 'measure value not numeric' END,
         CASE WHEN user_id IS NULL THEN 'missing dimension user_id' END) AS reason
FROM events
WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 168 HOUR
   OR try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NULL OR user_id IS NULL""")
def s9(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    as_of = ev.select(F.max("ts")).scalar()
    txt = ev.select("event_id", "ts", F.col("value").cast("string").alias("value_txt"),
                    F.col("user_id").cast("string").alias("user_txt"))
    rules = {
        "time outside retention window": F.col("ts") < as_of - F.make_dt_interval(hours=F.lit(168)),
        "measure value not numeric": C.cast_text("value_txt", "DOUBLE", strict=False).isNull(),
        "missing dimension user_id": F.col("user_txt").isNull(),
    }
    _ok, bad = R.split_rejects(R.validate(txt, rules), "event_id")
    return bad


@register("s10_copy_projected", with_me("SELECT job_id, stage, time FROM monitoring_events"))
def s10(spark, sf_dir):
    return SK.copy_table(monitoring_events(spark, sf_dir), scratch_path(spark, "copy") + "/t", ["job_id", "stage", "time"])


@register("s13_csv_roundtrip", with_runs("SELECT * FROM benchmark_runs"))
def s13(spark, sf_dir):
    path = scratch_path(spark, "runs-csv") + "/t"
    CSV.write_runs_csv(benchmark_runs(spark, sf_dir), path)
    return CSV.read_runs_csv(spark, path)


@register("s15_expired_days", """
WITH last AS (SELECT CAST(MAX(ts) AS DATE) AS day FROM events)
SELECT event_id, ts, CAST(ts AS DATE) AS event_date, (SELECT COUNT(DISTINCT CAST(ts AS DATE)) FROM events, last WHERE CAST(ts AS DATE) <= day - 7) AS days_gone
FROM events, last WHERE CAST(ts AS DATE) > day - 7""")
def s15_expired_days(spark, sf_dir):
    """All events stored by day, and the days older than a week removed from storage."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    path = scratch_path(spark, "expiring")
    SK.append_rows(SK.with_event_date(ev, "ts"), path, partition_by=["event_date"])
    last = ev.agg(F.max(F.to_date("ts"))).first()[0]
    gone = SK.drop_expired(spark, path, last, 7)
    left = spark.read.schema("event_id long, ts timestamp_ntz, event_date date").parquet(path)
    return left.withColumn("days_gone", F.lit(len(gone)).cast("long"))


@register("s15_retained", with_me("""
SELECT * FROM monitoring_events
WHERE time >= (SELECT max(time) FROM monitoring_events) - INTERVAL 168 HOUR
  AND time <= (SELECT max(time) FROM monitoring_events)"""))
def s15(spark, sf_dir):
    ev = monitoring_events(spark, sf_dir)
    return SK.retained(ev, ev.select(F.max("time")).scalar(), hours=168)


# ------------------------------------------------------------------ latency analysis
N1_SELECT = f"""
SELECT record_id, {_sql_case('data_store', STORE_NAMES, 'data_store')} AS data_store,
       split_part(operation, '__', 1) AS query_type,
       {_sql_case("split_part(operation, '__', 1)", QUERY_TYPE_NAMES, 'NULL')} AS query_type_name,
       split_part(operation, '__', 2) AS scale, exec_time, is_first_query
FROM benchmark_runs WHERE num_records IS NULL"""
READS_CTE = f"reads AS ({N1_SELECT})"


@register("n1_read_runs", with_runs(N1_SELECT))
def n1(spark, sf_dir):
    return N.read_runs(benchmark_runs(spark, sf_dir))


REJECT_RULES_SQL = """
checked AS (
    SELECT event_id, value, list_filter([
        CASE WHEN event_id % 13 = 0 THEN 'malformed_message' END,
        CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'no_user' END,
        CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN 'negative_value' END], lambda x: x IS NOT NULL) AS reasons
    FROM events)"""


@register("s9_reject_and_continue", f"""
WITH {REJECT_RULES_SQL.strip()}
SELECT event_id, CASE WHEN len(reasons) = 0 THEN value END AS value, array_to_string(reasons, '; ') AS reason,
       (SELECT COUNT(*) FROM checked WHERE len(reasons) = 0) AS accepted,
       (SELECT COUNT(*) FROM checked WHERE len(reasons) > 0) AS rejected,
       (SELECT COUNT(*) FROM checked WHERE list_contains(reasons, 'no_user')) AS no_user
FROM checked""")
def s9_reject_and_continue(spark, sf_dir):
    """Log messages of all events, some of them cut off, without a user or of a negative value, through one accepting write."""
    n = F.col("event_id")
    ev = read_table(spark, sf_dir, "events")
    message = F.to_json(F.struct("event_id", F.when(n % 17 != 0, F.col("user_id")).alias("user_id"),
                                 F.when(n % 19 == 0, -1 - F.abs("value")).otherwise(F.abs("value")).alias("value")))
    sent = ev.select(n.alias("sent_id"), F.col("ts").alias("timestamp"), message.alias("m")).withColumn(
        "message", F.when(F.col("sent_id") % 13 == 0, F.expr("left(m, length(m) - 1)")).otherwise(F.col("m")))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    decoded, rules = JL.decode_log(sent, schema, keep=["sent_id"])
    rules = {**rules, "no_user": F.col("user_id").isNull(), "negative_value": F.col("value") < 0}
    path = scratch_path(spark, "quarantine")
    counts = R.write_or_quarantine(decoded, path, rules, "sent_id")
    good = R.accepted_rows(spark, path).select("event_id", "value", F.lit("").alias("reason"))
    bad = R.rejected_rows(spark, path).select(F.col("record_index").alias("event_id"), F.lit(None).cast("double").alias("value"), "reason")
    return good.unionByName(bad).select("*", *[F.lit(counts[c]).cast("long").alias(c) for c in ("accepted", "rejected", "no_user")])


@register("f14_discovered_fields", """
SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN user_id % 2 = 0 END AS flag,
       CASE WHEN event_id % 5 = 0 THEN '"' || CAST(user_id AS VARCHAR) || '"' ELSE CAST(user_id AS VARCHAR) END AS qty
FROM events""")
def f14_discovered_fields(spark, sf_dir):
    """Messages with differing fields, one of them a number here and a text there; no schema is given."""
    n = F.col("event_id")
    number = F.struct("event_id", "event_type", F.when(n % 3 == 0, F.col("user_id") % 2 == 0).alias("flag"), F.col("user_id").alias("qty"))
    text = F.struct("event_id", "event_type", F.when(n % 3 == 0, F.col("user_id") % 2 == 0).alias("flag"), F.col("user_id").cast("string").alias("qty"))
    messages = read_table(spark, sf_dir, "events").select(F.when(n % 5 == 0, F.to_json(text)).otherwise(F.to_json(number)).alias("message"))
    return J.project_fields(messages, "message", J.discover_fields(messages, "message"))


@register("n2_quantiles_of_doubles", """
SELECT event_type, COUNT(*) AS n, MIN(value) AS min, MAX(value) AS max, quantile_cont(value, 0.1) AS p10,
       quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.999) AS p999
FROM events GROUP BY event_type""")
def n2_doubles(spark, sf_dir):
    return N.exact_quantiles(read_table(spark, sf_dir, "events"), ["event_type"], "value", [("p10", 0.1), ("p50", 0.5), ("p999", 0.999)])


@register("n2_box_8x", with_runs("""
SELECT *, max(max_ms) OVER (PARTITION BY query_type) AS axis_max_ms FROM (
    SELECT query_type, data_store, COUNT(*) AS n,
           CAST(MIN(exec_time) AS DOUBLE) AS min_ms,
           CAST(quantile_cont(exec_time, 0.25) AS DOUBLE) AS q1_ms,
           CAST(quantile_cont(exec_time, 0.5) AS DOUBLE) AS median_ms,
           CAST(quantile_cont(exec_time, 0.75) AS DOUBLE) AS q3_ms,
           CAST(MAX(exec_time) AS DOUBLE) AS max_ms
    FROM reads WHERE scale = '8x' GROUP BY query_type, data_store)""", READS_CTE))
def n2(spark, sf_dir):
    return N.box_summary(N.read_runs(benchmark_runs(spark, sf_dir)), "8x")


@register("n3_first_query", with_runs("""
SELECT query_type, data_store, record_id, exec_time FROM reads
WHERE scale = '8x' AND is_first_query""", READS_CTE))
def n3(spark, sf_dir):
    return N.first_query_times(N.read_runs(benchmark_runs(spark, sf_dir)), "8x")


@register("n4_scaling_mean", with_runs("""
SELECT query_type, data_store, scale, round(AVG(exec_time), 6) AS mean_ms, COUNT(*) AS n
FROM reads WHERE NOT is_first_query GROUP BY query_type, data_store, scale""", READS_CTE))
def n4(spark, sf_dir):
    return N.scaling_means(N.read_runs(benchmark_runs(spark, sf_dir)))


SCALE_LIST = SCALES


@register("n4_scaling_table", with_runs("SELECT query_type, data_store, " + ", ".join(
    f"round(AVG(exec_time) FILTER (WHERE scale = '{x}'), 6) AS \"{x}\"" for x in SCALE_LIST) + """
FROM reads WHERE NOT is_first_query GROUP BY query_type, data_store""", READS_CTE))
def n4_table(spark, sf_dir):
    return N.scaling_table(N.read_runs(benchmark_runs(spark, sf_dir)), SCALE_LIST)


@register("s7_fan_out", with_me("SELECT *, strftime(time, '%Y/%-m/%-d/%-H/%-M') AS log_stream FROM monitoring_events"))
def s7(spark, sf_dir):
    """One event set to two sinks (parquet table, JSON log); the log is read back."""
    ev = monitoring_events(spark, sf_dir)
    table, log = scratch_path(spark, "fan-table"), scratch_path(spark, "fan-log")
    SK.fan_out(ev, [lambda d: SK.append_rows(d, table),
                    lambda d: JL.write_log(d, log, unit=SPARSE_UNIT)])
    return _decode_with_stream(JL.read_log(spark, log))


@register("s7_fan_out_encodings", with_me("""
SELECT e.*, s.sink FROM monitoring_events e
CROSS JOIN (VALUES ('table'), ('log'), ('records'), ('documents')) AS s(sink)"""))
def s7_encodings(spark, sf_dir):
    """One event set to all four encodings, each read back as events."""
    ev = monitoring_events(spark, sf_dir)
    table, log, records, documents = (scratch_path(spark, f"fan-{s}") for s in ("table", "log", "records", "documents"))
    SK.fan_out(ev, [
        lambda d: SK.append_rows(d, table),
        lambda d: JL.write_log(d, log, unit=SPARSE_UNIT),
        lambda d: R.to_records(d, RECORD_TYPE_NAMES, "time", MEASURES, DIMENSIONS).write.option("compression", "zstd").parquet(records),
        lambda d: SK.append_with_ids(d, documents),
    ])
    back = {
        "table": spark.read.schema(EVENT_SCHEMA).parquet(table),
        "log": _decode_with_stream(JL.read_log(spark, log)),
        "records": R.from_records(spark.read.parquet(records), [(c, EVENT_TYPE_NAMES[c]) for c in EVENT_COLUMNS]),
        "documents": spark.read.parquet(documents),
    }
    every = [df.select(*EVENT_COLUMNS, F.lit(sink).alias("sink")) for sink, df in back.items()]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@register("s2_table_roundtrip", with_me("SELECT * FROM monitoring_events"))
def s2(spark, sf_dir):
    """Create a catalog table from the declared schema (if absent), append, read it."""
    import uuid

    from ..sources import catalog as CAT

    name = f"monitoring_events_{uuid.uuid4().hex[:12]}"
    CAT.create_table_if_absent(spark, name, EVENT_SCHEMA, path=scratch_path(spark, "table"))
    SK.append_to_table(monitoring_events(spark, sf_dir), name)
    CAT.refresh_table(spark, name)
    return spark.table(name)


@register("s6_upsert_text_partition", with_me("""
SELECT user_id, job_id, stage_progress, CASE WHEN user_id = '0011' THEN NOT errored ELSE errored END AS errored
FROM monitoring_events"""))
def s6_text(spark, sf_dir):
    """Upsert into a table partitioned by a text with leading zeros; one partition is touched."""
    ev = monitoring_events(spark, sf_dir).select("user_id", "job_id", "stage_progress", "errored")
    table = scratch_path(spark, "users-table")
    SK.append_rows(ev, table, partition_by=["user_id"])
    updates = ev.where("user_id = '0011'").withColumn("errored", ~F.col("errored"))
    out = SK.upsert_partitions(table, updates, ["user_id", "job_id", "stage_progress"], ["user_id"])
    return out.select("user_id", "job_id", "stage_progress", "errored")


@register("s6_upsert_duplicate_updates", with_runs("""
SELECT record_id, data_store, operation,
       CASE WHEN coalesce(is_first_query, false) THEN 2 ELSE exec_time END AS exec_time, num_records, is_first_query
FROM benchmark_runs"""))
def s6_twice(spark, sf_dir):
    """Two updates of a key: the later one wins, though its payload is the smaller."""
    runs = benchmark_runs(spark, sf_dir).withColumn("version", F.lit(0))
    first = runs.where("is_first_query").withColumns({"exec_time": F.lit(10**9).cast("bigint"), "version": F.lit(1)})
    last = first.withColumns({"exec_time": F.lit(2).cast("bigint"), "version": F.lit(2)})
    return SK.upsert(runs, last.unionByName(first), RUN_KEYS, order=["version"]).drop("version")


@register("s6_upsert_partitions", with_runs("""
SELECT record_id, data_store, operation,
       CASE WHEN coalesce(is_first_query, false) THEN exec_time + 1000 ELSE exec_time END AS exec_time,
       num_records, is_first_query
FROM benchmark_runs"""))
def s6_parts(spark, sf_dir):
    """Upsert into a table partitioned by store: only touched stores are rewritten."""
    runs = benchmark_runs(spark, sf_dir)
    table = scratch_path(spark, "runs-table")
    SK.append_rows(runs, table, partition_by=["data_store"])
    updates = runs.where(F.col("is_first_query")).withColumn("exec_time", F.col("exec_time") + 1000)
    out = SK.upsert_partitions(table, updates, RUN_KEYS, ["data_store"])
    return out.select("record_id", "data_store", "operation", "exec_time", "num_records", "is_first_query")


@register("s6_upsert_pending", with_runs("""
SELECT record_id, data_store, operation,
       CASE WHEN coalesce(is_first_query, false) THEN exec_time + 1000 ELSE exec_time END AS exec_time,
       num_records, is_first_query
FROM benchmark_runs"""))
def s6_pending(spark, sf_dir):
    """An upsert that has been decided but not published: read whole all the same."""
    runs = benchmark_runs(spark, sf_dir)
    table = scratch_path(spark, "runs-table")
    SK.append_rows(runs, table, partition_by=["data_store"])
    updates = runs.where(F.col("is_first_query")).withColumn("exec_time", F.col("exec_time") + 1000)
    schema = SK.stage_upsert(table, updates, RUN_KEYS, ["data_store"])
    out = SK.current_rows(spark, table, schema)
    return out.select("record_id", "data_store", "operation", "exec_time", "num_records", "is_first_query")
