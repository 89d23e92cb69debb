"""Reject-and-continue writes, field discovery, times of day, upserts that nothing decides."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewatch.functions import casts as C
from stagewatch.functions import jsonfns as J
from stagewatch.session import scratch_path
from stagewatch.sources import jsonlog as JL
from stagewatch.sources import records as R
from stagewatch.sources import sinks as SK

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("time", T.TimestampNTZType())])


def _log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(0, t, '{"a": 1, "b": "x"}'), (1, t, '{"a": 1, "b": '), (2, t, None), (3, t, "[1]"), (4, t, '{"a": "no number", "b": "y"}'),
            (5, t, "{}"), (6, t, '{"a": -4}'), (7, t, "")]
    return spark.createDataFrame(rows, "i int, timestamp timestamp_ntz, message string")


def test_malformed_messages_are_told_apart(spark):
    out, rules = JL.decode_log(_log(spark), SCHEMA, keep=["i"])
    got = {r["i"]: r for r in out.withColumn("bad", rules[JL.MALFORMED]).collect()}
    assert {i for i, r in got.items() if r["bad"]} == {1, 2, 3, 4, 7}
    assert (got[0]["a"], got[0]["b"], got[0]["time"]) == (1, "x", dt.datetime(2024, 1, 1))
    assert got[5]["a"] is None and got[1][JL.MALFORMED] == '{"a": 1, "b": '


def test_a_write_goes_on_past_bad_rows(spark):
    out, rules = JL.decode_log(_log(spark), SCHEMA, keep=["i"])
    rules = {**rules, "no b": F.col("b").isNull(), "negative": F.col("a") < 0}
    path = scratch_path(spark, "rejects")
    counts = R.write_or_quarantine(out, path, rules, "i")
    assert counts == {"accepted": 1, "rejected": 7, JL.MALFORMED: 5, "no b": 6, "negative": 7}
    good, bad = R.accepted_rows(spark, path), R.rejected_rows(spark, path)
    assert [(r["i"], r["a"]) for r in good.collect()] == [(0, 1)] and set(good.columns) == {"i", "a", "b", "time", JL.MALFORMED}
    reasons = {r["record_index"]: r["reason"] for r in bad.collect()}
    assert reasons[6] == "no b; negative" and reasons[1] == "malformed_message; no b; negative"
    R.write_or_quarantine(out, path, rules, "i")            # appends
    assert R.accepted_rows(spark, path).count() == 2 and R.rejected_rows(spark, path).count() == 14
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_rejected" in plan


def test_counts_come_with_the_write(spark):
    """The input is computed once: no second pass for the counts."""
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(tick, "id long")
    counts = R.write_or_quarantine(df, scratch_path(spark, "once"), {"odd": F.col("id") % 2 == 1}, "id")
    assert counts == {"accepted": 50, "rejected": 50, "odd": 50} and seen.value == 100


def test_an_empty_write(spark):
    df = spark.createDataFrame([], "i int")
    assert R.write_or_quarantine(df, scratch_path(spark, "none"), {"r": F.col("i") < 0}, "i") == {"accepted": 0, "rejected": 0, "r": 0}


def test_typed_rows_or_null(spark):
    df = spark.createDataFrame([(0, "1", "2024-01-02", "x"), (1, "one", "2024-01-02", "y"), (2, None, "yesterday", None)], "i int, n string, d string, s string")
    typed, rules = R.typed_or_null(df, [("n", "BIGINT"), ("d", "DATE"), ("s", "VARCHAR")])
    path = scratch_path(spark, "typed")
    assert R.write_or_quarantine(typed, path, rules, "i") == {"accepted": 1, "rejected": 2, "n: not BIGINT": 1, "d: not DATE": 1}
    assert {r["record_index"]: r["reason"] for r in R.rejected_rows(spark, path).collect()} == {1: "n: not BIGINT", 2: "d: not DATE"}
    assert [tuple(r) for r in R.accepted_rows(spark, path).select("i", "n", "d", "s").collect()] == [(0, 1, dt.date(2024, 1, 2), "x")]


def test_fields_are_discovered(spark):
    rows = ['{"a": 1, "b": "x", "odd name\'s": true}', '{"a": 2.5, "c": {"d": [1, 2]}, "e": null}', '{"b": 7, "f": [1]}', "broken {", None, "[1, 2]", '"text"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m string")
    objects = df.where("i < 5")
    fields = dict(J.discover_fields(objects, "m"))
    assert fields["b"] == "variant" and fields["c"] == "variant" and fields["odd name's"] == "boolean" and "e" not in fields
    assert fields["a"].startswith("decimal")
    got = {r["i"]: r.asDict() for r in J.project_fields(objects, "m", sorted(fields.items()), ["i"]).collect()}
    assert (float(got[0]["a"]), got[0]["b"], got[0]["odd name's"]) == (1.0, '"x"', True)
    assert got[1]["c"] == '{"d":[1,2]}' and got[2]["b"] == "7" and got[2]["f"] == "[1]" and got[3]["a"] is None and got[4]["b"] is None
    assert J.discover_fields(df.where("i = 3"), "m") == [] and J.discover_fields(df.limit(0), "m") == []


def test_times_of_day(spark):
    rows = [("23:59:59.123456789",), ("00:00:00.000000000",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    want = ["23:59:59.123456", "00:00:00.000000", None]
    assert [r[0] for r in df.select(C.cast_text("t", "TIME")).collect()] == want
    for bad in ("garbage000", "24:00:00.000000000", "12:60:00.000000000", "12:00:00", "1:00:00.000000000", ""):
        one = spark.createDataFrame([(bad,)], "t string")
        assert one.select(C.cast_text("t", "TIME", strict=False)).first()[0] is None
        with pytest.raises(Exception, match="not a TIME"):
            one.select(C.cast_text("t", "TIME")).collect()
    old = spark.conf.get("spark.sql.timeType.enabled", "false")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        typed = df.select(C.typed_time(C.cast_text("t", "TIME")).alias("t"))
        assert typed.schema["t"].dataType.simpleString() == "time(6)"
        assert [r[0] for r in typed.collect()] == [dt.time(23, 59, 59, 123456), dt.time(0, 0), None]
    finally:
        spark.conf.set("spark.sql.timeType.enabled", old)


@pytest.mark.parametrize("order", [[], ["o"]])
def test_undecided_updates_raise(spark, order):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "base"), ("c", 1, "c")], "k string, o int, v string")
    updates = spark.createDataFrame([("a", 9, "zz"), ("a", 9, "aa")], base.schema)
    for columns in (["k"], ["k", "o", "v"]):
        with pytest.raises(Exception, match="no order decides"):
            SK.merge_updates(base, updates, ["k"], order).select(*columns).collect()
    same = spark.createDataFrame([("a", 9, "zz"), ("a", 9, "zz"), ("d", 0, None)], base.schema)
    got = sorted(map(tuple, SK.merge_updates(base, same, ["k"], order).collect()))
    assert got == [("a", 9, "zz"), ("b", 5, "base"), ("c", 1, "c"), ("d", 0, None)]


def test_ordered_updates(spark):
    base = spark.createDataFrame([("a", 5, "base"), ("b", 5, "base"), (None, 1, "base")], "k string, o int, v string")
    updates = spark.createDataFrame([("a", 4, "late"), ("b", 5, "even"), ("b", 3, "x"), ("b", 3, "y"), (None, 2, "new")], base.schema)
    got = {tuple(r) for r in SK.merge_updates(base, updates, ["k"], ["o"]).collect()}
    assert got == {("a", 5, "base"), ("b", 5, "even"), (None, 2, "new")}
