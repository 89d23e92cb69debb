"""Rank selection: offset pages, numbering and quantiles that hold no prefix and no group in one task."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stagewatch.operators import latency as N
from stagewatch.operators import paging as P
from stagewatch.operators import ranks as R


@pytest.fixture
def many_ranges(spark):
    """Several ranges of a small table, and next to no rows besides the wanted ones."""
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("false", "7")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def _rows(n=500):
    rng = random.Random(5)
    t = dt.datetime(2024, 3, 31, 1, 30)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, t + dt.timedelta(seconds=rng.randrange(40), microseconds=3)]), i, rng.random())
            for i in range(n)]
    rng.shuffle(rows)
    return rows


def _key(r):
    return tuple((c is not None, c) if c is not None else (False, 0) for c in r[:3])


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_pages_at_every_depth(spark, many_ranges, monkeypatch, kind, order):
    rows = _rows()
    df = spark.createDataFrame(rows, f"k string, t {kind}, i int, v double")
    want = sorted(rows, key=_key, reverse=order == "DESC")
    monkeypatch.setattr(R, "FEW", 5)
    monkeypatch.setattr(R.around, "__defaults__", (5,))
    for after, size in ((0, 10), (123, 40), (495, 20), (600, 5), (7, 0)):
        got = P.offset_page(df, size, after, ["k", "t", "i"], order).collect()
        assert [tuple(r)[1:] for r in got] == want[after:after + size]
        assert [r["row_num"] for r in got] == list(range(after + 1, min(after + size, 500) + 1))
    assert P.offset_page(df.limit(0), 10, 0, ["k", "t", "i"], order).collect() == []


def test_an_interval_holds_few_rows_besides(spark, many_ranges):
    df = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    interval, total = R.around(df, ["k"], 9_000, 9_100, few=50)
    assert total == 20_000 and interval.rows <= 151 and interval.before < 9_000 <= interval.before + interval.rows
    inside = R.within(df, ["k"], interval)
    assert inside.count() == interval.rows
    # one key in most rows cannot be parted
    hot = spark.range(5_000).withColumn("k", F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")))
    interval, _ = R.around(hot, ["k"], 2_000, 2_010, few=50)
    assert interval.before < 2_000 and interval.rows >= 4_500


def test_a_deep_page_pushes_its_interval_to_the_scan(spark, tmp_path):
    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    page = P.offset_page(spark.read.parquet(str(tmp_path / "t")), 10, 40_000, "id")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and [r["id"] for r in page.collect()] == list(range(40_000, 40_010))


def test_numbers_with_null_keys_and_other_columns(spark, many_ranges):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v double")
    got = {tuple(r)[:4]: (r["row_no"], r["batch_no"]) for r in P.batch_numbers(df, ["k", "t", "i"], 30).collect()}
    assert got == {r: (n + 1, n // 30) for n, r in enumerate(sorted(rows, key=_key))}


def test_quantiles_of_a_hot_group(spark, many_ranges):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["x", "y", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None])) for i in range(4000)]
    rows += [("one", 3.5), ("none", None)]
    wanted = [("p0", 0.0), ("p10", 0.1), ("p50", 0.5), ("p999", 0.999), ("p100", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in N.exact_quantiles(df, ["g"], "v", wanted).collect()}
    con = duckdb.connect()
    con.execute("create table t(g varchar, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    qs = ", ".join(f"quantile_cont(v, {q})" for _, q in wanted)
    want = {r[0]: r[1:] for r in con.sql(f"select g, count(v), min(v), max(v), {qs} from t where v is not null group by g").fetchall()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12)


def test_no_window_holds_a_group_of_values(spark, many_ranges):
    """The running sums over values go by cell, those by group see the cells alone."""
    df = spark.range(1000).selectExpr("id % 2 as g", "cast(id as double) as v")
    plan = N.exact_quantiles(df, ["g"], "v", [("p50", 0.5)])._jdf.queryExecution().executedPlan().toString()
    over_values = [line for line in plan.splitlines() if "Window" in line and "_v#" in line.split("windowspecdefinition")[-1]]
    assert over_values and all("_p#" in line for line in over_values)
