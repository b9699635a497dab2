"""Anchored quotes, and the promises of the series operators on null keys and clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fuelgrid.operators import market, series

D = dt.date


def quotes(spark, anchors, targets, proxy=None, shape="fuel string, date date, quote double"):
    a = spark.createDataFrame([("A", *x) for x in anchors], shape)
    t = spark.createDataFrame([("A", d) for d in targets], "fuel string, day date")
    p = spark.createDataFrame([("A", *x) for x in (proxy or [(D(2024, 1, 1), 1.0), (D(2024, 3, 1), 2.0)])], "fuel string, proxy_date date, proxy double")
    return [(r.anchor_date, r.quote, r.quote_source) for r in series.anchored(t, a, p, ["fuel"], "day").orderBy("day").collect()]


def test_the_month_s_own_anchor_comes_with_its_own_date(spark):
    got = quotes(spark, [(D(2024, 2, 29), 1.0), (D(2024, 3, 31), 2.0)], [D(2024, 3, 15)])
    assert got == [(D(2024, 3, 31), 2.0, "SAME_MONTH")]


def test_an_anchor_holds_from_its_effective_date(spark):
    shape = "fuel string, date date, quote double, effective_date date"
    rows = [(D(2024, 1, 31), 1.0, D(2024, 1, 10)), (D(2024, 2, 29), 4.0, D(2024, 4, 2)), (D(2024, 5, 31), 9.0, None)]
    got = quotes(spark, rows, [D(2024, 1, 2), D(2024, 2, 3), D(2024, 3, 5), D(2024, 4, 1), D(2024, 4, 2), D(2023, 1, 1)], [(D(2023, 1, 1), 0.5), (D(2024, 1, 1), 1.0), (D(2024, 3, 1), 2.0)], shape)
    assert got == [(D(2024, 1, 10), 0.5, "BACKCAST"), (D(2024, 1, 10), 1.0, "SAME_MONTH"), (D(2024, 4, 2), 4.0, "SAME_MONTH"), (D(2024, 1, 10), 2.0, "ANCHORED"), (D(2024, 1, 10), 2.0, "ANCHORED"), (D(2024, 4, 2), 4.0, "ANCHORED")]


def test_days_without_a_proxy_value_are_passed_over(spark):
    rows = [(D(2024, 1, 1), 1.0), (D(2024, 3, 1), 3.0), (D(2024, 3, 2), None)]
    assert quotes(spark, [(D(2024, 1, 31), 2.0)], [D(2024, 3, 5)], rows) == [(D(2024, 1, 31), 6.0, "ANCHORED")]
    assert quotes(spark, [(D(2024, 1, 31), 2.0)], [D(2024, 3, 5)], [(D(2024, 2, 1), 1.0)]) == [(D(2024, 1, 31), None, "UNAVAILABLE")]


def test_without_a_proxy_series_even_the_month_is_unavailable(spark):
    a = spark.createDataFrame([("B", D(2024, 1, 31), 2.0)], "fuel string, date date, quote double")
    t = spark.createDataFrame([("B", D(2024, 1, 5)), (None, D(2024, 1, 5))], "fuel string, day date")
    p = spark.createDataFrame([("A", D(2024, 1, 1), 1.0)], "fuel string, proxy_date date, proxy double")
    assert {(r.fuel, r.anchor_date, r.quote_source) for r in series.anchored(t, a, p, ["fuel"], "day").collect()} == {("B", None, "UNAVAILABLE"), (None, None, "UNAVAILABLE")}


def test_refined_history_takes_each_fuel_s_filter(spark):
    days = [(f, D(2024, 1, 1) + dt.timedelta(k), 1.0 + k, 2.0, 3.0 + (k > 40), 4.0) for f in ("a", "b") for k in range(90)]
    proxy = spark.createDataFrame(days, "fuel string, date date, proxy double, proxy_ma3 double, proxy_ma5 double, proxy_ma7 double")
    anchors = spark.createDataFrame([(f, D(2024, 1, 31), 10.0) for f in "ab"], "fuel string, date date, quote double")
    best = spark.createDataFrame([("A", "proxy")], "fuel string, filter string")
    got = {r.fuel: r for r in market.refined_history(spark.createDataFrame([(f, D(2024, 3, 1)) for f in "ab"], "fuel string, date date"), proxy, anchors, best).collect()}
    assert (got["A"].selected_filter, got["A"].refined) == ("proxy", 10 * 61 / 31) and (got["B"].selected_filter, got["B"].refined) == ("proxy_ma5", 10 * 4 / 3)


def test_null_keys_are_keys_and_names_may_clash(spark):
    df = spark.createDataFrame([(None, D(2024, 1, 1), 1.0, 5), (None, D(2024, 1, 3), 3.0, 6), ("x", D(2024, 1, 1), 9.0, 7)], "fuel string, date date, v double, _a int")
    got = sorted(((r.fuel or "", r.date.day, r.v, r._a) for r in series.densify(df, ["fuel"], "date").collect()), key=str)
    assert got == [("", 1, 1.0, 5), ("", 2, None, None), ("", 3, 3.0, 6), ("x", 1, 9.0, 7)]
    live = spark.createDataFrame([(None, 2.0)], "fuel string, v double")
    old = spark.createDataFrame([(None, 1.0, "keep"), ("x", 1.0, "keep")], "fuel string, v double, _v string")
    assert {(r.fuel, r.v, r._v, r.source) for r in series.overwritten(old, live, ["fuel"], ["v"]).collect()} == {(None, 2.0, "keep", "LIVE"), ("x", 1.0, "keep", "HISTORY")}
    assert series.latest(spark.createDataFrame([("k", 1, 2), ("k", 3, 1)], "row string, t int, v int"), ["row"], ["t"]).collect()[0].v == 1
    log = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 5), "mine")], "station string, at timestamp, _to string")
    assert {(r._to, r.date.day) for r in series.snapshots(log, ["station"], "at", "day", 2).collect()} == {("mine", 1), ("mine", 2)}


def test_effective_rows_may_nest_and_overlap_elsewhere(spark):
    rnd = random.Random(1)
    spans = []
    for k in (None, "x", "y"):
        for _ in range(40):
            a = rnd.randint(0, 300)
            spans.append((k, D(2024, 1, 1) + dt.timedelta(a), None if rnd.random() < 0.03 else D(2024, 1, 1) + dt.timedelta(a + rnd.randint(-2, 40)), len(spans)))
    days = [D(2024, 1, 1) + dt.timedelta(n) for n in range(350)]
    holding = {(k, d): [v for s, a, b, v in spans if s == k and a <= d and (b is None or b >= d)] for k in (None, "x", "y") for d in days}
    fine = [(k, d) for (k, d), v in holding.items() if len(v) == 1]
    table = spark.createDataFrame(spans, "key string, effective_from date, effective_to date, v int")
    df = spark.createDataFrame(fine * 2, "key string, day date")
    got = series.effective(df, table, ["key"], "day").collect()
    assert len(got) == 2 * len(fine) and all([r.v] == holding[r.key, r.day] for r in got) and len(fine) > 20
    for wanted in (0, 2):
        bad = next(x for x, v in holding.items() if len(v) == wanted)
        with pytest.raises(Exception, match="not exactly one effective row"):
            series.effective(spark.createDataFrame([bad], df.schema), table, ["key"], "day").collect()


def test_a_long_schedule_is_swept(spark):
    table = spark.range(60_000).select(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 60_000).cast("int")).alias("effective_from"), F.col("id").alias("v"))
    table = table.withColumn("effective_to", F.col("effective_from"))
    df = spark.createDataFrame([(D(1900, 1, 1),), (D(2000, 1, 1),)], "day date")
    assert {r.v for r in series.effective(df, table, [], "day").collect()} == {0, (D(2000, 1, 1) - D(1900, 1, 1)).days}
