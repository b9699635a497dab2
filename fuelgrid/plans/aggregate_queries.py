"""Aggregates, robust statistics and backfitting over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.operators import robust as R

from .adapters import LOG, PANEL, SNAPS
from .registry import query

G = "GROUP BY ALL"


@query("g2_monthly_benchmark", "SELECT o_orderstatus AS fuel, last_day(o_orderdate::DATE) AS month, median(o_totalprice) AS median, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, count(DISTINCT o_custkey) AS stations FROM orders GROUP BY ALL")
def monthly_benchmark(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("fuel"), F.last_day(F.to_date("o_orderdate")).alias("month")).agg(
        F.median("o_totalprice").alias("median"), F.round(F.percentile("o_totalprice", 0.1), 6).alias("p10"), F.round(F.percentile("o_totalprice", 0.9), 6).alias("p90"), F.count_distinct("o_custkey").alias("stations"))


@query("g4_mad", "SELECT event_type AS fuel, median(value) AS median, mad(value) AS mad FROM events GROUP BY ALL")
def mad(t):
    return R.mad(t.events.select(F.col("event_type").alias("fuel"), "value"), "value", ["fuel"])


@query("w1_relative_price", f"WITH {SNAPS} SELECT station_id, fuel, date, price - median(price) OVER (PARTITION BY date, fuel) AS relative FROM snaps")
def relative_price(t):
    return t.panel().select("station_id", "fuel", "date", "relative")


_Z = f"WITH {LOG}, a AS (SELECT *, median(price) OVER (PARTITION BY fuel) AS m FROM log), b AS (SELECT *, 1.4826 * median(abs(price - m)) OVER (PARTITION BY fuel) AS s FROM a)"


@query("w2_robust_z", _Z + " SELECT station_id, fuel, updated_at, round(CASE WHEN s > 0 THEN (price - m) / s ELSE 0 END, 6) AS z, round((price - m) / greatest(s, 50.0::DOUBLE), 6) AS floored FROM b")
def robust_z(t):
    df = R.robust_z(R.robust_z(t.log(), "price", ["fuel"]), "price", ["fuel"], "floored", 50.0)
    return df.select("station_id", "fuel", "updated_at", F.round("z", 6).alias("z"), F.round("floored", 6).alias("floored"))


@query("f12_trim", _Z + " SELECT fuel, count(*) AS n, median(price) AS median FROM b WHERE abs((price - m) / s) <= 1 GROUP BY ALL")
def trim(t):
    df = R.trimmed(R.robust_z(t.log(), "price", ["fuel"]), "z", 1.0, ["fuel"])
    return df.groupBy("fuel").agg(F.count("*").alias("n"), F.median("price").alias("median"))


@query("g5_shrunk_effect", f"WITH {PANEL} SELECT fuel, region, count(relative) AS n_obs, round(median(relative) * count(relative) / (count(relative) + 40.0), 9) AS effect FROM panel GROUP BY ALL")
def shrunk_effect(t):
    return R.shrunk_effect(t.panel(), F.col("relative"), ["fuel", "region"], 40).select("fuel", "region", "n_obs", F.round("effect", 9).alias("effect"))


@query("g6_unit_effect", f"WITH {PANEL}, u AS (SELECT fuel, region, station_id, median(relative) AS m, count(*) AS n FROM panel GROUP BY ALL) SELECT fuel, region, sum(n)::BIGINT AS n_obs, count(*) AS n_units, round(median(m) * count(*) / (count(*) + 80.0), 9) AS effect FROM u GROUP BY ALL")
def unit_effect(t):
    df = R.shrunk_effect(t.panel(), F.col("relative"), ["fuel", "region"], 80, "station_id")
    return df.select("fuel", "region", "n_obs", "n_units", F.round("effect", 9).alias("effect"))


@query("g8_group_premium", f"WITH {PANEL}, m AS (SELECT fuel, road, median(relative) AS m, count(*) AS n FROM panel GROUP BY ALL), e AS (SELECT fuel, median(relative) AS every FROM panel GROUP BY ALL), b AS (SELECT m.*, coalesce(max(CASE WHEN road = 'b0' THEN m END) OVER (PARTITION BY m.fuel), every) AS base FROM m JOIN e USING (fuel)) SELECT fuel, road, n, round(CASE WHEN road = 'b0' THEN 0.0::DOUBLE ELSE m - base END, 9) AS raw, round(CASE WHEN road = 'b0' THEN 0.0::DOUBLE WHEN road = 'b1' THEN greatest((m - base) * n / (n + 10.0), 0.0::DOUBLE) ELSE (m - base) * n / (n + 10.0) END, 9) AS premium FROM b")
def group_premium(t):
    df = R.group_premium(t.panel(), "relative", "fuel", "road", "b0", floored=["b1"])
    return df.withColumns({"raw": F.round("raw", 9), "premium": F.round("premium", 9)})


@query("g9_persistent_bias", f"WITH {PANEL} SELECT station_id, median(relative) AS raw_bias, count(DISTINCT date_trunc('week', date)) AS months, count(*) AS n_obs, round(median(relative) * count(DISTINCT date_trunc('week', date)) / (count(DISTINCT date_trunc('week', date)) + 6.0), 9) AS bias FROM panel GROUP BY ALL")
def persistent_bias(t):
    return R.persistent_bias(t.panel(), "relative", "station_id", F.date_trunc("week", "date")).withColumn("bias", F.round("bias", 9))


@query("g10_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY ALL")
def ols(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))


@query("g13_residuals", "SELECT l_shipmode_ AS k, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT l_linestatus AS l_shipmode_, l_discount - l_tax AS e FROM lineitem) GROUP BY ALL")
def residuals(t):
    df = R.error_metrics(t.lineitem.withColumn("k", F.col("l_linestatus")), "l_discount", "l_tax", ["k"])
    return df.select("k", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("g14_flag_rate", "SELECT l_returnflag, count_if(l_quantity > 10) AS n, count_if(l_quantity > 10 AND l_discount > 0.05) AS hits, count_if(l_quantity > 10 AND l_discount > 0.05)::DOUBLE / nullif(count_if(l_quantity > 10), 0) AS rate FROM lineitem GROUP BY ALL")
def flag_rate(t):
    return R.conditional_rate(t.lineitem, ["l_returnflag"], F.col("l_discount") > 0.05, F.col("l_quantity") > 10)


@query("g16_best_candidate", "WITH c AS (SELECT l_returnflag, l_linestatus, round(stddev_samp(l_tax), 9) AS rmse FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(l_linestatus, rmse) AS best, min(rmse) AS rmse FROM c GROUP BY ALL")
def best_candidate(t):
    c = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.stddev_samp("l_tax"), 9).alias("rmse"))
    return c.groupBy("l_returnflag").agg(F.min_by("l_linestatus", "rmse").alias("best"), F.min("rmse").alias("rmse"))
