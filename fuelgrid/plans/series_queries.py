"""Ordered and joined series over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.operators import geo, series as T

from .adapters import ANCHORS, DAILY, LOG, LONG, MONTHLY, SNAPS, STATIONS
from .registry import query

_FULL = f"WITH {DAILY}, ends AS (SELECT fuel, min(date) AS a, max(date) AS b FROM daily GROUP BY 1), every AS (SELECT fuel, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM ends), dense AS (SELECT every.fuel, every.date, value FROM every LEFT JOIN daily USING (fuel, date))"


@query("w4_lagged_median", f"WITH {DAILY} SELECT fuel, date, CASE WHEN count(value) OVER w >= 3 THEN median(value) OVER w ELSE 50.0::DOUBLE END AS normal FROM daily WINDOW w AS (PARTITION BY fuel ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def lagged_median(t):
    return T.lagged_median(t.daily(), ["fuel"], "date", "value", "normal", otherwise=F.lit(50.0)).select("fuel", "date", "normal")


@query("w5_rolling_means", f"WITH {DAILY} SELECT fuel, date, " + ", ".join(f"round(avg(value) OVER (PARTITION BY fuel ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS value_ma{n}" for n in (3, 5, 7)) + " FROM daily")
def rolling_means(t):
    df = T.rolling_mean(t.daily(), ["fuel"], "date", "value", (3, 5, 7))
    return df.select("fuel", "date", *[F.round(f"value_ma{n}", 6).alias(f"value_ma{n}") for n in (3, 5, 7)])


@query("j8_densify", _FULL + " SELECT * FROM dense")
def densify(t):
    return T.densify(t.daily(), ["fuel"], "date")


@query("w6_fill_limited", _FULL + " SELECT fuel, date, last_value(value IGNORE NULLS) OVER w AS value, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER w AS value_date FROM dense WINDOW w AS (PARTITION BY fuel ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def fill_limited(t):
    return T.forward_fill(T.densify(t.daily(), ["fuel"], "date"), ["fuel"], "date", "value", 4)


@query("w7_fill", _FULL + " SELECT fuel, date, last_value(value IGNORE NULLS) OVER w AS value, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER w AS value_date FROM dense WINDOW w AS (PARTITION BY fuel ORDER BY date ROWS UNBOUNDED PRECEDING)")
def fill(t):
    return T.forward_fill(T.densify(t.daily(), ["fuel"], "date"), ["fuel"], "date", "value")


@query("w8_log_return", f"WITH {DAILY} SELECT fuel, date, round(ln(value) - lag(ln(value)) OVER (PARTITION BY fuel ORDER BY date), 9) AS log_return FROM daily")
def log_return(t):
    df = T.log_return(t.daily(), ["fuel"], "date", "value")
    return df.select("fuel", "date", F.round("log_return", 9).alias("log_return"))


@query("w10_snapshots", f"WITH {SNAPS} SELECT * FROM snaps")
def snapshots(t):
    return T.snapshots(t.log(), ["station_id", "fuel"], "updated_at", "day", 3, last=t.last_day()).select("station_id", "fuel", "date", "price", "updated_at")


@query("w10_month_ends", f"""WITH {LONG}, ends AS (SELECT DISTINCT last_day(updated_at::DATE) AS date FROM long_log), e AS (SELECT DISTINCT station_id, fuel FROM long_log)
SELECT station_id, fuel, date, arg_max(price, (updated_at, tie)) AS price FROM long_log JOIN ends ON updated_at < date + INTERVAL 1 DAY AND updated_at >= date - INTERVAL 31 DAY GROUP BY 1, 2, 3
HAVING (epoch_us((date + INTERVAL 1 DAY)::TIMESTAMP) - 1 - epoch_us(max(updated_at)))::DOUBLE / 86400000000.0 <= 30""")
def month_ends(t):
    last = t.orders.agg(F.last_day(F.max(F.to_date("o_orderdate"))).cast("string")).first()[0]
    return T.snapshots(t.long_log(), ["station_id", "fuel"], "updated_at", "month", 30, "tie", last).select("station_id", "fuel", "date", "price")


@query("w11_rebased", f"WITH {DAILY} SELECT fuel, date, round(100 * value / first_value(value) OVER (PARTITION BY fuel ORDER BY date), 6) AS index FROM daily")
def rebased(t):
    return T.rebased(t.daily(), ["fuel"], "date", "value", "index").select("fuel", "date", F.round("index", 6).alias("index"))


_ASOF = f"WITH {DAILY}, weekly AS (SELECT DISTINCT event_type || '-' || (user_id % 20) AS fuel, date_trunc('week', ts)::DATE AS week FROM events)"


@query("j4_asof", _ASOF + " SELECT weekly.fuel, week, date, value FROM weekly ASOF LEFT JOIN daily ON weekly.fuel = daily.fuel AND week >= date")
def asof(t):
    return T.asof(_weekly(t), t.daily(), ["fuel"], "week", "date")


@query("j5_asof_tolerance", f"WITH {MONTHLY}, d AS (SELECT DISTINCT o_orderstatus AS fuel, o_orderdate::DATE AS day FROM orders), j AS (SELECT d.fuel, day, date, quote FROM d ASOF LEFT JOIN monthly m ON d.fuel = m.fuel AND day >= date) SELECT fuel, day, CASE WHEN day - date <= 14 THEN date END AS date, CASE WHEN day - date <= 14 THEN quote END AS quote FROM j")
def asof_tolerance(t):
    days = t.orders.select(F.col("o_orderstatus").alias("fuel"), F.to_date("o_orderdate").alias("day")).distinct()
    return T.asof(days, t.monthly(), ["fuel"], "day", "date", 14)


def _weekly(t):
    return t.daily().select("fuel", F.to_date(F.date_trunc("week", "date")).alias("week")).distinct()


_ANCHORED = f"""
WITH {ANCHORS},
an AS (
  SELECT fuel, date, quote, CASE WHEN month(date) % 3 < 2 THEN date + CAST((month(date) % 3) * 40 - 20 AS INTEGER) END AS effective_date FROM anchors
),
dated AS (SELECT fuel, date, quote, coalesce(effective_date, date) AS eff FROM an),
t AS (SELECT DISTINCT o_orderstatus AS fuel, o_orderdate::DATE AS day FROM orders),
proxy AS (
  SELECT o_orderstatus AS fuel, o_orderdate::DATE AS d, CASE WHEN day(o_orderdate) % 7 > 0 THEN max(o_totalprice) END AS p
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus, o_orderdate
),
c AS (
  SELECT t.fuel, t.day,
    (SELECT arg_max({{'e': eff, 'q': quote}}, eff) FROM dated WHERE dated.fuel = t.fuel AND date_trunc('month', dated.date) = date_trunc('month', t.day)) AS own,
    (SELECT arg_max({{'e': eff, 'q': quote}}, eff) FROM dated WHERE dated.fuel = t.fuel AND eff <= t.day) AS past,
    (SELECT arg_min({{'e': eff, 'q': quote}}, eff) FROM dated WHERE dated.fuel = t.fuel) AS first
  FROM t WHERE t.fuel IN (SELECT fuel FROM proxy)
),
e AS (SELECT *, coalesce(own, past, first) AS a FROM c),
known AS (SELECT * FROM proxy WHERE p IS NOT NULL),
f AS (
  SELECT e.*, p1.p AS p1, p2.p AS p2
  FROM e ASOF LEFT JOIN known p1 ON p1.fuel = e.fuel AND e.day >= p1.d ASOF LEFT JOIN known p2 ON p2.fuel = e.fuel AND e.a.e >= p2.d
),
g AS (SELECT *, CASE WHEN own IS NOT NULL THEN own.q WHEN p2 > 0 THEN a.q * p1 / p2 END AS quote FROM f)
SELECT fuel, day, a.e AS anchor_date, a.q AS anchor_quote, round(quote, 4) AS quote,
  CASE WHEN own IS NOT NULL THEN 'SAME_MONTH' WHEN quote IS NULL THEN 'UNAVAILABLE' WHEN past IS NOT NULL THEN 'ANCHORED' ELSE 'BACKCAST' END AS quote_source
FROM g
UNION ALL
SELECT fuel, day, NULL, NULL, NULL, 'UNAVAILABLE' FROM t WHERE fuel NOT IN (SELECT fuel FROM proxy)
"""


@query("j6_anchored", _ANCHORED)
def anchored(t):
    """Anchors of which some hold before, some after their month, against a proxy with gaps; one fuel has no proxy."""
    fuel, day, k = F.col("o_orderstatus").alias("fuel"), F.to_date("o_orderdate"), F.month("date") % 3
    targets = t.orders.select(fuel, day.alias("day")).distinct()
    known = t.orders.filter("o_orderstatus <> 'P'").groupBy(fuel, day.alias("proxy_date")).agg(F.max("o_totalprice").alias("p"))
    proxy = known.withColumn("proxy", F.when(F.dayofmonth("proxy_date") % 7 > 0, F.col("p")))
    anchors = t.anchors().withColumn("effective_date", F.when(k < 2, F.date_add("date", (k * 40 - 20).cast("int"))))
    return T.anchored(targets, anchors, proxy, ["fuel"], "day").withColumn("quote", F.round("quote", 4))


@query("j7_effective", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= DATE '1997-12-31' THEN 0.10::DOUBLE WHEN o_orderdate::DATE <= DATE '1999-12-31' THEN 0.20::DOUBLE ELSE 0.30::DOUBLE END AS vat FROM orders")
def effective(t):
    rows = [("1900-01-01", "1997-12-31", 0.10), ("1998-01-01", "1999-12-31", 0.20), ("2000-01-01", None, 0.30)]
    tax = t.spark.createDataFrame(rows, "effective_from string, effective_to string, vat double").selectExpr("cast(effective_from AS date) effective_from", "cast(effective_to AS date) effective_to", "vat")
    return T.effective(t.orders.withColumn("day", F.to_date("o_orderdate")), tax, [], "day").select("o_orderkey", "vat")


@query("j13_split", "WITH d AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem), last AS (SELECT d FROM d ORDER BY d DESC LIMIT 90) SELECT CASE WHEN l_shipdate::DATE IN (SELECT d FROM last) THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM lineitem GROUP BY ALL")
def split(t):
    df = t.lineitem.withColumn("d", F.to_date("l_shipdate"))
    last = df.select("d").distinct().orderBy(F.col("d").desc()).limit(90)
    parts = [df.join(last, "d", how).agg(F.lit(name).alias("part"), F.count("*").alias("n")) for how, name in (("left_semi", "test"), ("left_anti", "train"))]
    return parts[0].union(parts[1])


@query("j14_overwrite", "SELECT c.c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'LIVE' ELSE 'HISTORY' END AS source FROM customer c")
def overwrite(t):
    live = t.customer.filter("c_custkey % 5 = 0").select("c_custkey", F.lit(1.0).alias("c_acctbal"))
    return T.overwritten(t.customer.select("c_custkey", "c_acctbal"), live, ["c_custkey"], ["c_acctbal"])


@query("u2_upsert", "SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS bal FROM supplier")
def upsert(t):
    old = t.supplier.selectExpr("s_suppkey k", "s_name name", "s_acctbal bal")
    return T.upsert(old, old.filter("k % 3 = 0").withColumn("bal", F.lit(0.0)), ["k"])


@query("u4_carried", f"WITH {LONG}, a AS (SELECT station_id, fuel, arg_max((updated_at, price, tie), (updated_at, tie)) AS r FROM long_log WHERE updated_at < TIMESTAMP '1998-01-01' GROUP BY ALL) SELECT station_id, fuel, updated_at, price, tie FROM long_log WHERE updated_at >= TIMESTAMP '1998-01-01' UNION ALL SELECT station_id, fuel, r[1], r[2], r[3] FROM a")
def carried(t):
    return T.carried(t.long_log(), ["station_id", "fuel"], "updated_at", "1998-01-01", "tie")


@query("g15_latest", f"WITH {LOG} SELECT station_id, fuel, max(updated_at) AS updated_at, arg_max(price, updated_at) AS price FROM log GROUP BY ALL")
def latest(t):
    return T.latest(t.log(), ["station_id", "fuel"], ["updated_at"])


@query("d28_chained_index", f"""WITH {SNAPS}, d AS (SELECT fuel, date, median(price) AS median, count(DISTINCT station_id) AS n_units, row_number() OVER (PARTITION BY fuel ORDER BY date) AS k FROM snaps GROUP BY fuel, date),
e AS (SELECT *, lag(median) OVER w AS was, lag(n_units) OVER w AS n_was, lag(date) OVER w AS before FROM d WINDOW w AS (PARTITION BY fuel ORDER BY date)),
m AS (SELECT e.fuel, e.date, count(*) AS n, median(a.price / b.price) AS ratio FROM e JOIN snaps a ON a.fuel = e.fuel AND a.date = e.date JOIN snaps b ON b.fuel = e.fuel AND b.date = e.before AND b.station_id = a.station_id WHERE b.price > 0 GROUP BY ALL),
f AS (SELECT e.*, CASE WHEN k > 1 THEN coalesce(n, 0) END AS n_matched, ratio FROM e LEFT JOIN m ON e.fuel = m.fuel AND e.date = m.date),
g AS (SELECT *, n_matched::DOUBLE / greatest(1, least(n_units, n_was)) AS matched_share, CASE WHEN k = 1 THEN 1.0::DOUBLE WHEN n_matched >= 30 THEN ratio WHEN was > 0 THEN median / was ELSE 1.0::DOUBLE END AS growth FROM f)
SELECT fuel, date, median, round(100 * product(growth) OVER (PARTITION BY fuel ORDER BY date), 4) AS index, round(100 * (growth - 1), 6) AS change_pct, n_units, n_matched, matched_share,
CASE WHEN k = 1 THEN 'BASE' WHEN n_matched >= 30 THEN 'MATCHED_STATIONS' ELSE 'MEDIAN_FALLBACK' END AS method, CASE WHEN k = 1 THEN 'HIGH' WHEN n_matched < 30 THEN 'LOW' WHEN matched_share >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM g""")
def chained_index(t):
    df = T.chained_index(T.snapshots(t.log(), ["station_id", "fuel"], "updated_at", "day", 3, last=t.last_day()), "fuel", "station_id", "date", "price")
    return df.withColumns({"change_pct": F.round("change_pct", 6), "index": F.round("index", 4)})


_PAIRS = f"""WITH {STATIONS}, pairs AS MATERIALIZED (SELECT a.fuel, a.id, b.id AS other, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km, b.excess AS v
FROM stations a JOIN stations b ON a.fuel = b.fuel AND a.id <> b.id)"""


@query("j9_competition", _PAIRS + " SELECT fuel, id, round(min(km), 6) AS nearest_km, count_if(km <= 5) AS within_5, count_if(km <= 20) AS within_20, count_if(km <= 50) AS within_50 FROM pairs GROUP BY ALL")
def competition(t):
    return geo.competition(t.stations(), "fuel", (5, 20, 50)).withColumn("nearest_km", F.round("nearest_km", 6))
