"""Market series over the test tables: proxies, bridges, nowcasts, filters, backtests, the combined index."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.operators import market as M
from fuelgrid.operators import series as T

from .adapters import ANCHORS, MONTHLY, SNAPS
from .registry import query

FUEL = "o_orderstatus AS fuel"
DAY = "to_date(o_orderdate) AS date"
TARGET = "2002-06-30"


def spot(t):
    """A product's quote on the days that have orders of its status: dollars a gallon."""
    return t.orders.groupBy(F.expr(FUEL), F.expr(DAY)).agg((F.max("o_totalprice") / 1e5).alias("spot_usd_gal"))


def fx(t):
    return t.orders.groupBy(F.expr(DAY)).agg((1 + F.avg("o_totalprice") / 1e6).alias("eurusd"))


def brent(t):
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.max("l_extendedprice") / 1000).alias("brent_usd_b"))


def anchors(t):
    return t.monthly().withColumn("quote", F.col("quote") / 1e6)


def rounded(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


_SPOT = "spot AS (SELECT o_orderstatus AS fuel, o_orderdate::DATE AS date, max(o_totalprice) / 100000 AS spot_usd_gal FROM orders GROUP BY ALL)"
_FX = "fx AS (SELECT o_orderdate::DATE AS date, 1 + avg(o_totalprice) / 1000000 AS eurusd FROM orders GROUP BY ALL)"
_BRENT = "brent AS (SELECT l_shipdate::DATE AS date, max(l_extendedprice) / 1000 AS brent_usd_b FROM lineitem GROUP BY ALL)"
_PROXY = f"""{_SPOT}, {_FX}, b AS (SELECT fuel, greatest(min(date), (SELECT min(date) FROM fx)) AS a, greatest(max(date), (SELECT max(date) FROM fx)) AS z FROM spot GROUP BY fuel),
cal AS (SELECT fuel, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date FROM b), c1 AS (SELECT cal.fuel, cal.date, spot_usd_gal, eurusd FROM cal LEFT JOIN spot USING (fuel, date) LEFT JOIN fx ON cal.date = fx.date),
c2 AS (SELECT fuel, date, last_value(spot_usd_gal IGNORE NULLS) OVER w AS spot_usd_gal, last_value(eurusd IGNORE NULLS) OVER w AS eurusd, last_value(CASE WHEN spot_usd_gal IS NOT NULL THEN date END IGNORE NULLS) OVER w AS spot_observed, last_value(CASE WHEN eurusd IS NOT NULL THEN date END IGNORE NULLS) OVER w AS eurusd_observed FROM c1 WINDOW w AS (PARTITION BY fuel ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c3 AS (SELECT *, spot_usd_gal / eurusd / 3.785411784::DOUBLE AS proxy FROM c2 WHERE spot_usd_gal IS NOT NULL AND eurusd IS NOT NULL),
proxy AS (SELECT *, {", ".join(f"avg(proxy) OVER (PARTITION BY fuel ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS proxy_ma{n}" for n in (3, 5, 7))} FROM c3)"""
_BRIDGE = f"""{_BRENT}, bcal AS (SELECT unnest(generate_series(least((SELECT min(date) FROM brent), (SELECT min(date) FROM fx)), DATE '{TARGET}', INTERVAL 1 DAY))::DATE AS date), b1 AS (SELECT bcal.date, brent_usd_b, eurusd FROM bcal LEFT JOIN brent USING (date) LEFT JOIN fx USING (date)),
b2 AS (SELECT date, last_value(brent_usd_b IGNORE NULLS) OVER w AS brent_usd_b, last_value(eurusd IGNORE NULLS) OVER w AS eurusd, last_value(CASE WHEN brent_usd_b IS NOT NULL THEN date END IGNORE NULLS) OVER w AS brent_observed, last_value(CASE WHEN eurusd IS NOT NULL THEN date END IGNORE NULLS) OVER w AS eurusd_observed FROM b1 WINDOW w AS (ORDER BY date)),
bridge AS (SELECT *, 'TEST' AS bridge_source FROM b2 WHERE brent_usd_b IS NOT NULL AND eurusd IS NOT NULL)"""
_BETAS = """r0 AS (SELECT fuel, spot.date, ln(spot_usd_gal) - lag(ln(spot_usd_gal)) OVER w AS y, ln(brent_usd_b) - lag(ln(brent_usd_b)) OVER w AS x FROM spot JOIN brent USING (date) WINDOW w AS (PARTITION BY fuel ORDER BY spot.date)),
betas AS (SELECT fuel, CASE WHEN count_if(ok) < 200 THEN 1.0::DOUBLE ELSE least(2.0, greatest(0.2, coalesce(sum(CASE WHEN ok THEN x * y END) / sum(CASE WHEN ok THEN x * x END), 1.0))) END AS beta, count_if(ok) AS n FROM (SELECT *, coalesce(abs(x) < 0.2 AND abs(y) < 0.2, false) AS ok FROM r0) GROUP BY fuel)"""
_FILTERS = """weekly AS (SELECT l_linestatus AS fuel, date_trunc('week', l_shipdate)::DATE AS date, avg(l_extendedprice) / 30000 AS htt FROM lineitem GROUP BY ALL), a0 AS (SELECT w.fuel, w.date, htt, proxy, proxy_ma3, proxy_ma5, proxy_ma7 FROM weekly w ASOF LEFT JOIN proxy p ON w.fuel = p.fuel AND w.date >= p.date),
a1 AS (SELECT *, row_number() OVER (PARTITION BY fuel ORDER BY date) AS k, count(*) OVER (PARTITION BY fuel) AS n FROM a0), a2 AS (SELECT *, k <= least(n - 1, greatest(52, floor(n * 0.75))) AS train FROM a1), a3 AS (UNPIVOT a2 ON proxy, proxy_ma3, proxy_ma5, proxy_ma7 INTO NAME candidate VALUE x),
a4 AS (SELECT fuel, candidate, regr_intercept(htt, x) AS alpha, regr_slope(htt, x) AS beta, count(*) AS n_train FROM a3 WHERE train AND htt IS NOT NULL AND x IS NOT NULL GROUP BY ALL HAVING count(*) >= 52),
scores AS (SELECT fuel, candidate, any_value(alpha) AS alpha, any_value(beta) AS beta, sqrt(avg((htt - alpha - beta * x) ** 2)) AS rmse, avg(abs(htt - alpha - beta * x)) AS mae, any_value(n_train) AS n_train, count(*) AS n_test FROM a3 JOIN a4 USING (fuel, candidate) WHERE NOT train AND htt IS NOT NULL GROUP BY ALL)"""
_ANCHORS = f"{MONTHLY}, anchors AS (SELECT fuel, date, quote / 1000000 AS quote FROM monthly)"
_NOW = f"""{_ANCHORS}, la AS (SELECT fuel, max(date) AS anchor_date, arg_max(quote, date) AS anchor FROM anchors GROUP BY fuel), lb AS (SELECT p.fuel, arg_max(proxy_ma5, date) AS base FROM proxy p JOIN la ON p.fuel = la.fuel AND p.date <= anchor_date GROUP BY ALL),
now AS (SELECT p.*, anchor_date, anchor, anchor * proxy_ma5 / base AS refined, 'PRODUCT_PROXY' AS market_mode, 'PRODUCT_PROXY' AS bridge_source FROM proxy p JOIN la USING (fuel) JOIN lb USING (fuel))"""
_EXT = f"""{_PROXY}, {_BRIDGE}, {_BETAS}, {_NOW}, last AS (SELECT fuel, max(date) AS proxy_date, arg_max(refined, date) AS r, any_value(anchor_date) AS anchor_date FROM now GROUP BY fuel), base AS (SELECT last.*, brent_usd_b AS brent0, bridge.eurusd AS fx0 FROM last ASOF JOIN bridge ON proxy_date >= bridge.date),
ext AS (SELECT fuel, date, refined, market_mode, anchor_date, bridge_source, NULL::DATE AS brent_observed, spot_observed, eurusd_observed FROM now UNION ALL
 SELECT base.fuel, bridge.date, r * pow(brent_usd_b / brent0, beta) * fx0 / bridge.eurusd, 'BRENT_FX_BRIDGE', anchor_date, bridge.bridge_source, brent_observed, NULL, bridge.eurusd_observed FROM base JOIN betas USING (fuel) JOIN bridge ON bridge.date > proxy_date AND bridge.date <= DATE '{TARGET}')"""


@query("d20_product_proxy", f"WITH {_PROXY} SELECT fuel, date, spot_observed, eurusd_observed, round(proxy, 9) AS proxy, round(proxy_ma3, 9) AS proxy_ma3, round(proxy_ma5, 9) AS proxy_ma5, round(proxy_ma7, 9) AS proxy_ma7 FROM proxy")
def product_proxy(t):
    return rounded(M.product_proxy(spot(t), fx(t)).drop("spot_usd_gal", "eurusd"), 9)


@query("d21_bridge_series", f"WITH {_FX}, {_BRIDGE} SELECT date, round(brent_usd_b, 9) AS brent_usd_b, round(eurusd, 9) AS eurusd, brent_observed, eurusd_observed, bridge_source FROM bridge")
def bridge_series(t):
    return rounded(M.bridge(brent(t), fx(t), TARGET, "TEST"), 9)


@query("g11_origin_beta", f"WITH {_SPOT}, {_BRENT}, {_BETAS} SELECT fuel, round(beta, 6) AS beta, n FROM betas")
def origin_beta(t):
    return rounded(M.bridge_betas(spot(t), brent(t)))


@query("d22_nowcast", f"WITH {_PROXY}, {_NOW} SELECT fuel, date, anchor_date, round(refined, 9) AS refined, market_mode FROM now")
def nowcast(t):
    return rounded(M.nowcast(M.product_proxy(spot(t), fx(t)), anchors(t)).select("fuel", "date", "anchor_date", "refined", "market_mode"), 9)


def _extended(t):
    now = M.nowcast(M.product_proxy(spot(t), fx(t)), anchors(t))
    return M.extended(now, M.bridge(brent(t), fx(t), TARGET, "TEST"), M.bridge_betas(spot(t), brent(t)), TARGET)


@query("d23_bridge", f"WITH {_EXT} SELECT fuel, date, round(refined, 8) AS refined, market_mode, anchor_date FROM ext")
def bridge(t):
    return rounded(_extended(t).select("fuel", "date", "refined", "market_mode", "anchor_date"), 8)


_LAG = "len(list_filter(generate_series(e, DATE '{0}' - 1, INTERVAL 1 DAY), lambda x: isodow(x) <= 5))".format(TARGET)


@query("d24_market_snapshot", f"""WITH {_EXT}, l AS (SELECT fuel, max(date) AS date FROM ext GROUP BY fuel), p AS (SELECT fuel, max(date) AS proxy_date FROM ext WHERE market_mode = 'PRODUCT_PROXY' GROUP BY fuel),
s AS (SELECT ext.*, proxy_date, CASE WHEN market_mode = 'BRENT_FX_BRIDGE' THEN least(brent_observed, eurusd_observed) ELSE least(spot_observed, eurusd_observed) END AS e FROM ext JOIN l USING (fuel, date) JOIN p USING (fuel)),
a AS (SELECT *, greatest(0, DATE '{TARGET}' - e) AS market_age, {_LAG}::BIGINT AS business_lag, greatest(0, DATE '{TARGET}' - proxy_date) AS proxy_age, greatest(0, DATE '{TARGET}' - anchor_date) AS anchor_age, CASE WHEN market_mode = 'BRENT_FX_BRIDGE' THEN greatest(0, DATE '{TARGET}' - proxy_date) ELSE 0 END AS bridge_span FROM s)
SELECT fuel, date, round(refined, 8) AS refined, market_mode, e AS effective_date, proxy_date, anchor_date, market_age::BIGINT AS market_age, business_lag, proxy_age::BIGINT AS proxy_age, anchor_age::BIGINT AS anchor_age, bridge_span::BIGINT AS bridge_span,
CASE WHEN business_lag <= 1 AND bridge_span <= 7 AND anchor_age <= 21 THEN 'CURRENT' WHEN business_lag <= 3 AND bridge_span <= 14 AND anchor_age <= 35 THEN 'STALE' ELSE 'VERY_STALE' END AS market_freshness FROM a""")
def market_snapshot(t):
    got = M.snapshot(_extended(t), TARGET)
    return rounded(got.drop("brent_observed", "spot_observed", "eurusd_observed", "bridge_source"), 8)


_CHOSEN = """
best AS (SELECT fuel, arg_min(candidate, (rmse, mae, candidate)) AS filter FROM scores GROUP BY fuel),
named AS (SELECT p.*, coalesce(filter, 'proxy_ma5') AS selected_filter FROM proxy p LEFT JOIN best USING (fuel)),
chosen AS (
  SELECT *, CASE selected_filter WHEN 'proxy' THEN proxy WHEN 'proxy_ma3' THEN proxy_ma3 WHEN 'proxy_ma5' THEN proxy_ma5 ELSE proxy_ma7 END AS chosen
  FROM named
)
"""
#: The market chain as before, through each fuel's best filter.
_EXT_CHOSEN = _EXT.replace("FROM proxy p", "FROM chosen p").replace("proxy_ma5, date", "chosen, date").replace("anchor * proxy_ma5", "anchor * chosen").replace(_BRIDGE, f"{_FILTERS}, {_CHOSEN}, {_BRIDGE}")
_LAST = "l AS (SELECT fuel, max(date) AS date FROM ext GROUP BY fuel)"


def _filters(t):
    return M.best_filters(M.filter_scores(_weekly(t), M.product_proxy(spot(t), fx(t))))


@query("d25_live_market", f"WITH {_EXT}, {_LAST} SELECT fuel, date, round(refined, 8) AS refined, market_mode FROM ext JOIN l USING (fuel, date)")
def live_market(t):
    return rounded(M.live_market(spot(t), brent(t), fx(t), anchors(t), TARGET)[1].select("fuel", "date", "refined", "market_mode"), 8)


@query("d25_live_market_filtered", f"WITH {_EXT_CHOSEN}, {_LAST} SELECT fuel, date, round(refined, 8) AS refined, market_mode, anchor_date FROM ext JOIN l USING (fuel, date)")
def live_market_filtered(t):
    """The live chain through the filter that each fuel's weekly prices chose."""
    got = M.live_market(spot(t), brent(t), fx(t), anchors(t), TARGET, _filters(t))[1]
    return rounded(got.select("fuel", "date", "refined", "market_mode", "anchor_date"), 8)


@query("d31_refined_history", f"""
WITH {_PROXY}, {_FILTERS}, {_CHOSEN}, {ANCHORS},
dated AS (
  SELECT fuel, date, quote / 1000000 AS quote, CASE WHEN month(date) % 3 < 2 THEN date + CAST((month(date) % 3) * 40 - 20 AS INTEGER) ELSE date END AS eff
  FROM anchors
),
t AS (SELECT DISTINCT o_orderstatus AS fuel, o_orderdate::DATE AS date FROM orders),
c AS (
  SELECT t.*,
    (SELECT arg_max({{'e': eff, 'q': quote}}, eff) FROM dated d WHERE d.fuel = t.fuel AND date_trunc('month', d.date) = date_trunc('month', t.date)) AS own,
    (SELECT arg_max({{'e': eff, 'q': quote}}, eff) FROM dated d WHERE d.fuel = t.fuel AND eff <= t.date) AS past,
    (SELECT arg_min({{'e': eff, 'q': quote}}, eff) FROM dated d WHERE d.fuel = t.fuel) AS first
  FROM t
),
e AS (SELECT *, coalesce(own, past, first) AS a FROM c),
f AS (
  SELECT e.*, p1.chosen AS p1, p2.chosen AS p2, coalesce(filter, 'proxy_ma5') AS selected_filter
  FROM e LEFT JOIN best USING (fuel)
  ASOF LEFT JOIN chosen p1 ON p1.fuel = e.fuel AND e.date >= p1.date ASOF LEFT JOIN chosen p2 ON p2.fuel = e.fuel AND e.a.e >= p2.date
),
g AS (SELECT *, CASE WHEN own IS NOT NULL THEN own.q WHEN p2 > 0 THEN a.q * p1 / p2 END AS refined FROM f)
SELECT fuel, date, round(refined, 10) AS refined, a.e AS anchor_date, selected_filter,
  CASE WHEN own IS NOT NULL THEN 'SAME_MONTH' WHEN refined IS NULL THEN 'UNAVAILABLE' WHEN past IS NOT NULL THEN 'ANCHORED' ELSE 'BACKCAST' END AS refined_source
FROM g
""")
def refined_history(t):
    k = F.month("date") % 3
    known = t.anchors().withColumns({"quote": F.col("quote") / 1e6, "effective_date": F.when(k < 2, F.date_add("date", (k * 40 - 20).cast("int")))})
    got = M.refined_history(t.orders.select(F.expr(FUEL), F.expr(DAY)), M.product_proxy(spot(t), fx(t)), known, _filters(t))
    return rounded(got.drop("anchor"), 10)


def _weekly(t):
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    return t.lineitem.groupBy(F.col("l_linestatus").alias("fuel"), week.alias("date")).agg((F.avg("l_extendedprice") / 30000).alias("htt"))


@query("d26_filter_scores", f"WITH {_PROXY}, {_FILTERS} SELECT fuel, candidate, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(rmse, 8) AS rmse, round(mae, 8) AS mae, n_train, n_test FROM scores")
def filter_scores(t):
    got = M.filter_scores(_weekly(t), M.product_proxy(spot(t), fx(t)))
    return got.select("fuel", "candidate", *[F.round(c, k).alias(c) for c, k in (("alpha", 6), ("beta", 6), ("rmse", 8), ("mae", 8))], "n_train", "n_test")


@query("d26_best_filter", f"WITH {_PROXY}, {_FILTERS} SELECT fuel, arg_min(candidate, (rmse, mae, candidate)) AS filter FROM scores GROUP BY fuel")
def best_filter(t):
    return _filters(t)


_BACK = f"""{MONTHLY}, nat AS (SELECT o_orderstatus AS fuel, last_day(o_orderdate::DATE) AS date, median(o_totalprice) * 1.6 AS ttc, median(o_totalprice) * 1.1 AS htt FROM orders GROUP BY ALL), mar AS (SELECT fuel, date, quote, htt - quote AS margin FROM monthly JOIN nat USING (fuel, date)),
nor AS (SELECT *, CASE WHEN count(margin) OVER w >= 3 THEN median(margin) OVER w ELSE CASE fuel WHEN 'F' THEN 100.0::DOUBLE WHEN 'O' THEN 200.0::DOUBLE END END AS normal FROM mar WINDOW w AS (PARTITION BY fuel ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
mac AS (SELECT last_day(o_orderdate::DATE) AS date, avg(o_totalprice) AS brent_usd_bbl, 1.25::DOUBLE AS eurusd FROM orders GROUP BY ALL),
bt AS (SELECT nat.fuel, nat.date, ttc, quote, normal, ttc / 1.2 - htt AS excise, (quote + normal + ttc / 1.2 - htt) * 1.2 AS fair, ttc / 1.2 - (ttc / 1.2 - htt) - quote AS implied, brent_usd_bbl / eurusd / 158.987294928 AS brent_eur_l FROM nat JOIN nor USING (fuel, date) LEFT JOIN mac ON nat.date = mac.date)"""


def _backtest(t):
    national = t.orders.groupBy(F.expr(FUEL), F.last_day(F.to_date("o_orderdate")).alias("date")).agg((F.median("o_totalprice") * 1.6).alias("ttc"), (F.median("o_totalprice") * 1.1).alias("htt"))
    market = t.monthly().join(national, ["fuel", "date"]).select("fuel", "date", "quote", (F.col("htt") - F.col("quote")).alias("margin"))
    macro = t.orders.groupBy(F.last_day(F.to_date("o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("brent_usd_bbl"), F.lit(1.25).alias("eurusd"))
    base = t.spark.createDataFrame([("F", 100.0), ("O", 200.0)], "fuel string, margin double")
    return M.backtest(market, national, macro, base)


@query("d27_monthly_backtest", f"WITH {_BACK} SELECT fuel, date, round(normal, 4) AS normal_margin, round(excise, 4) AS excise, round(fair, 4) AS fair, round(ttc - fair, 4) AS residual, round(implied, 4) AS implied_margin, round(brent_eur_l, 4) AS brent_eur_l, round(quote - brent_eur_l, 4) AS quote_less_brent FROM bt")
def monthly_backtest(t):
    """Each month's observed price against one built of its quote and the margin usual in the months before."""
    return rounded(_backtest(t).select("fuel", "date", "normal_margin", "excise", "fair", "residual", "implied_margin", "brent_eur_l", "quote_less_brent"), 4)


@query("g13_backtest_summary", f"WITH {_BACK}, r AS (SELECT fuel, ttc - fair AS residual FROM bt) SELECT fuel, count(residual) AS n_months, round(100 * avg(abs(residual)), 3) AS mae_cent, round(100 * sqrt(avg(residual * residual)), 3) AS rmse_cent, round(100 * median(residual), 3) AS median_cent, round(100 * max(residual), 3) AS max_cent, round(100 * min(residual), 3) AS min_cent FROM r GROUP BY fuel")
def backtest_summary(t):
    return rounded(M.backtest_summary(_backtest(t)), 3)


_FAIR = f"""{SNAPS}, tg AS (SELECT DISTINCT fuel, date FROM snaps), wk AS (SELECT event_type AS fuel, date_trunc('week', ts)::DATE AS date, avg(value) * 1.8 AS ttc, avg(CASE WHEN event_type <> 'view' THEN value END) AS htt FROM events GROUP BY ALL), q AS (SELECT event_type AS fuel, ts::DATE AS date, max(value) AS quote, CASE WHEN day(ts::DATE) % 3 = 0 THEN 'SAME_MONTH' WHEN day(ts::DATE) % 3 = 1 THEN 'ANCHORED' ELSE 'BACKCAST' END AS quote_source FROM events GROUP BY ALL),
fs0 AS (SELECT tg.fuel, tg.date, wk.date AS eu_date, ttc, htt FROM tg ASOF LEFT JOIN wk ON tg.fuel = wk.fuel AND tg.date >= wk.date), fs1 AS (SELECT fuel, date, CASE WHEN date - eu_date <= 14 THEN ttc / 1.2 - htt END AS e FROM fs0),
fs AS (SELECT fs1.fuel, fs1.date, quote, quote_source, coalesce(e, 0.6::DOUBLE) AS excise, CASE WHEN e IS NULL THEN 'FALLBACK_CONFIG' ELSE 'EU_WEEKLY_TTC_HTT' END AS tax_source, (quote + 0.2 + coalesce(e, 0.6::DOUBLE)) * 1.2 AS fair FROM fs1 LEFT JOIN q ON fs1.fuel = q.fuel AND fs1.date = q.date)"""
_SURE = "CASE WHEN fair IS NULL THEN 'UNAVAILABLE' WHEN quote_source = 'SAME_MONTH' THEN 'HIGH' WHEN quote_source IN ('BACKCAST', 'UNAVAILABLE') THEN 'LOW' ELSE 'MEDIUM' END"


def _snaps(t):
    return T.snapshots(t.log(), ["station_id", "fuel"], "updated_at", "day", 3, last=t.last_day())


def _fair(t):
    fuel, day = F.col("event_type").alias("fuel"), F.to_date("ts").alias("date")
    weekly = t.events.groupBy(fuel, F.to_date(F.date_trunc("week", "ts")).alias("date")).agg((F.avg("value") * 1.8).alias("ttc"), F.avg("value").alias("htt"))
    weekly = weekly.withColumn("htt", F.when(F.col("fuel") != "view", F.col("htt")))
    source = F.when(F.dayofmonth("date") % 3 == 0, "SAME_MONTH").when(F.dayofmonth("date") % 3 == 1, "ANCHORED").otherwise("BACKCAST")
    refined = t.events.groupBy(fuel, day).agg(F.max("value").alias("quote")).withColumn("quote_source", source)
    fuels = t.events.select(fuel).distinct()
    return M.fair_series(_snaps(t), weekly, refined, fuels.withColumn("margin", F.lit(0.2)), fuels.withColumn("excise", F.lit(0.6)))


@query("d32_fair_series", f"WITH {_FAIR} SELECT fuel, date, quote_source, round(excise, 6) AS excise, tax_source, round(fair, 6) AS fair, {_SURE} AS fair_confidence FROM fs")
def fair_series(t):
    return rounded(_fair(t).select("fuel", "date", "quote_source", "excise", "tax_source", "fair", "fair_confidence"))


@query("d33_tension", f"""WITH {_FAIR}, o AS (SELECT fuel, date, median(price) AS median, count(*) AS n FROM snaps GROUP BY ALL), an AS (SELECT fuel, date, 100.0::DOUBLE * n / (n + 1) AS anomaly_pct FROM o),
j AS (SELECT o.fuel, o.date, n, median, anomaly_pct, CASE WHEN o.date = (SELECT max(ts)::DATE FROM events) THEN 60.0::DOUBLE ELSE fair END AS fair, CASE WHEN o.date = (SELECT max(ts)::DATE FROM events) THEN 'LIVE' ELSE quote_source END AS quote_source, CASE WHEN o.date = (SELECT max(ts)::DATE FROM events) THEN 'HIGH' ELSE {_SURE} END AS sure, CASE WHEN o.date = (SELECT max(ts)::DATE FROM events) THEN 50.0::DOUBLE ELSE quote END AS quote FROM o LEFT JOIN fs USING (fuel, date) LEFT JOIN an USING (fuel, date))
SELECT fuel, date, n, anomaly_pct, quote, quote_source, sure AS fair_confidence, round(100 * (median - fair), 4) AS tension_cent, round(100 * fair / first_value(fair IGNORE NULLS) OVER (PARTITION BY fuel ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS fair_index FROM j""")
def tension(t):
    observed = _snaps(t).groupBy("fuel", "date").agg(F.median("price").alias("median"), F.count("*").alias("n"))
    anomaly = observed.select("fuel", "date", (100.0 * F.col("n") / (F.col("n") + 1)).alias("anomaly_pct"))
    live = observed.select("fuel").distinct().select("fuel", F.lit(t.last_day()).cast("date").alias("date"), F.lit(60.0).alias("fair_price"), F.lit(50.0).alias("refined"))
    df = M.combined(observed, _fair(t), anomaly, live.select("fuel", "date", "fair_price"), live.select("fuel", "date", "refined"))
    return df.select("fuel", "date", "n", "anomaly_pct", "quote", "quote_source", "fair_confidence", F.round("tension_cent", 4).alias("tension_cent"), F.round("fair_index", 4).alias("fair_index"))
