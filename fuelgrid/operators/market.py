"""Market series: product proxies, bridges, nowcasts anchored to official quotes, freshness, filters, backtests.

Series have a date and, where there are several, a fuel. Prices are in euros a litre. Rows without a date or a value are
left out by the loaders of ``sources``; here NULL values are carried or skipped as each docstring says. Empty inputs give
empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuelgrid.functions import scalars as S
from fuelgrid.operators import robust as R
from fuelgrid.operators import series

CANDIDATES = ("proxy", "proxy_ma3", "proxy_ma5", "proxy_ma7")


def _calendar(bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each day from first to last of each row of ``bounds`` (keys, first, last)."""
    return bounds.filter("first <= last").select(*keys, F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("date"))


def _two(calendar: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, limit: int | None) -> DataFrame:
    """The calendar with both series' values and the dates they were observed on, carried forward."""
    df = calendar.join(a, [*keys, "date"], "left").join(b, "date", "left")
    for name in (value, "eurusd"):
        df = series.forward_fill(df, keys, "date", name, limit).withColumnRenamed(f"{name}_date", f"{name.split('_')[0]}_observed")
    return df.filter(F.col(value).isNotNull() & F.col("eurusd").isNotNull())


def product_proxy(spot: DataFrame, fx: DataFrame, limit: int = 4) -> DataFrame:
    """(fuel, date, spot_usd_gal, eurusd, spot_observed, eurusd_observed, proxy, proxy_ma3, _ma5, _ma7) for each day from the
    later of the series' first dates to the later of their last ones, carried over ``limit`` days at most."""
    ends = fx.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    bounds = spot.groupBy("fuel").agg(F.min("date").alias("c"), F.max("date").alias("d")).crossJoin(ends)  # one row
    days = _calendar(bounds.select("fuel", F.greatest("a", "c").alias("first"), F.greatest("b", "d").alias("last")), ["fuel"])
    df = _two(days, spot, fx, ["fuel"], "spot_usd_gal", limit)
    df = df.withColumn("proxy", S.usd_per_gallon_to_eur_per_litre(F.col("spot_usd_gal"), F.col("eurusd")))
    return series.rolling_mean(df, ["fuel"], "date", "proxy", (3, 5, 7))


def bridge(brent: DataFrame, fx: DataFrame, end: str, source: str) -> DataFrame:
    """(date, brent_usd_b, eurusd, brent_observed, eurusd_observed, bridge_source) for each day up to ``end``."""
    first = brent.select("date").union(fx.select("date")).agg(F.min("date").alias("first"), F.lit(end).cast("date").alias("last"))
    return _two(_calendar(first, []), brent, fx, [], "brent_usd_b", None).withColumn("bridge_source", F.lit(source))


def bridge_betas(product: DataFrame, brent: DataFrame, least: int = 200, most: float = 0.20, low: float = 0.2, high: float = 2.0) -> DataFrame:
    """(fuel, beta, n): how a product's log returns follow the crude's, through the origin, between successive dates that
    both have. Returns of ``most`` or more don't count; of fewer than ``least`` the beta is 1."""
    both = product.join(brent, "date")
    for c in ("spot_usd_gal", "brent_usd_b"):
        both = series.log_return(both, ["fuel"], "date", c, f"r_{c}")
    y, x = F.col("r_spot_usd_gal"), F.col("r_brent_usd_b")
    ok = (F.abs(y) < most) & (F.abs(x) < most)
    out = both.groupBy("fuel").agg(F.count_if(ok).alias("n"), F.sum(F.when(ok, x * y)).alias("xy"), F.sum(F.when(ok, x * x)).alias("xx"))
    beta = F.when((F.col("n") < least) | (F.col("xx") <= 0), 1.0).otherwise(F.least(F.greatest(F.col("xy") / F.col("xx"), F.lit(low)), F.lit(high)))
    return out.select("fuel", F.when(F.col("n") < least, 1.0).otherwise(F.least(F.greatest(beta, F.lit(low)), F.lit(high))).alias("beta"), "n")


def _chosen_name(filters: DataFrame | None, df: DataFrame, default: str = "proxy_ma5") -> DataFrame:
    df = R.joined(df, filters, ["fuel"], selected_filter="filter") if filters is not None else df.withColumn("selected_filter", F.lit(None).cast("string"))
    return df.withColumn("selected_filter", F.coalesce("selected_filter", F.lit(default)))


def _chosen(filters: DataFrame | None, df: DataFrame, default: str = "proxy_ma5") -> DataFrame:
    """``df`` with selected_filter, and chosen, the value of the fuel's filter."""
    df = _chosen_name(filters, df, default)
    return df.withColumn("chosen", F.coalesce(*[F.when(F.col("selected_filter") == c, F.col(c)) for c in CANDIDATES]))


def nowcast(proxy: DataFrame, anchors: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """``proxy`` with refined, its fuel's last official quote moved by the chosen filter's ratio to its value at the
    quote's date. ``anchors`` has fuel, date (the effective one) and quote. Fails where a fuel has no anchor, or no proxy by then."""
    last = series.latest(anchors.filter(F.col("quote").isNotNull()).select("fuel", "date", "quote"), ["fuel"], ["date"])
    df = R.joined(_chosen(filters, proxy), last, ["fuel"], anchor_date="date", anchor="quote")
    seen = df.filter((F.col("date") <= F.col("anchor_date")) & F.col("chosen").isNotNull())
    at = seen.groupBy("fuel").agg(F.max_by("chosen", "date").alias("base"))
    df = R.joined(df, at, ["fuel"], base="base")
    base = F.when(F.col("base").isNotNull(), F.col("base")).otherwise(F.raise_error(F.lit("a fuel without an anchor, or without a proxy by its date")).cast("double"))
    return df.withColumns({"refined": F.col("anchor") * F.col("chosen") / base, "market_mode": F.lit("PRODUCT_PROXY"), "bridge_source": F.lit("PRODUCT_PROXY")}).drop("chosen", "base")


def refined_history(dates: DataFrame, proxy: DataFrame, anchors: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """(fuel, date, refined, refined_source, anchor_date, anchor, selected_filter) of each distinct fuel and date: the official
    quote of the month, or the product proxy, through the fuel's filter, from the anchor that was effective before. ``anchors``
    are as ``series.anchored`` takes them."""
    targets = dates.select(F.upper("fuel").alias("fuel"), F.to_date("date").alias("date")).distinct()
    up = lambda df: df.withColumn("fuel", F.upper("fuel"))
    chosen = _chosen(filters, up(proxy)).select("fuel", F.col("date").alias("proxy_date"), F.col("chosen").alias("proxy"))
    got = series.anchored(_chosen_name(filters, targets), up(anchors), chosen, ["fuel"], "date")
    return got.select("fuel", "date", F.col("quote").alias("refined"), F.col("quote_source").alias("refined_source"), "anchor_date", F.col("anchor_quote").alias("anchor"), "selected_filter")


def extended(now: DataFrame, market: DataFrame, betas: DataFrame, target: str) -> DataFrame:
    """``now`` up to the target date and, beyond a fuel's last date, its last value moved by the crude's ratio to the power
    of the fuel's beta (1 if unknown) and by the inverse ratio of the exchange rate, for each day of ``market``."""
    day = F.lit(target).cast("date")
    known = now.filter(F.col("date") <= day)
    last = series.latest(known.select("fuel", "date", "refined", "anchor_date", "anchor", "selected_filter"), ["fuel"], ["date"])
    m = market.select("date", "brent_usd_b", "eurusd", "brent_observed", "eurusd_observed", "bridge_source")
    base = series.asof(last.withColumn("_k", F.lit(1)), m.select(F.lit(1).alias("_k"), F.col("date").alias("base_date"), F.col("brent_usd_b").alias("brent0"), F.col("eurusd").alias("fx0")), ["_k"], "date", "base_date").drop("_k")
    base = R.joined(base, betas, ["fuel"], beta="beta").withColumnRenamed("date", "proxy_date")
    days = m.filter(F.col("date") <= day)
    future = base.filter("base_date IS NOT NULL").join(days, F.col("date") > F.col("proxy_date"))  # a row for each fuel against days
    beta = F.coalesce("beta", F.lit(1.0))
    future = future.withColumns({
        "refined": F.col("refined") * F.pow(F.col("brent_usd_b") / F.col("brent0"), beta) * F.col("fx0") / F.col("eurusd"),
        "market_mode": F.lit("BRENT_FX_BRIDGE"), "bridge_beta": beta,
    })
    return known.unionByName(future.drop("proxy_date", "base_date", "brent0", "fx0", "beta"), allowMissingColumns=True)


def freshness(target: Column, effective: Column, proxy: Column, anchor: Column, mode: Column) -> dict[str, Column]:
    """Ages in days, the lag in business days and market_freshness."""
    days = lambda d: F.greatest(F.datediff(target, d), F.lit(0)).cast("long")
    lag, anchor_age = S.business_days(effective, target), days(anchor)
    span = F.when(mode == "BRENT_FX_BRIDGE", days(proxy)).otherwise(F.lit(0).cast("long"))
    within = lambda a, b, c: (lag <= a) & (span <= b) & (anchor_age <= c)
    state = F.when(within(1, 7, 21), "CURRENT").when(within(3, 14, 35), "STALE").otherwise("VERY_STALE")
    return {"market_age": days(effective), "business_lag": lag, "proxy_age": days(proxy), "anchor_age": anchor_age, "bridge_span": span, "market_freshness": state}


def snapshot(now: DataFrame, target: str) -> DataFrame:
    """Each fuel's last row up to the target date, with how fresh what it rests on is."""
    day = F.lit(target).cast("date")
    known = now.filter(F.col("date") <= day)
    cols = ["fuel", "date", "refined", "market_mode", "anchor_date", *[c for c in ("brent_observed", "spot_observed", "eurusd_observed", "bridge_source") if c in now.columns]]
    last = series.latest(known.select(*cols), ["fuel"], ["date"])
    proxies = known.filter("market_mode = 'PRODUCT_PROXY'").groupBy("fuel").agg(F.max("date").alias("d"))
    last = R.joined(last, proxies, ["fuel"], proxy_date="d")
    seen = lambda c: F.coalesce(F.col(c), F.col("date")) if c in cols else F.col("date")
    effective = F.when(F.col("market_mode") == "BRENT_FX_BRIDGE", F.least(seen("brent_observed"), seen("eurusd_observed"))).otherwise(F.least(seen("spot_observed"), seen("eurusd_observed")))
    out = last.withColumn("effective_date", effective)
    return out.withColumns(freshness(day, F.col("effective_date"), F.col("proxy_date"), F.col("anchor_date"), F.col("market_mode")))


def live_market(spot: DataFrame, brent: DataFrame, fx: DataFrame, anchors: DataFrame, target: str, filters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nowcast of every day, snapshot): the whole chain from quotes to one row for each fuel."""
    now = nowcast(product_proxy(spot, fx), anchors, filters)
    days = extended(now, bridge(brent, fx, target, "CRUDE_AND_RATE"), bridge_betas(spot, brent), target)
    return days, snapshot(days, target)


def filter_scores(weekly: DataFrame, proxy: DataFrame, share: float = 0.75, least: int = 52) -> DataFrame:
    """(fuel, candidate, alpha, beta, rmse, mae, n_train, n_test): how well each candidate's last value explains htt
    (fuel, date, htt) by a line fitted to the first ``share`` of the weeks, ``least`` at least, and tested on the rest."""
    joined_ = series.asof(weekly, proxy.select("fuel", F.col("date").alias("proxy_date"), *CANDIDATES), ["fuel"], "date", "proxy_date")
    w = Window.partitionBy("fuel")
    cut = F.least(F.greatest(F.lit(least), F.floor(F.col("n") * share)), F.col("n") - 1)
    df = joined_.withColumns({"k": F.row_number().over(w.orderBy("date")), "n": F.count("*").over(w)}).withColumn("train", F.col("k") <= cut)
    long = df.select("fuel", "htt", "train", F.inline(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("x")) for c in CANDIDATES]))).filter("htt IS NOT NULL AND x IS NOT NULL")
    x, y = F.when(F.col("train"), F.col("x")), F.when(F.col("train"), F.col("htt"))
    lines = long.groupBy("fuel", "candidate").agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.count_if("train").alias("n_train")).filter(F.col("n_train") >= least)
    e = F.col("htt") - F.col("alpha") - F.col("beta") * F.col("x")
    tested = long.filter("NOT train").join(lines, ["fuel", "candidate"])
    return tested.groupBy("fuel", "candidate").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.first("n_train").alias("n_train"), F.count("*").alias("n_test"))


def best_filters(scores: DataFrame) -> DataFrame:
    """(fuel, filter): the candidate with the least rmse, then mae."""
    return scores.groupBy("fuel").agg(F.min_by("candidate", F.struct("rmse", "mae", "candidate")).alias("filter"))


def backtest(market: DataFrame, national: DataFrame, macro: DataFrame | None = None, baselines: DataFrame | None = None, vat: float = 0.20, window: int = 12, least: int = 3) -> DataFrame:
    """Each month's national price (fuel, date, ttc, htt) against one built of the month's quote (fuel, date, quote,
    margin), the median margin of the months before (or the fuel's baseline) and the month's own taxes.

    With ``macro`` (date, brent_usd_bbl, eurusd) also the crude in euros and the quote's distance to it.
    """
    m = market.select(F.upper("fuel").alias("fuel"), "date", "quote", F.col("margin").alias("observed_margin"))
    m = series.lagged_median(m, ["fuel"], "date", "observed_margin", "normal_margin", window, least)
    if baselines is not None:
        m = R.joined(m, baselines, ["fuel"], _base="margin").withColumn("normal_margin", F.coalesce("normal_margin", "_base")).drop("_base")
    df = national.withColumn("fuel", F.upper("fuel")).join(m, ["fuel", "date"])
    excise = F.col("ttc") / (1 + vat) - F.col("htt")
    fair = S.fair_price(F.col("quote"), F.col("normal_margin"), F.col("excise"), F.lit(vat))
    df = df.withColumn("excise", excise).withColumn("fair", fair)
    df = df.withColumns({"residual": F.col("ttc") - F.col("fair"), "implied_margin": S.implied_margin(F.col("ttc"), F.col("quote"), F.col("excise"), F.lit(vat))})
    df = df.withColumn("residual_cent", 100 * F.col("residual"))
    if macro is not None:
        crude = macro.select("date", S.usd_per_barrel_to_eur_per_litre(F.col("brent_usd_bbl"), F.col("eurusd")).alias("brent_eur_l"))
        df = df.join(crude, "date", "left").withColumn("quote_less_brent", F.col("quote") - F.col("brent_eur_l"))
    return df


def backtest_summary(df: DataFrame, keys: Sequence[str] = ("fuel",)) -> DataFrame:
    """(keys, n_months, mae_cent, rmse_cent, median_cent, max_cent, min_cent) of residual, where it isn't NULL."""
    r = F.col("residual")
    return df.groupBy(*keys).agg(
        F.count(r).alias("n_months"), (100 * F.avg(F.abs(r))).alias("mae_cent"), (100 * F.sqrt(F.avg(r * r))).alias("rmse_cent"),
        (100 * F.median(r)).alias("median_cent"), (100 * F.max(r)).alias("max_cent"), (100 * F.min(r)).alias("min_cent"),
    )


def fair_series(targets: DataFrame, weekly: DataFrame, refined: DataFrame, margins: DataFrame, excises: DataFrame | None = None, vat: float = 0.20, tolerance_days: int = 14) -> DataFrame:
    """The fundamental price of each target (fuel, date): the refined quote (quote, quote_source), the fuel's margin and
    the taxes that the last weekly prices (fuel, date, ttc, htt) within the tolerance imply, or the fuel's fallback."""
    weeks = weekly.select("fuel", F.col("date").alias("eu_date"), "ttc", "htt")
    df = series.asof(targets.select("fuel", "date").distinct(), weeks, ["fuel"], "date", "eu_date", tolerance_days)
    df = df.join(refined.select("fuel", "date", "quote", "quote_source"), ["fuel", "date"], "left")
    df = df.withColumn("excise", F.col("ttc") / (1 + vat) - F.col("htt"))
    df = df.withColumn("tax_source", F.when(F.col("excise").isNotNull(), "EU_WEEKLY_TTC_HTT").otherwise("FALLBACK_CONFIG"))
    df = R.joined(df, margins, ["fuel"], margin="margin")
    if excises is not None:
        df = R.joined(df, excises, ["fuel"], _e="excise").withColumn("excise", F.coalesce("excise", "_e")).drop("_e")
    df = df.withColumn("fair", S.fair_price(F.col("quote"), F.col("margin"), F.col("excise"), F.lit(vat)))
    sure = F.when(F.col("fair").isNull(), "UNAVAILABLE").when(F.col("quote_source") == "SAME_MONTH", "HIGH").when(F.col("quote_source").isin("BACKCAST", "UNAVAILABLE"), "LOW").otherwise("MEDIUM")
    return df.withColumn("fair_confidence", sure)


def combined(observed: DataFrame, fair: DataFrame, anomaly: DataFrame, live: DataFrame | None = None, live_market_: DataFrame | None = None) -> DataFrame:
    """``observed`` (fuel, date, median ...) with fair prices and anomaly rates, live values over both, the tension between
    observed and fair in cents, and the fair price as an index of its fuel's first."""
    df = observed.join(fair, ["fuel", "date"], "left").join(anomaly, ["fuel", "date"], "left")
    if live is not None:
        df = df.join(live.select("fuel", "date", F.col("fair_price").alias("_live")), ["fuel", "date"], "left")
        on = F.col("_live").isNotNull()
        df = df.withColumns({"fair": F.coalesce("_live", "fair"), "quote_source": F.when(on, "LIVE").otherwise(F.col("quote_source")), "fair_confidence": F.when(on, "HIGH").otherwise(F.col("fair_confidence"))}).drop("_live")
    if live_market_ is not None:
        df = df.join(live_market_.select("fuel", "date", F.col("refined").alias("_live")), ["fuel", "date"], "left")
        df = df.withColumn("quote", F.coalesce("_live", "quote")).drop("_live")
    df = df.withColumn("tension_cent", 100 * (F.col("median") - F.col("fair")))
    df = series.rebased(df, ["fuel"], "date", "fair", "_index")
    first = F.first("fair", True).over(Window.partitionBy("fuel").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("fair_index", F.when(first > 0, F.col("_index"))).drop("_index")
