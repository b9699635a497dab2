import datetime as dt

import pytest
from pyspark.sql import functions as F

from fuelgrid.operators import local, market, panel

RULES = "match_type string, match_value string, accessibility_class string, logistics_peer_group string, rank int"


def _island(spark, groups, mainland=20):
    rows = [(f"m{k}", "F", 46.0 + k * 0.001, 2.0, float(k % 3), "MAINLAND", "MAINLAND") for k in range(mainland)]
    rows += [(f"{g}{k}", "F", 46.0 + k * 0.001, 2.001, 30.0 + k, "FERRY_ISLAND", g) for g, n in groups.items() for k in range(n)]
    return spark.createDataFrame(rows, "id string, fuel string, lat double, lon double, local_residual double, accessibility_class string, logistics_peer_group string")


def test_islands_are_never_compared_with_the_mainland(spark):
    got = {r.id: r for r in local.peer_flags(_island(spark, {"a": 3, "b": 3})).collect()}
    assert got["a0"].method == "FERRY_CLASS" and got["a0"].n_peers == 5 and got["a0"].confidence == "LOW"
    assert got["m0"].method == "RADIUS" and got["m0"].n_peers == 25 and got["m0"].confidence == "MEDIUM"
    own = {r.id: r for r in local.peer_flags(_island(spark, {"a": 6, "b": 3})).collect()}
    assert own["a0"].method == "SAME_LOGISTICS_GROUP" and own["a0"].peer_median == 33 and own["b0"].method == "FERRY_CLASS"


def test_few_peers_leave_a_station_unassessed(spark):
    got = local.peer_flags(_island(spark, {"a": 2}, mainland=1)).collect()
    assert {r.local_flag for r in got} == {"UNASSESSED_INSUFFICIENT_PEERS"} and {r.n_peers for r in got} == {0}


def test_the_scale_of_equal_peers_is_the_floor(spark):
    rows = [(k, "F", 45.0, 3.0, 6.0 if k == 0 else 0.0) for k in range(25)] + [(99, "F", None, None, 1.0)]
    got = {r.id: r for r in local.peer_flags(spark.createDataFrame(rows, "id long, fuel string, lat double, lon double, local_residual double")).collect()}
    assert got[0].scale == 2 and got[0].score == 3 and got[0].local_flag == "HIGH" and got[99].method == "NONE"


def test_flags_take_precedence(spark):
    rows = [("HIGH", 3.5, 11.0, "CURRENT"), ("HIGH", 3.5, 9.0, "CURRENT"), ("LOW", 9.0, 99.0, "CURRENT"), ("INSUFFICIENT", None, None, "CURRENT"), ("HIGH", 3.5, 11.0, "VERY_STALE"), ("MEDIUM", 1.0, 50.0, None)]
    got = local.flag(spark.createDataFrame(rows, "confidence string, score double, excess double, market_freshness string")).collect()
    assert [r.local_flag for r in got] == ["VERY_HIGH", "HIGH", "REVIEW_LOW_CONFIDENCE", "UNASSESSED_INSUFFICIENT_PEERS", "MARKET_DATA_STALE", "NORMAL"]


def test_rules_beat_the_heuristic_whatever_the_accents(spark):
    rules = spark.createDataFrame([("ville", "L’Île-Été", "FERRY_ISLAND", "ETE", 0), ("ville", "l'ile-ete", "MAINLAND", "X", 1), ("id", "7", "ROAD_CONNECTED_ISLAND", "BRIDGE", 2)], RULES)
    rows = [(1, " l'ile-ETE ", 40.0, 0), (7, "l'ile-ete", 1.0, 9), (8, None, 15.0, 1), (9, "elsewhere", None, None)]
    got = {r.id: r for r in local.accessibility(spark.createDataFrame(rows, "id long, city string, nearest_km double, within_20 long"), rules).collect()}
    assert (got[1].logistics_peer_group, got[1].accessibility_source) == ("ETE", "OVERRIDE_VILLE")
    assert (got[7].accessibility_class, got[7].accessibility_source) == ("ROAD_CONNECTED_ISLAND", "OVERRIDE_ID")
    assert (got[8].accessibility_class, got[9].accessibility_class) == ("REMOTE_ISOLATED", "MAINLAND")


def test_logistics_premiums_are_never_discounts_and_do_without_a_mainland(spark):
    rows = [("a", c, x, 0.0, 1.5, 1.5 + x / 100) for c, xs in {"MAINLAND": [0.0] * 5, "FERRY_ISLAND": [-4.0] * 3, "OTHER": [-4.0] * 3}.items() for x in xs] + [("b", "FERRY_ISLAND", 6.0, 0.0, 1.5, 1.56), ("b", "REMOTE_ISOLATED", 2.0, 0.0, 1.5, 1.52)]
    df = spark.createDataFrame(rows, "fuel string, accessibility_class string, local_residual double, structural_premium double, fair_price double, price double").withColumn("local_fair_price", F.col("fair_price"))
    out, effects = local.logistics_premium(df)
    got = {(r.fuel, r.accessibility_class): r.premium for r in effects.collect()}
    assert got["a", "FERRY_ISLAND"] == 0 and got["a", "OTHER"] == pytest.approx(-4 * 3 / 13) and got["a", "MAINLAND"] == 0
    assert got["b", "FERRY_ISLAND"] == pytest.approx(2 / 11) and out.count() == len(rows)


def _panel(spark, months=8, stations=40, odd=None):
    rows = []
    for m in range(months):
        for k in range(stations):
            x = (4.0 if k % 2 else -4.0) + (12.0 if k == odd else 0.0)
            rows.append((f"s{k}", "SP95", dt.date(2025 + m // 12, m % 12 + 1, 28), x, x / 4, f"r{k % 2}", None, "AUTOROUTE" if k % 10 == 0 else "ROUTE", "LOW", "LOCAL", "MAINLAND" if k else "FERRY_ISLAND"))
    names = "station_id string, fuel string, date date, relative double, robust_score double, region string, department string, road string, competition_bucket string, isolation_bucket string, accessibility_class string"
    return spark.createDataFrame(rows, names)


def test_a_model_keeps_diagnostic_factors_out_of_the_price(spark):
    p = _panel(spark)
    m = panel.fit(p, rounds=3)
    roles = {(r.factor, r.role) for r in m.effects.collect()}
    assert ("road", "DIAGNOSTIC_ONLY") in roles and ("region", "ACTIVE") in roles and ("accessibility_class", "DIAGNOSTIC_ONLY") in roles
    by = {(r.factor, r.level): r for r in m.effects.collect()}
    assert by["region", "r1"].effect - by["region", "r0"].effect > 1 and by["department", "UNKNOWN"].n_units == 40
    assert by["accessibility_class", "FERRY_ISLAND"].constraint == "INSUFFICIENT_ZEROED" and by["accessibility_class", "FERRY_ISLAND"].effect == 0
    assert by["road", "ROUTE"].effect == 0 and by["road", "AUTOROUTE"].effect >= 0 and by["road", "ROUTE"].constraint == "SP95_ROUTE_REFERENCE_ZERO"
    meta = m.meta.first()
    assert (meta.n_units, meta.n_months, meta.n_obs) == (40, 8, 320)
    got = panel.predict(p.withColumn("road", F.lit("never seen")), m).first()
    assert got.coverage == 1 and got.premium_confidence == "LOW"


def test_a_lasting_excess_shows_after_a_year(spark):
    bias = {r.station_id: r for r in panel.fit(_panel(spark, 14, 20, odd=3), rounds=2).bias.collect()}
    assert bias["s3"].status in ("ELEVATED", "HIGH") and bias["s3"].months == 14 and bias["s3"].confidence == "MEDIUM" and bias["s1"].status == "NORMAL"
    assert {r.status for r in panel.fit(_panel(spark, 6, 20, odd=3), rounds=2).bias.collect()} == {"PROVISIONAL"}


def test_validation_leaves_later_dates_out_and_steps_through_factors(spark):
    p = _panel(spark, 20)
    got = panel.validate(p, 3, ["region"], rounds=2).first()
    assert got.n_test == 120 and got.mae < got.mae_baseline and got.mae_gain_pct > 10
    steps = {r.step: r for r in panel.ablation(p, ["region", "road"], 3, rounds=2).collect()}
    assert steps[0].mae == steps[0].mae_baseline and steps[2].factors == "region+road" and steps[1].mae < steps[0].mae
    assert {r.split for r in panel.regimes(p, "2026-01-01", factors=["region"], rounds=2).collect()} == {"PRE_SHOCK", "SHOCK_ONSET", "CURRENT_REGIME"}
    assert panel.validate(_panel(spark, 6), 3, ["region"], rounds=1).count() == 0


def test_a_common_shift_leaves_no_trace_in_the_panel(spark):
    rows = [(f"s{k}", "SP95", dt.datetime(2026, m, 20), 1.5 + 0.1 * m + 0.01 * k, f"0{k}000", 46.0 + k, 2.0, "X") for m in (1, 2) for k in range(1, 5)] + [("old", "SP95", dt.datetime(2025, 11, 1), 1.5, "01000", 46.0, 2.0, "X"), ("bad", "SP95", dt.datetime(2026, 1, 20), 9.0, "01000", 46.0, 2.0, "X")]
    log = spark.createDataFrame(rows, "station_id string, fuel string, updated_at timestamp_ntz, price double, cp string, lat double, lon double, city string")
    got = panel.monthly_panel(log, "2026-01-31", "2026-02-28", spark.createDataFrame([], RULES)).collect()
    by = {(r.station_id, r.date.month): r for r in got}
    assert len(got) == 8 and by["s1", 1].relative == pytest.approx(by["s1", 2].relative) == pytest.approx(-1.5)
    assert by["s1", 1].region == "84" and by["s4", 2].within_50 == 0 and by["s1", 1].accessibility_class == "REMOTE_ISOLATED"


def test_a_bridge_moves_the_last_value_by_crude_and_rate(spark):
    now = spark.createDataFrame([("SP95", dt.date(2026, 1, 1), 1.20, dt.date(2025, 12, 15), 1.0, "proxy", "PRODUCT_PROXY")], "fuel string, date date, refined double, anchor_date date, anchor double, selected_filter string, market_mode string")
    days = [(dt.date(2026, 1, d), b, 1.0 if d < 3 else 1.25, dt.date(2026, 1, d), dt.date(2026, 1, d), "T") for d, b in ((1, 60.0), (2, 72.0), (3, 90.0), (9, 1.0))]
    m = spark.createDataFrame(days, "date date, brent_usd_b double, eurusd double, brent_observed date, eurusd_observed date, bridge_source string")
    betas = spark.createDataFrame([("SP95", 1.0)], "fuel string, beta double")
    got = {r.date.day: r for r in market.extended(now, m, betas, "2026-01-03").collect()}
    assert sorted(got) == [1, 2, 3] and got[2].refined == pytest.approx(1.44) and got[3].refined == pytest.approx(1.44)
    snap = market.snapshot(market.extended(now, m, betas, "2026-01-03"), "2026-01-03").first()
    assert snap.market_mode == "BRENT_FX_BRIDGE" and snap.bridge_span == 2 and snap.anchor_age == 19 and snap.market_freshness == "CURRENT"


def test_market_freshness_by_its_limits(spark):
    d = lambda x: F.lit(x).cast("date")
    get = lambda e, p, a: spark.range(1).select(market.freshness(d("2026-02-10"), d(e), d(p), d(a), F.lit("BRENT_FX_BRIDGE"))["market_freshness"]).first()[0]
    assert get("2026-02-09", "2026-02-03", "2026-01-20") == "CURRENT"
    assert get("2026-02-06", "2026-01-27", "2026-01-06") == "STALE"
    assert get("2026-02-09", "2026-02-03", "2026-01-05") == "VERY_STALE"


def test_a_backtest_needs_three_months_before_it_trusts_margins(spark):
    months = [dt.date(2026, m, 1) for m in range(1, 6)]
    quotes = spark.createDataFrame([("sp95", d, 0.4, 0.3 + 0.01 * k) for k, d in enumerate(months)], "fuel string, date date, quote double, margin double")
    national = spark.createDataFrame([("SP95", d, 1.68, 0.7) for d in months], "fuel string, date date, ttc double, htt double")
    base = spark.createDataFrame([("SP95", 0.25)], "fuel string, margin double")
    got = {r.date.month: r for r in market.backtest(quotes, national, baselines=base).collect()}
    assert [round(got[m].normal_margin, 6) for m in range(1, 6)] == [0.25, 0.25, 0.25, 0.31, 0.315]
    assert got[4].excise == pytest.approx(0.7) and got[4].fair == pytest.approx((0.4 + 0.31 + 0.7) * 1.2) and got[4].implied_margin == pytest.approx(0.3)
    summary = market.backtest_summary(market.backtest(quotes, national, baselines=base)).first()
    assert summary.n_months == 5 and summary.max_cent == pytest.approx(100 * (1.68 - (0.4 + 0.25 + 0.7) * 1.2))


def test_an_unknown_anchor_is_refused(spark):
    proxy = spark.createDataFrame([("X", dt.date(2026, 1, 1), 1.0, 1.0, 1.0, 1.0)], "fuel string, date date, proxy double, proxy_ma3 double, proxy_ma5 double, proxy_ma7 double")
    anchors = spark.createDataFrame([("Y", dt.date(2026, 1, 1), 1.0)], "fuel string, date date, quote double")
    with pytest.raises(Exception, match="without an anchor"):
        market.nowcast(proxy, anchors).collect()
