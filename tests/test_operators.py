import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fuelgrid.functions import scalars as S
from fuelgrid import storage
from fuelgrid.operators import geo, robust, series
from fuelgrid.streaming import prices


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fair_price_and_margin_are_inverse(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    fair = one(spark, S.fair_price(*lit(0.5, 0.1, 0.6, 0.2)))
    assert fair == pytest.approx(1.44)
    assert one(spark, S.implied_margin(*lit(fair, 0.5, 0.6, 0.2))) == pytest.approx(0.1)


def test_exchange_rate_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, S.usd_per_barrel_to_eur_per_litre(F.lit(70.0), F.lit(0.0)))


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (None,)], "z double")
    assert [r[0] for r in df.select(S.binned(F.col("z"), [2, 3], ["N", "H", "V"])).collect()] == ["N", "H", None]


def test_wall_times_that_a_zone_skips_or_repeats_are_null(spark):
    df = spark.createDataFrame([("2026-03-29 02:30:00",), ("2026-10-25 02:30:00",), ("2026-07-01 12:00:00",)], "t string")
    out = [r[0] for r in df.select(S.wall_time_to_utc(F.col("t").cast("timestamp"))).collect()]
    assert out[:2] == [None, None] and out[2].hour in (10, 12)


def test_text_key_ignores_accents_case_and_spacing(spark):
    assert one(spark, S.text_key(F.lit("  L’Île   d'YEU "))) == "l'ile d'yeu"


def test_score_is_zero_without_a_scale_and_floored_with_one(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("a", 7.0), ("a", None)], "k string, x double")
    assert {r.z for r in robust.robust_z(df, "x", ["k"]).collect()} == {0.0}
    assert max(r.z or 0 for r in robust.robust_z(df, "x", ["k"], floor=2.0).collect()) == 3.0


def test_trim_keeps_all_where_it_would_leave_none(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("b", 1.0)], "k string, z double")
    assert sorted(r.k for r in robust.trimmed(df, "z", 3, ["k"]).collect()) == ["a", "b"]


def test_asof_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([("g", dt.date(2026, 1, d)) for d in (14, 15, 16)], "k string, d date")
    right = spark.createDataFrame([("g", dt.date(2026, 1, 1), 5.0)], "k string, r date, v double")
    got = {r.d.day: r.v for r in series.asof(left, right, ["k"], "d", "r", 14).collect()}
    assert got == {14: 5.0, 15: 5.0, 16: None}


def test_effective_dates_need_exactly_one_row(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1),)], "d date")
    two = spark.createDataFrame([(dt.date(2020, 1, 1), None, 1), (dt.date(2021, 1, 1), None, 2)], "effective_from date, effective_to date, v int")
    with pytest.raises(Exception, match="exactly one"):
        series.effective(df, two, [], "d").collect()


def _index(spark, least, prices):
    rows = [("g", dt.date(2026, 1, d), u, p) for d, day in enumerate(prices, 1) for u, p in day.items()]
    df = spark.createDataFrame(rows, "f string, d date, u string, p double")
    return series.chained_index(df, "f", "u", "d", "p", least=least).orderBy("d").collect()


def test_index_follows_the_matched_stations_and_not_entrants(spark):
    first, last = _index(spark, 2, [{"a": 1.0, "b": 2.0}, {"a": 1.1, "b": 2.2, "new": 9.0}])
    assert (first["index"], first.method, first.confidence, first.change_pct, first.n_matched) == (100, "BASE", "HIGH", 0, None)
    assert last["index"] == pytest.approx(110) and last.n_matched == 2 and last.matched_share == 1
    assert (last.method, last.confidence, last.n_units) == ("MATCHED_STATIONS", "HIGH", 3)


def test_index_takes_the_median_of_ratios_and_not_the_ratio_of_medians(spark):
    was = {f"s{k}": 1.0 + k for k in range(40)}
    now = {u: p * (2 if k < 15 else 1) for k, (u, p) in enumerate(was.items())}
    assert _index(spark, 30, [was, now])[-1]["index"] == pytest.approx(100)


def test_index_with_few_matches_falls_back_on_the_medians_of_all(spark):
    last = _index(spark, 30, [{"a": 1.0, "b": 2.0}, {"a": 1.1, "b": 2.2, "new": 9.0}])[-1]
    assert last["index"] == pytest.approx(100 * 2.2 / 1.5) and (last.method, last.confidence) == ("MEDIAN_FALLBACK", "LOW")
    wide = _index(spark, 2, [{"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, {"a": 1.0, "b": 1.0, "x": 1.0, "y": 1.0}])[-1]
    assert wide.matched_share == 0.5 and wide.confidence == "MEDIUM"


def test_neighbours_are_found_over_the_date_line_and_near_the_poles(spark):
    pts = [("f", 1, 10.0, 179.9), ("f", 2, 10.0, -179.9), ("f", 3, 89.9, 0.0), ("f", 4, 89.9, 180.0), ("f", 5, 70.0, 20.0), ("f", 6, 70.0, 20.5), ("f", 7, -90.0, 33.0)]
    got = {r.id: r for r in geo.competition(spark.createDataFrame(pts, "fuel string, id long, lat double, lon double"), "fuel").collect()}
    assert got[1].within_50 == got[2].within_50 == got[3].within_50 == got[4].within_50 == got[5].within_20 == 1
    assert got[7].nearest_km > 8000 and got[7].within_50 == 0


def test_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    pts = [("f", k, max(-90.0, min(90.0, rng.gauss(80, 12))), rng.uniform(-180, 180)) for k in range(300)]
    df = spark.createDataFrame(pts, "fuel string, id long, lat double, lon double")
    for radius in (50.0, 900.0, 12000.0):
        got = {(r.id, r.other) for r in geo.pairs(df, df, "fuel", radius).collect()}
        cross = df.alias("a").crossJoin(df.alias("b")).filter("a.id <> b.id")
        km = S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
        assert got == {tuple(r) for r in cross.filter(km <= radius).select("a.id", "b.id").collect()}


def test_others_stats_equal_brute_force(spark):
    import statistics as st

    rows = [("a", float(x)) for x in (3, 1, 1, 9, 4)] + [("b", float(x)) for x in (5, 5, 2, 8)] + [("c", 7.0), ("c", None), ("d", 1.0), ("d", 2.0)]
    got = robust.others_stats(spark.createDataFrame(rows, "k string, x double"), "x", ["k"]).collect()
    for r in got:
        others = [x for k, x in rows if k == r.k and x is not None]
        others.remove(r.x)
        assert r.n_others == len(others)
        if others:
            m = st.median(others)
            assert (r.others_median, r.others_mad) == (m, st.median(abs(x - m) for x in others))
        else:
            assert r.others_median is None


def test_columns_of_the_input_stay_whatever_their_names(spark):
    df = spark.createDataFrame([("a", 1.0, 5, 6, 7), (None, 2.0, 5, 6, 7), (None, 4.0, 5, 6, 7)], "k string, x double, _median int, _mad int, _some int")
    out = robust.trimmed(robust.robust_z(df, "x", ["k"]), "z", 1.0, ["k"])
    assert {(r._median, r._mad, r._some) for r in out.collect()} == {(5, 6, 7)} and out.count() == 3
    left = spark.createDataFrame([("g", dt.date(2026, 1, 3), 1, 2, 3)], "k string, d date, t int, side int, l int")
    right = spark.createDataFrame([("g", dt.date(2026, 1, 1), 9)], "k string, r date, v int")
    assert tuple(series.asof(left, right, ["k"], "d", "r").first()) == ("g", dt.date(2026, 1, 3), 1, 2, 3, dt.date(2026, 1, 1), 9)


def test_nearest_is_found_however_far(spark):
    pts = spark.createDataFrame([("f", 1, 45.0, 1.0), ("f", 2, 50.0, 8.0), ("g", 3, 45.0, 1.0), ("f", 4, None, None)], "fuel string, id long, lat double, lon double")
    got = {r.id: r for r in geo.competition(pts, "fuel").collect()}
    assert got[1].nearest_km == pytest.approx(got[2].nearest_km) and 700 < got[1].nearest_km < 800
    assert got[3].nearest_km is None and got[4].nearest_km is None and got[1].within_50 == 0


def test_stations_at_one_place_count(spark):
    pts = spark.createDataFrame([("f", k, 45.0, 1.0) for k in range(3)], "fuel string, id long, lat double, lon double")
    assert all(r.within_2 == 2 and r.nearest_km == 0 for r in geo.competition(pts, "fuel").collect())


def test_backfit_recovers_planted_effects(spark):
    rows = [("f", f"r{k % 2}", f"d{k % 3}", (4.0 if k % 2 else -4.0) + (k % 3)) for k in range(600)]
    df = spark.createDataFrame(rows, "fuel string, region string, road string, x double")
    got = {(r.factor, r.level): r.effect for r in robust.backfit(df, "x", "fuel", {"region": 1, "road": 1}, 6).collect()}
    assert got["region", "r1"] - got["region", "r0"] == pytest.approx(8, abs=0.3)
    out = robust.predict(df.withColumn("road", F.lit("unseen")), robust.backfit(df, "x", "fuel", {"region": 1, "road": 1}, 1), "fuel", ["region", "road"])
    assert {r.coverage for r in out.collect()} == {0.5}


def test_operators_take_empty_tables(spark):
    df = spark.createDataFrame([], "fuel string, id long, lat double, lon double, x double")
    assert geo.peer_scores(df, "fuel", "x").count() == 0
    assert robust.backfit(df, "x", "fuel", {"id": 1}, 2).count() == 0
    assert math.isclose(robust.error_metrics(df, "x", "lat", ["fuel"]).count(), 0)


EVENTS = "station_id long, fuel string, updated_at timestamp, price double"


def _at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def _stream(spark, tmp_path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    return prices.read(spark, f"{tmp_path}/in", EVENTS, files_a_batch=1)


def test_streams_drop_repeats_and_find_sessions(spark, tmp_path):
    log = _stream(spark, tmp_path, [(7, "c", _at(1, 0, m), 1.0) for m in (0, 0, 10)] + [(7, "c", _at(1, 9), 2.0)])
    assert prices.run(prices.unrepeated(log), "append").count() == 3
    assert sorted(r.n for r in prices.run(prices.sessions(log), "complete").collect()) == [1, 3]


def test_a_timer_tells_stations_that_fell_silent(spark, tmp_path):
    batches = [[(1, "c", _at(1), 1.0), (2, "c", _at(1), 2.0)], [(2, "c", _at(6), 3.0)], [(2, "c", _at(12), 4.0)], [(2, "c", _at(13), 5.0)], [(2, "c", _at(14), 5.5)]]
    got = prices.run(prices.stale(_stream(spark, tmp_path, *batches), 7), "append").collect()
    assert [(r.station_id, r.updated_at, r.price) for r in got] == [(1, _at(1), 1.0)]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    got = prices.run(_stream(spark, tmp_path, [(1, "c", _at(1), 1.0)], [(2, "c", _at(2), 1.0)]), "append")
    assert sorted(r.station_id for r in got.collect()) == [1, 2]
    assert all("/batch=" in f for f in got.inputFiles())


def test_tables_of_points_are_not_broadcast(spark):
    pts = storage.written(spark.range(20_000).selectExpr("'E5' fuel", "id", "45D + id % 10 / 10 lat", "5D + id % 7 / 10 lon", "CAST(id % 9 AS DOUBLE) x"))
    for df in (geo.pairs(pts, pts, "fuel", 5), geo.competition(pts, "fuel"), geo.peer_scores(pts.filter("id < 500"), "fuel", "x")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_points_at_one_place_count_each_other(spark):
    rows = [("E5", 1, 45.0, 5.0), ("E5", 2, 45.0, 5.0), ("E5", 3, 45.0, 5.02), ("E5", None, 45.0, 5.0), ("E10", 4, 45.0, 5.0), ("E5", 5, None, 5.0), ("E5", 6, -45.0, 0.0)]
    got = {r.id: (r.nearest_km, r.within_2, r.within_50) for r in geo.competition(spark.createDataFrame(rows, "fuel string, id long, lat double, lon double"), "fuel").collect()}
    assert got[1] == got[2] == (0, 2, 2) and got[3][1:] == (2, 2) and got[3][0] == pytest.approx(1.57, abs=0.01)
    assert got[None] == (None, 0, 0) and got[4] == (None, 0, 0) and got[5] == (None, None, None) and got[6][0] > 9000


def test_quantiles_of_large_windows_are_exact(spark, tmp_path):
    from fuelgrid.plans.adapters import Tables
    from fuelgrid.plans.stream_queries import stream_quantiles

    n = 60_001
    rows = spark.range(n).selectExpr("id event_id", "TIMESTAMP_NTZ '2024-01-01 12:00:00' ts", "id user_id", "'a' event_type", f"CAST(id * 7919 % {n} AS DOUBLE) value", "'' props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (got,) = stream_quantiles(Tables(spark, str(tmp_path))).collect()
    assert (got.n, got.p10, got.p50, got.p90) == (n, 6000, 30000, 54000)
