"""Values at ranks of groups of any size, and backfitting in all its forms, against plain counting."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fuelgrid.operators import panel, ranks
from fuelgrid.operators import robust as R


def odd_groups():
    rnd, rows = random.Random(2), []
    for g in range(18):
        kind, n = g % 6, rnd.choice([1, 2, 21, 200, 601])
        for _ in range(n):
            some = {0: rnd.random(), 1: float(rnd.randint(0, 3)), 2: rnd.choice([0.0, 1.0]), 3: 5.0, 4: rnd.choice([-math.inf, math.nan, 1.0, rnd.random()]), 5: rnd.choice([None, rnd.gauss(0, 1e6)])}
            rows.append((None if g == 7 else g, some[kind]))
    return [*rows, (99, None)]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_medians_of_large_groups_equal_those_of_small_ones(spark, monkeypatch):
    df = spark.createDataFrame(odd_groups(), "k0 long, v double").repartition(3)
    want = {r[0]: r[1] for r in df.groupBy("k0").agg(F.percentile("v", 0.5)).collect()}
    monkeypatch.setattr(ranks, "WHOLE", 20)
    got = {r[0]: r[1] for r in ranks.medians(df, ["k0"]).collect()}
    assert len(got) == len(want) and all(same(got[k], want[k]) for k in want)
    every = [v for _, v in odd_groups() if v is not None and not math.isnan(v)]
    clean = df.filter("v IS NOT NULL AND NOT isnan(v)").select("v")
    assert ranks.medians(clean, []).first()[0] == statistics.median(every)


def test_a_tie_that_fills_a_group_holds_nothing_back(spark, monkeypatch):
    monkeypatch.setattr(ranks, "WHOLE", 50)
    df = spark.range(4000).select(F.lit(1).alias("k0"), F.when(F.col("id") < 3000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert ranks.medians(df, ["k0"]).first().median == 7
    assert ranks.medians(df.limit(0), ["k0"]).count() == 0


def test_others_medians_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(g, k, float(rnd.randint(0, 9))) for g in ("a", None) for k in range(61)] + [("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    for whole in (ranks.WHOLE, 10):
        monkeypatch.setattr(ranks, "WHOLE", whole)
        for r in R.others_stats(df, "x", ["g"]).collect():
            others = [x for g, k, x in rows if g == r.g and k != r.k and x is not None]
            m = statistics.median(others) if others else None
            assert (r.n_others, r.others_median) == (len(others), m)
            assert r.others_mad == (statistics.median([abs(x - m) for x in others]) if others else None)


def slow_backfit(rows, factors, rounds):
    """{(factor, level): effect} of one group's (levels by factor, unit, value), by units' medians."""
    found = {}
    for _ in range(rounds):
        for f, shrink in factors.items():
            left = {}
            for levels, unit, v in rows:
                rest = v - sum(found.get((g, levels[g]), 0.0) for g in factors if g != f)
                left.setdefault(levels[f], {}).setdefault(unit, []).append(rest)
            found |= {(f, level): statistics.median([statistics.median(x) for x in units.values()]) * len(units) / (len(units) + shrink) for level, units in left.items()}
    return found


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(8)
    rows = [(fuel, u, f"r{u % 4}" if u % 9 else None, f"d{u % 6}", round(rnd.gauss(u % 4, 2), 1)) for fuel in ("x", "y") for u in range(50) for _ in range(3)]
    return rows, spark.createDataFrame(rows, "fuel string, station string, region string, road string, v double")


@pytest.mark.parametrize("levels, whole", [(20_000, 1 << 18), (3, 1 << 18), (20_000, 10)])
def test_backfit_equals_plain_loops(sample, monkeypatch, levels, whole):
    rows, df = sample
    monkeypatch.setattr(R, "LEVELS_ON_DRIVER", levels)
    monkeypatch.setattr(ranks, "WHOLE", whole)
    factors = {"region": 4.0, "road": 2.0}
    got = {(r.fuel, r.factor, r.level): r.effect for r in R.backfit(df, "v", "fuel", factors, 3, "station").collect()}
    for fuel in ("x", "y"):
        own = [({"region": r or "UNKNOWN", "road": d}, u, v) for f, u, r, d, v in rows if f == fuel]
        want = slow_backfit(own, factors, 3)
        assert {k[1:] for k in got if k[0] == fuel} == set(want)
        assert all(got[fuel, *k] == pytest.approx(e) for k, e in want.items())


def test_groups_may_differ_in_their_factors(sample):
    rows, df = sample
    factors = {"region": 4.0, "road": 2.0}
    both = R.backfit(df, "v", "fuel", factors, 2, active={"road": F.col("fuel") == "x"}).collect()
    alone = R.backfit(df.filter("fuel = 'y'"), "v", "fuel", {"region": 4.0}, 2).collect()
    pick = lambda found: {(r.factor, r.level): (r.effect, r.n_obs) for r in found if r.fuel == "y"}
    assert pick(both) == pick(alone) and {r.factor for r in both if r.fuel == "x"} == {"region", "road"}
    assert R.backfit(df.limit(0), "v", "fuel", factors, 2).count() == 0 and R.backfit(df, "v", "fuel", {}, 2).count() == 0


def test_folds_fitted_together_equal_fits_of_their_own(spark):
    from tests.test_models import _panel

    p = _panel(spark, 10)
    folds = p.filter("date < '2025-06-01'").withColumn("fold", F.lit("early")).union(p.withColumn("fold", F.lit("all")))
    together = panel.fit(folds, rounds=2, fold="fold")
    for fold, rows in (("early", p.filter("date < '2025-06-01'")), ("all", p)):
        alone = panel.fit(rows, rounds=2)
        cols = ["fuel", "factor", "level", "effect", "n_obs", "n_units", "role", "constraint"]
        key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
        assert key(together.effects.filter(F.col("fold") == fold)) == key(alone.effects)
        assert together.meta.filter(F.col("fold") == fold).first().centre == alone.meta.first().centre
        assert sorted(together.bias.filter(F.col("fold") == fold).select("station_id", "bias").collect()) == sorted(alone.bias.select("station_id", "bias").collect())


def test_a_factor_that_a_table_lacks_is_unknown(spark):
    from tests.test_models import _panel

    p = _panel(spark)
    m = panel.fit(p, ["region", "road"], rounds=1)
    got = panel.predict(p.drop("road"), m).first()
    assert got.coverage == 0.5 and got.premium_confidence == "INSUFFICIENT"


def test_rows_of_large_groups_are_never_broadcast(spark, monkeypatch):
    """Equal values make a file that Spark takes for the smaller side, whatever its rows."""
    from fuelgrid.storage import written

    monkeypatch.setattr(ranks, "WHOLE", 100)
    rows = written(spark.range(5000).select((F.col("id") % 2).alias("k"), F.lit(0.0).alias("v")))
    state = rows.groupBy("k").agg(F.count("*").alias("n")).join(rows.groupBy("k").agg(F.max("v").alias("q")), "k")
    plan = ranks._met(rows, state, ["k"], "inner", "n")._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {(r.k, r.median) for r in ranks.medians(rows, ["k"]).collect()} == {(0, 0.0), (1, 0.0)}


def test_trimming_deals_no_rows_by_group(spark):
    """There are a few fuels only, so rows dealt by fuel would be a few tasks' whatever their number."""
    from fuelgrid.storage import written

    df = written(spark.range(20000).select((F.col("id") % 5).alias("fuel"), F.rand(1).alias("score")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        plan = R.trimmed(df, "score", 0.5, ["fuel"])._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_in_several_folds_are_fitted_as_if_repeated(spark):
    from tests.test_models import _panel

    p = _panel(spark, 6, 12)
    folds = F.when(F.col("date") < "2025-04-01", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    sets = {0: ("region",), 1: ("region", "road")}
    spread = panel.fit(p, sets, 2, with_bias=False, fold="fold", folds=folds)
    repeated = panel.fit(p.withColumn("fold", F.explode(folds)), sets, 2, with_bias=False, fold="fold")
    key = lambda df: sorted(tuple(r) for r in df.select("fold", *[c for c in df.columns if c != "fold"]).collect())
    assert key(spread.effects) == key(repeated.effects) and key(spread.meta) == key(repeated.meta)
