"""From scored stations to local flags: accessibility, structural and logistics premiums, peers, flags.

Stations have id, fuel, lat, lon and, as the operator needs them, city, region, department, road, price, fair_price and
spread (cents). Each operator treats all fuels in one job. Labels that are null are UNKNOWN. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelgrid.functions import scalars as S
from fuelgrid.operators import geo
from fuelgrid.operators import robust as R
from fuelgrid.storage import counted, written

# Fixed values of the domain: shrinkage of each factor, and the classes whose premium is never a discount.
FACTORS = {"region": 40.0, "department": 25.0, "road": 40.0, "competition_bucket": 40.0, "isolation_bucket": 25.0}
CONSTRAINED = ("FERRY_ISLAND", "ROAD_CONNECTED_ISLAND", "REMOTE_ISOLATED")
STALE = "MARKET_DATA_STALE"


def score(stations: DataFrame, peers: tuple[str, ...] = ("region", "road", "fuel"), freshness: Column | None = None) -> DataFrame:
    """``stations`` (price, fair_price) with spread, anomaly_z among those that agree in ``peers`` (those that the table
    has), flag, market_freshness and actionable. A very stale market flags nothing."""
    state = F.lit("CURRENT") if freshness is None else freshness
    df = stations.withColumn("spread", F.col("price") - F.col("fair_price")).withColumn("spread_cent", 100 * F.col("spread"))
    df = R.robust_z(df, "spread", [p for p in peers if p in stations.columns], "anomaly_z")
    flag = S.binned(F.col("anomaly_z"), [2.0, 3.0], ["NORMAL", "HIGH", "VERY_HIGH"])
    df = df.withColumn("market_freshness", state)
    stale = F.col("market_freshness") == "VERY_STALE"
    return df.withColumns({"flag": F.when(stale, STALE).otherwise(flag), "actionable": ~stale})


def score_history(snapshot: DataFrame, fair: DataFrame, peers: tuple[str, ...] = ("date", "fuel", "road")) -> DataFrame:
    """Station snapshots (date, fuel, price) with the fair price of their date and fuel, where there is one, and their
    score among peers."""
    df = snapshot.withColumn("fuel", F.upper("fuel")).join(fair.select("date", F.upper("fuel").alias("fuel"), "fair_price"), ["date", "fuel"])
    df = df.withColumn("spread", F.col("price") - F.col("fair_price")).withColumn("spread_cent", 100 * F.col("spread"))
    return R.robust_z(df, "spread", [p for p in peers if p in df.columns], "anomaly_z")


def with_features(stations: DataFrame) -> DataFrame:
    """``stations`` with the counts, distances and buckets of their competition on the same fuel."""
    names = ["nearest_km", *[f"within_{r}" for r in (2, 5, 10, 20, 50)]]
    got = geo.competition(stations, "fuel")
    return geo.buckets(R.matched(stations, got, ["fuel", "id"], **{n: n for n in names}))


def accessibility(stations: DataFrame, rules: DataFrame, remote_km: float = 15.0, remote_most: int = 1) -> DataFrame:
    """``stations`` (id, city, nearest_km, within_20) with accessibility_class, logistics_peer_group and
    accessibility_source.

    ``rules`` (match_type ville or id, match_value, accessibility_class, logistics_peer_group, rank) override the default: a
    rule for the city, whatever its accents and case, then one for the id; of several the least rank. What is still
    mainland, far from all and alone is remote.
    """
    pick = lambda df, key: df.groupBy(key.alias("key")).agg(F.min_by(F.struct("accessibility_class", "logistics_peer_group"), "rank").alias("rule"))
    kind = F.lower("match_type")
    by_city = pick(rules.filter(kind == "ville"), S.text_key(F.col("match_value"))).filter("key <> ''")
    by_id = pick(rules.filter(kind == "id"), F.col("match_value").cast("string"))
    df = stations.withColumns({"_city_key": S.text_key(F.col("city").cast("string")), "_id_key": F.col("id").cast("string")})
    df = R.joined(df, by_city.withColumnRenamed("key", "_city_key"), ["_city_key"], _by_city="rule")
    df = R.joined(df, by_id.withColumnRenamed("key", "_id_key"), ["_id_key"], _by_id="rule")
    rule = F.coalesce("_by_id", "_by_city")
    named = F.coalesce(rule["accessibility_class"], F.lit("MAINLAND"))
    remote = F.coalesce((named == "MAINLAND") & (F.col("nearest_km") >= remote_km) & (F.col("within_20") <= remote_most), F.lit(False))
    source = F.when(remote, "ISOLATION_HEURISTIC").when(F.col("_by_id").isNotNull(), "OVERRIDE_ID").when(F.col("_by_city").isNotNull(), "OVERRIDE_VILLE").otherwise("DEFAULT")
    out = df.withColumns({
        "accessibility_class": F.when(remote, "REMOTE_ISOLATED").otherwise(named),
        "logistics_peer_group": F.when(remote, "REMOTE_ISOLATED").otherwise(F.coalesce(rule["logistics_peer_group"], F.lit("MAINLAND"))),
        "accessibility_source": source,
    })
    return out.drop("_city_key", "_id_key", "_by_city", "_by_id")


def structural_premium(scored: DataFrame, factors: dict[str, float] | None = None, rounds: int = 8, trim: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(stations, effects): ``scored`` (spread_cent) with structural_premium, local_fair_price and local_residual.

    The spread above its fuel's national median, without outliers, is explained by additive effects. The premium's
    median is taken off, so the national fair price stays.
    """
    factors = FACTORS if factors is None else factors
    scored, n = counted(scored)
    df = R.group_median(scored, "spread_cent", ["fuel"], "_national", n).withColumn("relative_spread", F.col("spread_cent") - F.col("_national"))
    df = R.robust_z(df, "relative_spread", ["fuel"], "relative_spread_z", at_most=n)
    df = written(df)
    effects = R.backfit(R.trimmed(df, "relative_spread_z", trim, ["fuel"]), "relative_spread", "fuel", factors, rounds)
    df = written(R.predict(df, effects, "fuel", list(factors), "_raw").drop("coverage"))
    df = R.group_median(df, "_raw", ["fuel"], "_centre", n)
    return _priced(df.withColumn("structural_premium", F.col("_raw") - F.col("_centre"))).drop("_national", "_raw", "_centre"), effects


def _priced(df: DataFrame) -> DataFrame:
    df = df.withColumn("local_fair_price", F.col("fair_price") + F.col("structural_premium") / 100)
    return df.withColumn("local_residual", 100 * (F.col("price") - F.col("local_fair_price")))


def logistics_premium(df: DataFrame, shrink: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(stations, effects): each accessibility class's median residual above the mainland's, shrunk, added to the
    structural premium; classes that are harder to reach never get a discount."""
    label, df = "accessibility_class", written(df)
    found = R.group_premium(df, "local_residual", "fuel", label, "MAINLAND", shrink, CONSTRAINED)
    sure = S.unit_confidence(F.col("n"), 30, 10, 3)
    found = found.withColumn("confidence", sure).withColumn("status", F.when(F.col("confidence") == "INSUFFICIENT", "PROVISIONAL").otherwise("ESTIMATED"))
    out = df.withColumnsRenamed({"structural_premium": "base_premium", "local_residual": "base_residual"}).drop("local_fair_price")
    out = R.joined(out, found, ["fuel", label], logistics_premium="premium", logistics_n="n", logistics_confidence="confidence", logistics_status="status")
    return _priced(out.withColumn("structural_premium", F.col("base_premium") + F.col("logistics_premium"))), found


def flag(df: DataFrame) -> DataFrame:
    """``df`` (confidence, score, excess, and market_freshness if known) with local_flag."""
    sure, score_, excess = F.col("confidence"), F.col("score"), F.col("excess")
    over = (score_ > 2) & (excess > 5)
    out = (
        F.when(sure == "INSUFFICIENT", "UNASSESSED_INSUFFICIENT_PEERS")
        .when((sure == "LOW") & over, "REVIEW_LOW_CONFIDENCE")
        .when(sure.isin("HIGH", "MEDIUM") & (score_ > 3) & (excess > 10), "VERY_HIGH")
        .when(sure.isin("HIGH", "MEDIUM") & over, "HIGH")
        .otherwise("NORMAL")
    )
    if "market_freshness" in df.columns:
        out = F.when(F.col("market_freshness") == "VERY_STALE", STALE).otherwise(out)
    return df.withColumn("local_flag", out)


PEER_COLUMNS = ("method", "radius_km", "n_peers", "peer_median", "peer_mad", "scale", "excess", "score", "confidence")


def peer_flags(df: DataFrame, **how) -> DataFrame:
    """``df`` (local_residual) with the scores against its peers and local_flag."""
    df = written(df)
    got = geo.peer_scores(df, "fuel", "local_residual", **how)
    return flag(R.matched(df, got, ["fuel", "id"], **{c: c for c in PEER_COLUMNS}))


def adjust(scored: DataFrame, rules: DataFrame, rounds: int = 8, **peers) -> tuple[DataFrame, DataFrame]:
    """(stations, effects): the whole cross-sectional adjustment. Effects are of both premiums, by name."""
    featured = scored if {"competition_bucket", "isolation_bucket", "nearest_km", "within_20"} <= set(scored.columns) else with_features(scored)
    structural, effects = structural_premium(featured, rounds=rounds)
    moved, classes = logistics_premium(accessibility(structural, rules))
    more = classes.select("fuel", F.lit("accessibility_class").alias("factor"), F.col("accessibility_class").alias("level"), F.col("premium").alias("effect"), F.col("n").alias("n_obs"), "confidence", "status")
    return peer_flags(moved, **peers), effects.unionByName(more, allowMissingColumns=True)


def anomaly_rate(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, assessed, anomalies, very_high, anomaly_pct, very_high_pct) of stations with sure peers."""
    sure = F.col("confidence").isin("HIGH", "MEDIUM")
    out = flagged.groupBy(*keys).agg(
        F.count_if(sure).alias("assessed"),
        F.count_if(sure & F.col("local_flag").isin("HIGH", "VERY_HIGH")).alias("anomalies"),
        F.count_if(sure & (F.col("local_flag") == "VERY_HIGH")).alias("very_high"),
    )
    return out.withColumns({f"{n}_pct": F.try_divide(100.0 * F.col(c), F.col("assessed")) for n, c in (("anomaly", "anomalies"), ("very_high", "very_high"))})


def map_rows(flagged: DataFrame) -> DataFrame:
    """The stations that a map shows: colour, and whether peers, age of the price and excess make it robust."""
    df = flagged.filter(S.on_map(F.col("lat"), F.col("lon")))
    robust = F.coalesce(F.col("confidence").isin("HIGH", "MEDIUM"), F.lit(False)) & F.coalesce(F.col("age_days") <= 30, F.lit(True)) & F.col("excess").isNotNull()
    return df.withColumns({"robust": robust, "colour": S.colour(F.col("excess"))})
