"""Local adjustment, the panel model and its validation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.operators import geo
from fuelgrid.operators import local as L
from fuelgrid.operators import panel as P
from fuelgrid.operators import robust as R
from fuelgrid.operators import series as T

from .adapters import LONG, PANEL, SCORED, SNAPS, STATIONS
from .market_queries import rounded
from .registry import query

KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
LEAST, RADII, FERRY = 4, (20, 50, 100), 3


def _features(source: str, out: str, date: str = "") -> str:
    """All pairs of ``source``, its counts and buckets."""
    on, by = (f" AND a.{date} = b.{date}", f", a.{date}") if date else ("", "")
    back = f" AND s.{date} = n.{date}" if date else ""
    counts = ", ".join(f"count_if(km <= {r}) AS within_{r}" for r in (2, 5, 10, 20, 50))
    return f"""{out}_p AS MATERIALIZED (SELECT a.fuel, a.id{by}, {KM} AS km FROM {source} a JOIN {source} b ON a.fuel = b.fuel AND a.id <> b.id{on}), {out}_n AS (SELECT fuel, id{", " + date if date else ""}, min(km) AS nearest_km, {counts} FROM {out}_p GROUP BY ALL),
{out} AS (SELECT s.*, nearest_km, {", ".join(f"coalesce(within_{r}, 0) AS within_{r}" for r in (2, 5, 10, 20, 50))}, CASE WHEN coalesce(within_10, 0) <= 2 THEN 'VERY_LOW' WHEN within_10 <= 5 THEN 'LOW' WHEN within_10 <= 15 THEN 'MEDIUM' ELSE 'HIGH' END AS competition_bucket,
CASE WHEN nearest_km IS NULL THEN NULL WHEN nearest_km <= 1 THEN 'DENSE' WHEN nearest_km <= 3 THEN 'LOCAL' WHEN nearest_km <= 8 THEN 'ISOLATED' ELSE 'VERY_ISOLATED' END AS isolation_bucket, coalesce(nearest_km > 8, false) OR coalesce(within_20, 0) <= 2 AS isolated FROM {source} s LEFT JOIN {out}_n n ON s.fuel = n.fuel AND s.id = n.id{back})"""


def _access(source: str, out: str) -> str:
    ferry = "city IN ('FRANCE', 'PERU') OR id = 17"
    return f"""{out} AS (SELECT *, CASE WHEN c = 'MAINLAND' AND nearest_km >= 15 AND within_20 <= 1 THEN 'REMOTE_ISOLATED' ELSE c END AS accessibility_class, CASE WHEN c = 'MAINLAND' AND nearest_km >= 15 AND within_20 <= 1 THEN 'REMOTE_ISOLATED' ELSE g END AS logistics_peer_group,
CASE WHEN c = 'MAINLAND' AND nearest_km >= 15 AND within_20 <= 1 THEN 'ISOLATION_HEURISTIC' WHEN id IN (17, 18) THEN 'OVERRIDE_ID' WHEN city IN ('FRANCE', 'PERU', 'KENYA') THEN 'OVERRIDE_VILLE' ELSE 'DEFAULT' END AS accessibility_source
FROM (SELECT *, CASE WHEN id = 18 THEN 'MAINLAND' WHEN {ferry} THEN 'FERRY_ISLAND' WHEN city = 'KENYA' THEN 'ROAD_CONNECTED_ISLAND' ELSE 'MAINLAND' END AS c, CASE id WHEN 17 THEN 'ISLE_C' WHEN 18 THEN 'MAINLAND' ELSE CASE city WHEN 'FRANCE' THEN 'ISLE_A' WHEN 'PERU' THEN 'ISLE_B' WHEN 'KENYA' THEN 'BRIDGE' ELSE 'MAINLAND' END END AS g FROM {source}))"""


def _backfit(source: str, value: str, factors: dict, rounds: int, name: str, unit: str | None = None, adjust: dict | None = None) -> str:
    """The steps as a chain of WITH clauses, a table of effects for each; the last are called <name>_<factor>."""
    steps, last = [], {}
    for r in range(rounds):
        for f, shrink in factors.items():
            others = {o: last[o] for o in factors if o != f and o in last}
            rest = value + "".join(f" - coalesce({n}.effect, 0)" for n in others.values())
            joins = "".join(f" LEFT JOIN {n} ON p.fuel = {n}.fuel AND coalesce(p.{o}, 'UNKNOWN') = {n}.level" for o, n in others.items())
            this = f"{name}_{f}" if r == rounds - 1 else f"{name}{r}_{f}"
            inner = f"SELECT p.fuel, coalesce(p.{f}, 'UNKNOWN') AS level, {'p.' + unit + ', ' if unit else ''}{rest} AS v FROM {source} p{joins}"
            mid = f"SELECT fuel, level, {unit}, median(v) AS v, count(v) AS n FROM ({inner}) GROUP BY ALL" if unit else f"SELECT *, 1 AS n FROM ({inner})"
            steps.append(f"{this} AS MATERIALIZED (SELECT fuel, level, {(adjust or {}).get(f, 'effect')} AS effect, n_obs, n_units FROM (SELECT fuel, level, median(v) * count(*) / (count(*) + {float(shrink)}) AS effect, sum(n)::BIGINT AS n_obs, count(*) AS n_units FROM ({mid}) GROUP BY ALL))")
            last[f] = this
    return ", ".join(steps)


def _summed(source: str, factors, name: str, out: str) -> str:
    joins = "".join(f" LEFT JOIN {name}_{f} ON p.fuel = {name}_{f}.fuel AND coalesce(p.{f}, 'UNKNOWN') = {name}_{f}.level" for f in factors)
    total = " + ".join(["0.0::DOUBLE", *[f"coalesce({name}_{f}.effect, 0)" for f in factors]])
    seen = " + ".join(["0", *[f"({name}_{f}.effect IS NOT NULL)::INT" for f in factors]])
    units = ", ".join([f"coalesce({name}_{f}.n_units, 0)" for f in factors])
    return f"{out} AS (SELECT p.*, {total} AS total, ({seen})::DOUBLE / {max(1, len(factors))} AS coverage, {f'least({units})' if factors else '0'} AS least_units FROM {source} p{joins})"


def _peers(source: str, value: str, out: str, date: str = "") -> str:
    on, by, key = (f" AND a.{date} = b.{date}", f", a.{date}", f", {date}") if date else ("", "", "")
    eq = f" AND s.{date} = f.{date}" if date else ""
    radius = "CASE " + " ".join(f"WHEN c{r} >= {LEAST} THEN {r}.0::DOUBLE" for r in RADII) + " END"
    ferry = "a.accessibility_class = 'FERRY_ISLAND'"
    return f"""{out}_v AS (SELECT * FROM {source} WHERE {value} IS NOT NULL), {out}_p AS MATERIALIZED (SELECT a.fuel, a.id{by}, b.id AS other, b.{value} AS v, {KM} AS km FROM {out}_v a JOIN {out}_v b ON a.fuel = b.fuel AND a.id <> b.id{on} WHERE NOT {ferry}),
{out}_c AS (SELECT fuel, id{key}, {", ".join(f"count_if(km <= {r}) AS c{r}" for r in RADII)} FROM {out}_p GROUP BY ALL), {out}_k AS (SELECT p.*, {radius} AS r, row_number() OVER (PARTITION BY p.fuel, p.id{", p." + date if date else ""} ORDER BY km, other) AS k FROM {out}_p p JOIN {out}_c c ON p.fuel = c.fuel AND p.id = c.id{f" AND p.{date} = c.{date}" if date else ""}),
{out}_f AS MATERIALIZED (SELECT a.fuel, a.id{by}, b.{value} AS v, a.logistics_peer_group = b.logistics_peer_group AS same FROM {out}_v a JOIN {out}_v b ON a.fuel = b.fuel AND a.id <> b.id{on} WHERE {ferry} AND b.accessibility_class = 'FERRY_ISLAND'), {out}_g AS (SELECT fuel, id{key}, count_if(same) >= {FERRY} AS own FROM {out}_f GROUP BY ALL),
{out}_a AS (SELECT fuel, id{key}, v, CASE WHEN r IS NULL THEN 'NEAREST_N' ELSE 'RADIUS' END AS method, coalesce(r, max(CASE WHEN k <= {LEAST} THEN km END) OVER (PARTITION BY fuel, id{key})) AS radius_km FROM {out}_k WHERE CASE WHEN r IS NULL THEN k <= {LEAST} ELSE km <= r END
 UNION ALL SELECT f.fuel, f.id{", f." + date if date else ""}, v, CASE WHEN own THEN 'SAME_LOGISTICS_GROUP' ELSE 'FERRY_CLASS' END, NULL FROM {out}_f f JOIN {out}_g g ON f.fuel = g.fuel AND f.id = g.id{f" AND f.{date} = g.{date}" if date else ""} WHERE same OR NOT own),
{out}_s AS (SELECT fuel, id{key}, any_value(method) AS method, max(radius_km) AS radius_km, count(*) AS n, median(v) AS peer_median, mad(v) AS peer_mad FROM {out}_a GROUP BY ALL HAVING count(*) >= CASE WHEN any_value(method) IN ('RADIUS', 'NEAREST_N') THEN {LEAST} ELSE {FERRY} END),
{out} AS (SELECT s.*, coalesce(method, 'NONE') AS method, radius_km, coalesce(n, 0) AS n_peers, peer_median, peer_mad, {value} - peer_median AS excess, ({value} - peer_median) / greatest(1.4826 * peer_mad, 2.0::DOUBLE) AS score,
CASE WHEN method IS NULL THEN 'INSUFFICIENT' WHEN method = 'SAME_LOGISTICS_GROUP' THEN CASE WHEN n >= {LEAST} THEN 'MEDIUM' ELSE 'LOW' END WHEN method = 'RADIUS' AND radius_km <= 20 AND n >= 30 THEN 'HIGH' WHEN method = 'RADIUS' AND radius_km <= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM {source} s LEFT JOIN {out}_s f ON s.fuel = f.fuel AND s.id = f.id{eq})"""


FLAG = "CASE WHEN confidence = 'INSUFFICIENT' THEN 'UNASSESSED_INSUFFICIENT_PEERS' WHEN confidence = 'LOW' AND score > 2 AND excess > 5 THEN 'REVIEW_LOW_CONFIDENCE' WHEN confidence IN ('HIGH', 'MEDIUM') AND score > 3 AND excess > 10 THEN 'VERY_HIGH' WHEN confidence IN ('HIGH', 'MEDIUM') AND score > 2 AND excess > 5 THEN 'HIGH' ELSE 'NORMAL' END"
HOW = {"least": LEAST, "radii": RADII, "ferry_least": FERRY}


@query("d4_station_scores", f"WITH {SCORED}, a AS (SELECT *, price - fair_price AS spread FROM scored), b AS (SELECT *, median(spread) OVER (PARTITION BY region, road, fuel) AS m FROM a), c AS (SELECT *, 1.4826 * median(abs(spread - m)) OVER (PARTITION BY region, road, fuel) AS s FROM b), d AS (SELECT *, CASE WHEN s > 0 THEN (spread - m) / s ELSE 0.0::DOUBLE END AS z FROM c) SELECT id, fuel, round(100 * spread, 6) AS spread_cent, round(z, 6) AS anomaly_z, CASE WHEN id % 5 = 0 THEN 'MARKET_DATA_STALE' WHEN z <= 2 THEN 'NORMAL' WHEN z <= 3 THEN 'HIGH' ELSE 'VERY_HIGH' END AS flag, id % 5 <> 0 AS actionable FROM d")
def station_scores(t):
    got = L.score(t.scored().drop("spread_cent"), freshness=F.when(F.col("id") % 5 == 0, "VERY_STALE").otherwise("CURRENT"))
    return rounded(got.select("id", "fuel", "spread_cent", "anomaly_z", "flag", "actionable"))


@query("d5_history_scores", f"WITH {SNAPS}, f AS (SELECT upper(event_type) AS fuel, ts::DATE AS date, avg(value) AS fair FROM events GROUP BY ALL), a AS (SELECT station_id, upper(s.fuel) AS fuel, s.date, station_id % 3 AS road, price - fair AS spread FROM snaps s JOIN f ON upper(s.fuel) = f.fuel AND s.date = f.date), b AS (SELECT *, median(spread) OVER (PARTITION BY date, fuel, road) AS m FROM a), c AS (SELECT *, 1.4826 * median(abs(spread - m)) OVER (PARTITION BY date, fuel, road) AS s FROM b) SELECT station_id, fuel, date, road, round(100 * spread, 5) AS spread_cent, round(CASE WHEN s > 0 THEN (spread - m) / s ELSE 0.0::DOUBLE END, 5) AS anomaly_z FROM c")
def history_scores(t):
    snaps = T.snapshots(t.log(), ["station_id", "fuel"], "updated_at", "day", 3, last=t.last_day()).select("station_id", "fuel", "date", "price", (F.col("station_id") % 3).alias("road"))
    fair = t.events.groupBy(F.col("event_type").alias("fuel"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("fair_price"))
    return rounded(L.score_history(snaps, fair).select("station_id", "fuel", "date", "road", "spread_cent", "anomaly_z"), 5)


@query("d6_features", f"WITH {SCORED}, {_features('scored', 'ft')} SELECT id, fuel, round(nearest_km, 6) AS nearest_km, within_2, within_5, within_10, within_20, within_50, competition_bucket, isolation_bucket, isolated FROM ft")
def features(t):
    got = L.with_features(t.scored())
    return rounded(got.select("id", "fuel", "nearest_km", *[f"within_{r}" for r in (2, 5, 10, 20, 50)], "competition_bucket", "isolation_bucket", "isolated"))


@query("d7_accessibility", f"WITH {SCORED}, {_features('scored', 'ft')}, {_access('ft', 'ac')} SELECT id, fuel, city, accessibility_class, logistics_peer_group, accessibility_source FROM ac")
def accessibility(t):
    return L.accessibility(L.with_features(t.scored()), t.rules()).select("id", "fuel", "city", "accessibility_class", "logistics_peer_group", "accessibility_source")


ROUNDS = 3
_TRIM = """{0}_r AS (SELECT *, spread_cent - median(spread_cent) OVER (PARTITION BY fuel) AS relative FROM {0}), {0}_m AS (SELECT *, median(relative) OVER (PARTITION BY fuel) AS m FROM {0}_r), {0}_z AS (SELECT *, 1.4826 * median(abs(relative - m)) OVER (PARTITION BY fuel) AS s FROM {0}_m),
{0}_t AS (SELECT * FROM {0}_z WHERE CASE WHEN s > 0 THEN abs((relative - m) / s) ELSE 0.0 END <= 3)"""
_STRUCT = f"{SCORED}, {_features('scored', 'ft')}, {_TRIM.format('ft')}, {_backfit('ft_t', 'relative', L.FACTORS, ROUNDS, 'cs')}, {_summed('ft_r', L.FACTORS, 'cs', 'st0')}, st AS (SELECT *, total - median(total) OVER (PARTITION BY fuel) AS structural, 100 * (price - fair_price - (total - median(total) OVER (PARTITION BY fuel)) / 100) AS base_residual FROM st0)"


def _union(factors, name: str) -> str:
    return " UNION ALL ".join(f"SELECT fuel, '{f}' AS factor, level, round(effect, 7) AS effect, n_obs FROM {name}_{f}" for f in factors)


@query("d8_backfit_cross", f"WITH {_STRUCT} {_union(L.FACTORS, 'cs')}")
def backfit_cross(t):
    effects = L.structural_premium(L.with_features(t.scored()), rounds=ROUNDS)[1]
    return effects.select("fuel", "factor", "level", F.round("effect", 7).alias("effect"), "n_obs")


_PREMIUM = f"""{_STRUCT}, {_access('st', 'ac')}, pm AS (SELECT fuel, accessibility_class AS c, median(base_residual) AS m, count(*) AS n FROM ac GROUP BY ALL), pe AS (SELECT fuel, median(base_residual) AS every FROM ac GROUP BY ALL), pb AS (SELECT pm.*, coalesce(max(CASE WHEN c = 'MAINLAND' THEN m END) OVER (PARTITION BY pm.fuel), every) AS base FROM pm JOIN pe USING (fuel)),
pf AS (SELECT *, CASE WHEN c = 'MAINLAND' THEN 0.0::DOUBLE ELSE greatest((m - base) * n / (n + 10.0), 0.0::DOUBLE) END AS premium FROM pb),
lp AS (SELECT ac.* EXCLUDE (c, g), premium AS logistics_premium, n AS logistics_n, structural + premium AS structural_premium, 100 * (price - fair_price - (structural + premium) / 100) AS local_residual FROM ac JOIN pf ON ac.fuel = pf.fuel AND ac.accessibility_class = pf.c)"""


@query("d9_logistics", f"WITH {_PREMIUM} SELECT fuel, c AS accessibility_class, n, round(premium, 6) AS premium, CASE WHEN n >= 30 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' WHEN n >= 3 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence, CASE WHEN n >= 3 THEN 'ESTIMATED' ELSE 'PROVISIONAL' END AS status FROM pf")
def logistics(t):
    structural, _ = L.structural_premium(L.with_features(t.scored()), rounds=ROUNDS)
    got = L.logistics_premium(L.accessibility(structural, t.rules()))[1]
    return got.select("fuel", "accessibility_class", "n", F.round("premium", 6).alias("premium"), "confidence", "status")


_SX = f"{STATIONS}, sx AS (SELECT * EXCLUDE (excess), excess * 12 AS v, CASE WHEN id % 10 = 0 THEN 'FERRY_ISLAND' ELSE 'MAINLAND' END AS accessibility_class, 'g' || (id % 70) AS logistics_peer_group FROM stations), {_peers('sx', 'v', 'pr')}"


def _islands(t):
    island = F.when(F.col("id") % 10 == 0, "FERRY_ISLAND")
    return t.stations().withColumns({"local_residual": F.col("excess") * 12, "accessibility_class": island, "logistics_peer_group": F.concat(F.lit("g"), (F.col("id") % 70).cast("string"))}).drop("excess")


@query("j10_peers", f"WITH {_SX} SELECT fuel, id, method, round(radius_km, 6) AS radius_km, n_peers, round(peer_median, 6) AS peer_median, round(excess, 6) AS excess, round(score, 4) AS score, confidence FROM pr")
def peers(t):
    got = geo.peer_scores(_islands(t), "fuel", "local_residual", **HOW)
    return got.select("fuel", "id", "method", F.round("radius_km", 6).alias("radius_km"), "n_peers", F.round("peer_median", 6).alias("peer_median"), F.round("excess", 6).alias("excess"), F.round("score", 4).alias("score"), "confidence")


_ADJ = f"{_PREMIUM}, {_peers('lp', 'local_residual', 'pr')}"


@query("d11_adjustment", f"WITH {_ADJ} SELECT fuel, id, accessibility_class, round(structural_premium, 5) AS structural_premium, round(local_residual, 5) AS local_residual, method, n_peers, round(excess, 5) AS excess, round(score, 4) AS score, confidence, {FLAG} AS local_flag FROM pr")
def adjustment(t):
    got, _ = L.adjust(t.scored(), t.rules(), ROUNDS, **HOW)
    return got.select("fuel", "id", "accessibility_class", F.round("structural_premium", 5).alias("structural_premium"), F.round("local_residual", 5).alias("local_residual"), "method", "n_peers", F.round("excess", 5).alias("excess"), F.round("score", 4).alias("score"), "confidence", "local_flag")


@query("d30_live_anomaly_rate", f"WITH {_SX}, fl AS (SELECT *, {FLAG} AS flag, confidence IN ('HIGH', 'MEDIUM') AS sure FROM pr) SELECT fuel, count_if(sure) AS assessed, count_if(sure AND flag IN ('HIGH', 'VERY_HIGH')) AS anomalies, count_if(sure AND flag = 'VERY_HIGH') AS very_high, round(100.0 * count_if(sure AND flag IN ('HIGH', 'VERY_HIGH')) / nullif(count_if(sure), 0), 6)::DOUBLE AS anomaly_pct, round(100.0 * count_if(sure AND flag = 'VERY_HIGH') / nullif(count_if(sure), 0), 6)::DOUBLE AS very_high_pct FROM fl GROUP BY fuel")
def live_anomaly_rate(t):
    return rounded(L.anomaly_rate(L.peer_flags(_islands(t), **HOW), ["fuel"]))


@query("d35_map_rows", f"WITH {_SX} SELECT fuel, id, confidence IN ('HIGH', 'MEDIUM') AND (id % 60 <= 30 OR id % 7 = 0) AND excess IS NOT NULL AS robust, CASE WHEN excess IS NULL THEN '#9e9e9e' WHEN excess <= -5 THEN '#1a9850' WHEN excess <= 0 THEN '#91cf60' WHEN excess <= 5 THEN '#ffffbf' WHEN excess <= 10 THEN '#fdae61' WHEN excess <= 20 THEN '#f46d43' ELSE '#d73027' END AS colour FROM pr WHERE lat BETWEEN 41 AND 52 AND lon BETWEEN -6 AND 10")
def map_rows(t):
    got = L.peer_flags(_islands(t), **HOW).withColumn("age_days", F.when(F.col("id") % 7 > 0, F.col("id") % 60))
    return L.map_rows(got).select("fuel", "id", "robust", "colour")


_LOG12 = """lg AS (SELECT o_custkey AS station_id, o_custkey AS id, o_orderstatus AS fuel, o_orderdate AS updated_at, 0.4::DOUBLE + (o_totalprice % 400) / 100 AS price, o_orderkey AS tie, lpad((o_custkey * 37 % 96000)::VARCHAR, 5, '0') AS cp, 42.0::DOUBLE + (o_custkey * 7919 % 9000)::DOUBLE / 1000.0::DOUBLE AS lat, -4.0::DOUBLE + (o_custkey * 104729 % 12000)::DOUBLE / 1000.0::DOUBLE AS lon, CASE o_custkey % 9 WHEN 0 THEN 'FRANCE' WHEN 1 THEN 'PERU' ELSE 'X' END AS city FROM orders),
ok AS (SELECT * FROM lg WHERE price BETWEEN 0.5 AND 4.0), en AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH))::DATE AS a), ends AS (SELECT last_day(a) AS date FROM en),
sn AS (SELECT unnest(r), date FROM (SELECT station_id AS si, fuel AS fu, date, arg_max(ok, (updated_at, tie)) AS r FROM ok JOIN ends ON updated_at < date + INTERVAL 1 DAY AND updated_at >= date - INTERVAL 40 DAY GROUP BY ALL)),
sy AS (SELECT * FROM sn WHERE (epoch_us((date + INTERVAL 1 DAY)::TIMESTAMP) - 1 - epoch_us(updated_at))::DOUBLE / 86400000000.0 <= 30)"""


@query("d12_panel", f"WITH {_LOG12}, {_features('sy', 'ft', 'date')}, {_access('ft', 'ac')}, pa AS (SELECT *, 100 * (price - median(price) OVER (PARTITION BY date, fuel)) AS relative FROM ac), pb AS (SELECT *, median(relative) OVER (PARTITION BY date, fuel) AS m FROM pa) SELECT station_id, fuel, date, round(relative, 6) AS relative, round((relative - m) / greatest(1.4826 * median(abs(relative - m)) OVER (PARTITION BY date, fuel), 1.0::DOUBLE), 6) AS robust_score, substr(cp, 1, 2) AS department, competition_bucket, isolation_bucket, accessibility_class FROM pb")
def panel(t):
    c = F.col("station_id")
    log = t.long_log().withColumns({
        "price": 0.4 + (F.col("price") % 400) / 100, "cp": F.lpad((c * 37 % 96000).cast("string"), 5, "0"), "lat": 42.0 + (c * 7919 % 9000) / 1000, "lon": -4.0 + (c * 104729 % 12000) / 1000,
        "city": F.when(c % 9 == 0, "FRANCE").when(c % 9 == 1, "PERU").otherwise("X"),
    })
    got = P.monthly_panel(log, *t.months(), t.rules(), tie="tie")
    return got.select("station_id", "fuel", "date", F.round("relative", 6).alias("relative"), F.round("robust_score", 6).alias("robust_score"), "department", "competition_bucket", "isolation_bucket", "accessibility_class")


@query("g3_panel_summary", f"WITH {PANEL} SELECT fuel, date, count(DISTINCT station_id) AS stations, median(price) AS median_price, round(median(relative), 9) AS median_relative FROM panel GROUP BY ALL")
def panel_summary(t):
    return t.panel().groupBy("fuel", "date").agg(F.count_distinct("station_id").alias("stations"), F.median("price").alias("median_price"), F.round(F.median("relative"), 9).alias("median_relative"))


FACTORS = {f: P.SHRINK[f] for f in ("region", "road")}
CLASS = "CASE WHEN n_units < 10 THEN 0.0::DOUBLE WHEN level = 'MAINLAND' THEN 0.0::DOUBLE WHEN level = 'FERRY_ISLAND' THEN greatest(effect, 0.0::DOUBLE) ELSE effect END"


def _fit(train: str, name: str, factors=FACTORS, rounds: int = ROUNDS, adjust: dict | None = None) -> str:
    """The trimmed rows, the effects and the centre of a model of the table ``train``."""
    trim = f"{name}_t AS (SELECT * FROM {train} WHERE abs(robust_score) <= 4)"
    steps = f"{trim}, {_backfit(f'{name}_t', 'relative', factors, rounds, name, 'station_id', adjust)}" if factors else trim
    return f"{steps}, {_summed(f'{name}_t', factors, name, f'{name}_s')}, {name}_c AS (SELECT fuel, median(total) AS centre FROM {name}_s GROUP BY fuel)"


_MODEL = f"{PANEL}, {_fit('panel', 'md')}"
_DIAG = f"dg_r AS (SELECT s.*, relative - (total - centre) AS v FROM md_s s JOIN md_c USING (fuel)), dg_u AS (SELECT fuel, accessibility_class AS level, station_id, median(v) AS v, count(*) AS n FROM dg_r GROUP BY ALL), dg AS (SELECT fuel, level, {CLASS} AS effect, n_obs, n_units FROM (SELECT fuel, level, median(v) * count(*) / (count(*) + 10.0) AS effect, sum(n)::BIGINT AS n_obs, count(*) AS n_units FROM dg_u GROUP BY ALL))"
_SURE = "CASE WHEN n_units >= 100 THEN 'HIGH' WHEN n_units >= 30 THEN 'MEDIUM' WHEN n_units >= 10 THEN 'LOW' ELSE 'INSUFFICIENT' END"


def _model(t):
    return P.fit(t.panel(), rounds=ROUNDS)


@query("d14_backfit_panel", f"WITH {_MODEL}, {_DIAG}, al AS ({' UNION ALL '.join([f'''SELECT fuel, '{f}' AS factor, level, effect, n_obs, n_units, 'ACTIVE' AS role FROM md_{f}''' for f in FACTORS])} UNION ALL SELECT fuel, 'accessibility_class', level, effect, n_obs, n_units, 'DIAGNOSTIC_ONLY' FROM dg) SELECT fuel, factor, level, round(effect, 6) AS effect, n_obs, n_units, role, {_SURE} AS confidence FROM al")
def backfit_panel(t):
    return _model(t).effects.select("fuel", "factor", "level", F.round("effect", 6).alias("effect"), "n_obs", "n_units", "role", "confidence")


@query("g17_model_meta", f"WITH {_MODEL} SELECT t.fuel, min(date) AS train_start, max(date) AS train_end, count(*) AS n_obs, count(DISTINCT station_id) AS n_units, count(DISTINCT date) AS n_months, round(any_value(centre), 6) AS centre FROM md_t t JOIN md_c c ON t.fuel = c.fuel GROUP BY t.fuel")
def model_meta(t):
    return rounded(P.fit(t.panel(), rounds=ROUNDS, with_bias=False).meta)


_BIAS = f"""bs0 AS (SELECT s.*, relative - (total - centre) AS v FROM (SELECT * FROM bs_s) s JOIN md_c USING (fuel)), bs AS (SELECT fuel, station_id, median(v) AS raw, count(DISTINCT date) AS months, count(v) AS n_obs FROM bs0 GROUP BY ALL)"""


@query("g9_model_bias", f"WITH {_MODEL}, {_summed('panel', FACTORS, 'md', 'bs_s')}, {_BIAS} SELECT fuel, station_id, months, n_obs, round(raw * months / (months + 6.0), 6) AS bias, CASE WHEN months >= 18 THEN 'HIGH' WHEN months >= 12 THEN 'MEDIUM' WHEN months >= 6 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence, CASE WHEN months < 12 THEN 'PROVISIONAL' WHEN raw * months / (months + 6.0) > 15 THEN 'VERY_HIGH' WHEN raw * months / (months + 6.0) > 10 THEN 'HIGH' WHEN raw * months / (months + 6.0) > 5 THEN 'ELEVATED' ELSE 'NORMAL' END AS status FROM bs")
def model_bias(t):
    return _model(t).bias.select("fuel", "station_id", "months", "n_obs", F.round("bias", 6).alias("bias"), "confidence", "status")


def _last(days: int, least: int) -> str:
    return f"ld AS (SELECT fuel, date FROM (SELECT fuel, date, row_number() OVER (PARTITION BY fuel ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY fuel) AS n FROM (SELECT DISTINCT fuel, date FROM panel)) WHERE k <= {days} AND n > {days + least}), tr AS (SELECT * FROM panel p WHERE fuel IN (SELECT fuel FROM ld) AND NOT EXISTS (SELECT 1 FROM ld WHERE ld.fuel = p.fuel AND ld.date = p.date)), te AS (SELECT p.* FROM panel p JOIN ld USING (fuel, date))"


_ERRORS = "fuel, min(date) AS test_start, max(date) AS test_end, count(*) AS n_test, round(avg(abs(relative)), 5) AS mae_baseline, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(relative * relative)), 5) AS rmse_baseline, round(sqrt(avg(e * e)), 5) AS rmse, round(100 * (1 - avg(abs(e)) / avg(abs(relative))), 4) AS mae_gain_pct, round(100 * (1 - sqrt(avg(e * e)) / sqrt(avg(relative * relative))), 4) AS rmse_gain_pct"
DAYS = 8


def _errors(df):
    return df.select(*[F.round(c, 4 if c.endswith("pct") else 5).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("d15_predict", f"WITH {PANEL}, {_last(DAYS, 3)}, {_fit('tr', 'md')}, {_summed('te', FACTORS, 'md', 'pe')} SELECT station_id, fuel, date, round(total - centre, 6) AS structural_premium, coverage, CASE WHEN least_units >= 100 THEN 'HIGH' WHEN least_units >= 30 THEN 'MEDIUM' WHEN least_units >= 10 THEN 'LOW' ELSE 'INSUFFICIENT' END AS premium_confidence FROM pe JOIN md_c USING (fuel)")
def predict(t):
    p = t.panel()
    train, test = P.split(p, P.last_dates(p, DAYS, 3))
    got = P.predict(test, P.fit(train, list(FACTORS), ROUNDS, with_bias=False))
    return got.select("station_id", "fuel", "date", F.round("structural_premium", 6).alias("structural_premium"), "coverage", "premium_confidence")


@query("d17_holdout", f"WITH {PANEL}, {_last(DAYS, 3)}, {_fit('tr', 'md')}, {_summed('te', FACTORS, 'md', 'pe')}, er AS (SELECT pe.*, relative - (total - centre) AS e FROM pe JOIN md_c USING (fuel)) SELECT {_ERRORS} FROM er GROUP BY fuel")
def holdout(t):
    return _errors(P.validate(t.panel(), DAYS, list(FACTORS), rounds=ROUNDS))


SHOCK = "2024-01-16"
_REGIME = f"""dd AS (SELECT fuel, date, date >= DATE '{SHOCK}' AS post, row_number() OVER (PARTITION BY fuel, date >= DATE '{SHOCK}' ORDER BY date DESC) AS back, row_number() OVER (PARTITION BY fuel, date >= DATE '{SHOCK}' ORDER BY date) AS k, count(*) OVER (PARTITION BY fuel, date >= DATE '{SHOCK}') AS n FROM (SELECT DISTINCT fuel, date FROM panel))"""
_PARTS = {"PRE_SHOCK": "NOT post AND back <= 3 AND n > 3", "SHOCK_ONSET": "post AND k <= 4", "CURRENT_REGIME": "post AND k > 4 AND k <= 7"}


def _regime(k: int, name: str, where: str) -> str:
    return f"c{k} AS (SELECT fuel, date FROM dd WHERE {where}), tr{k} AS (SELECT p.* FROM panel p JOIN (SELECT fuel, min(date) AS f FROM c{k} GROUP BY fuel) USING (fuel) WHERE date < f), te{k} AS (SELECT p.* FROM panel p JOIN c{k} USING (fuel, date) WHERE fuel IN (SELECT fuel FROM tr{k})), {_fit(f'tr{k}', f'm{k}')}, {_summed(f'te{k}', FACTORS, f'm{k}', f'pe{k}')}, er{k} AS (SELECT pe{k}.*, relative - (total - centre) AS e FROM pe{k} JOIN m{k}_c USING (fuel))"


@query("d18_regimes", f"WITH {PANEL}, {_REGIME}, " + ", ".join(_regime(k, n, w) for k, (n, w) in enumerate(_PARTS.items())) + " " + " UNION ALL ".join(f"SELECT {_ERRORS}, '{n}' AS split FROM er{k} GROUP BY fuel" for k, n in enumerate(_PARTS)))
def regimes(t):
    return _errors(P.regimes(t.panel(), SHOCK, factors=list(FACTORS), rounds=ROUNDS))


_ABLATION = [list(FACTORS)[:k] for k in range(len(FACTORS) + 1)]


@query("d19_ablation", f"WITH {PANEL}, {_last(DAYS, 3)}, " + ", ".join(f"{_fit('tr', f'm{k}', {f: P.SHRINK[f] for f in fs})}, {_summed('te', fs, f'm{k}', f'pe{k}')}, er{k} AS (SELECT pe{k}.*, relative - {'(total - centre)' if fs else '0'} AS e FROM pe{k} JOIN m{k}_c USING (fuel))" for k, fs in enumerate(_ABLATION)) + " " + " UNION ALL ".join(f"SELECT {_ERRORS}, {k} AS step, '{'+'.join(fs)}' AS factors FROM er{k} GROUP BY fuel" for k, fs in enumerate(_ABLATION)))
def ablation(t):
    return _errors(P.ablation(t.panel(), list(FACTORS), DAYS, rounds=ROUNDS))


#: The panel under the trade's fuel names, with all six factors.
_FULL = """
full_panel AS (
  SELECT * EXCLUDE (fuel, road),
    CASE fuel WHEN 'click' THEN 'SP95' WHEN 'purchase' THEN 'GAZOLE' ELSE fuel END AS fuel,
    CASE WHEN station_id % 3 = 0 THEN 'AUTOROUTE' ELSE 'ROUTE' END AS road,
    'd' || (station_id % 7) AS department,
    CASE station_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS competition_bucket,
    CASE WHEN station_id % 13 < 4 THEN 'LOCAL' ELSE 'DENSE' END AS isolation_bucket
  FROM panel
)
"""


def _full(t):
    c = F.col("station_id")
    return t.panel().withColumns({
        "fuel": F.when(F.col("fuel") == "click", "SP95").when(F.col("fuel") == "purchase", "GAZOLE").otherwise(F.col("fuel")),
        "road": F.when(c % 3 == 0, "AUTOROUTE").otherwise("ROUTE"), "department": F.concat(F.lit("d"), (c % 7).cast("string")),
        "competition_bucket": F.when(c % 4 == 0, "LOW").when(c % 4 == 1, "HIGH").otherwise("MEDIUM"), "isolation_bucket": F.when(c % 13 < 4, "LOCAL").otherwise("DENSE"),
    })


_WIDE = {f: P.SHRINK[f] for f in P.ACTIVE["GAZOLE"]}
_NARROW = {f: P.SHRINK[f] for f in P.ACTIVE["SP95"]}


def _diagnostic(name: str, factor: str, out: str) -> str:
    """What the active factors leave, by ``factor``, before its rules."""
    return f"""
{out}_u AS (
  SELECT s.fuel, coalesce({factor}, 'UNKNOWN') AS level, station_id, median(relative - (total - centre)) AS v, count(*) AS n
  FROM {name}_s s JOIN {name}_c USING (fuel) GROUP BY ALL
),
{out} AS (
  SELECT fuel, level, median(v) * count(*) / (count(*) + {P.SHRINK[factor]}) AS effect, sum(n)::BIGINT AS n_obs, count(*) AS n_units
  FROM {out}_u GROUP BY ALL
)
"""


def _levels(name: str, factors) -> str:
    return " UNION ALL ".join(f"SELECT fuel, '{f}' AS factor, level, effect, n_obs, n_units, 'ACTIVE' AS role FROM {name}_{f}" for f in factors)


@query("d14_production_fit", f"""
WITH {PANEL}, {_FULL},
others AS (SELECT * FROM full_panel WHERE fuel <> 'SP95'),
petrol AS (SELECT * FROM full_panel WHERE fuel = 'SP95'),
{_fit('others', 'mo', _WIDE, 10)},
{_fit('petrol', 'mp', _NARROW, 10)},
{_diagnostic('mo', 'accessibility_class', 'ao')}, {_diagnostic('mp', 'accessibility_class', 'ap')}, {_diagnostic('mp', 'road', 'rp')},
base AS (SELECT coalesce(max(CASE WHEN level = 'ROUTE' THEN effect END), 0.0) AS base FROM rp),
roads AS (
  SELECT fuel, level, n_obs, n_units,
    CASE level WHEN 'ROUTE' THEN 0.0::DOUBLE WHEN 'AUTOROUTE' THEN greatest(effect - base, 0.0::DOUBLE) ELSE effect - base END AS effect
  FROM rp, base
),
every AS (
  {_levels('mo', _WIDE)} UNION ALL {_levels('mp', _NARROW)}
  UNION ALL SELECT fuel, 'accessibility_class', level, {CLASS}, n_obs, n_units, 'DIAGNOSTIC_ONLY' FROM (SELECT * FROM ao UNION ALL SELECT * FROM ap)
  UNION ALL SELECT fuel, 'road', level, effect, n_obs, n_units, 'DIAGNOSTIC_ONLY' FROM roads
)
SELECT fuel, factor, level, round(effect, 6) AS effect, n_obs, n_units, role, {_SURE} AS confidence FROM every
""")
def production_fit(t):
    """Ten rounds, each fuel with its own factors by the domain's defaults, all in one fit."""
    got = P.fit(_full(t), with_bias=False).effects
    return got.select("fuel", "factor", "level", F.round("effect", 6).alias("effect"), "n_obs", "n_units", "role", "confidence")


_STEPS = [list(P.SHRINK)[:k] for k in range(len(P.SHRINK) + 1)]


def _step(k: int) -> str:
    factors, name = {f: P.SHRINK[f] for f in _STEPS[k]}, f"s{k}"
    e = "relative - (total - centre)" if factors else "relative"
    road = f"CASE WHEN fuel <> 'SP95' THEN effect ELSE CASE level WHEN 'ROUTE' THEN 0.0::DOUBLE WHEN 'AUTOROUTE' THEN greatest(effect - {'{0}'}, 0.0::DOUBLE) ELSE effect - {'{0}'} END END"
    base = "coalesce(max(CASE WHEN level = 'ROUTE' THEN effect END) OVER (PARTITION BY fuel), 0.0)"
    adjust = {"accessibility_class": CLASS, "road": road.format(base)}
    return f"""
{_fit('tr', name, factors, ROUNDS, adjust)},
{_summed('te', factors, name, f'{name}_p')},
{name}_e AS (SELECT p.*, {e} AS e FROM {name}_p p JOIN {name}_c USING (fuel))
"""


@query("d19_ablation_six", f"""
WITH {PANEL.replace('panel AS (', 'panel0 AS (')}, {_FULL.replace('FROM panel', 'FROM panel0').replace('full_panel AS', 'panel AS')},
{_last(DAYS, 3)},
{','.join(_step(k) for k in range(len(_STEPS)))}
{' UNION ALL '.join(f"SELECT {_ERRORS}, {k} AS step, '{'+'.join(fs)}' AS factors FROM s{k}_e GROUP BY fuel" for k, fs in enumerate(_STEPS))}
""")
def ablation_six(t):
    """From none to all six factors, seven models in one fit."""
    return _errors(P.ablation(_full(t), list(P.SHRINK), DAYS, rounds=ROUNDS))


_LIVE = "lv0 AS (SELECT station_id, station_id AS id, fuel, price, 50.0::DOUBLE AS fair_price, region, road, 'X' AS city, 42.0::DOUBLE + (station_id * 7919 % 9000)::DOUBLE / 1000.0::DOUBLE AS lat, -4.0::DOUBLE + (station_id * 104729 % 12000)::DOUBLE / 1000.0::DOUBLE AS lon FROM panel WHERE date = (SELECT max(ts)::DATE FROM events))"


@query("d16_apply", f"WITH {_MODEL}, {_summed('panel', FACTORS, 'md', 'bs_s')}, {_BIAS}, {_LIVE}, {_features('lv0', 'ft')}, {_access('ft', 'ac')}, {_summed('ac', FACTORS, 'md', 'lv1')}, lv AS (SELECT lv1.*, total - centre AS premium, 100 * (price - fair_price - (total - centre) / 100) AS local_residual FROM lv1 JOIN md_c USING (fuel)), {_peers('lv', 'local_residual', 'pr')} SELECT pr.fuel, pr.id, pr.accessibility_class, round(premium, 6) AS structural_premium, round(local_residual, 4) AS local_residual, round(raw * months / (months + 6.0), 6) AS bias, method, n_peers, round(score, 3) AS score, {FLAG} AS local_flag FROM pr LEFT JOIN bs ON pr.fuel = bs.fuel AND pr.id = bs.station_id")
def apply(t):
    c = F.col("station_id")
    live = t.panel().filter(F.col("date") == F.lit(t.last_day()).cast("date")).select("station_id", c.alias("id"), "fuel", "price", F.lit(50.0).alias("fair_price"), "region", "road", F.lit("X").alias("city"), (42.0 + (c * 7919 % 9000) / 1000).alias("lat"), (-4.0 + (c * 104729 % 12000) / 1000).alias("lon"))
    got = P.apply(live, _model(t), t.rules(), **HOW)
    return got.select("fuel", "id", "accessibility_class", F.round("structural_premium", 6).alias("structural_premium"), F.round("local_residual", 4).alias("local_residual"), F.round("bias", 6).alias("bias"), "method", "n_peers", F.round("score", 3).alias("score"), "local_flag")


@query("d29_anomaly_history", f"""WITH {_MODEL}, {_summed('panel', FACTORS, 'md', 'hs')}, hx AS (SELECT hs.*, station_id AS id, hs.fuel || '|' || date AS fd, 42.0::DOUBLE + (station_id * 7919 % 9000)::DOUBLE / 1000.0::DOUBLE AS lat, -4.0::DOUBLE + (station_id * 104729 % 12000)::DOUBLE / 1000.0::DOUBLE AS lon, relative - (total - centre) AS local_residual, 'G' AS logistics_peer_group FROM hs JOIN md_c USING (fuel)), {_peers('hx', 'local_residual', 'pr', 'date')}, fl AS (SELECT *, {FLAG} AS flag, confidence IN ('HIGH', 'MEDIUM') AS sure FROM pr)
SELECT fuel, date, count_if(sure) AS assessed, count_if(sure AND flag IN ('HIGH', 'VERY_HIGH')) AS anomalies, count_if(sure AND flag = 'VERY_HIGH') AS very_high FROM fl GROUP BY ALL""")
def anomaly_history(t):
    c = F.col("station_id")
    panel = t.panel().withColumns({"logistics_peer_group": F.lit("G"), "lat": 42.0 + (c * 7919 % 9000) / 1000, "lon": -4.0 + (c * 104729 % 12000) / 1000})
    return P.anomaly_history(panel, _model(t), **HOW).select("fuel", "date", "assessed", "anomalies", "very_high")


@query("k8_flag_counts", f"WITH {_SX} SELECT fuel, {FLAG} AS local_flag, count(*) AS n FROM pr GROUP BY ALL")
def flag_counts(t):
    return R.value_counts(L.peer_flags(_islands(t), **HOW), ["fuel", "local_flag"])


@query("s1_top_scores", f"WITH {SCORED} SELECT id, fuel, spread_cent, k FROM (SELECT id, fuel, spread_cent, row_number() OVER (ORDER BY spread_cent DESC NULLS LAST, fuel, id) AS k FROM scored) WHERE k <= 20")
def top_scores(t):
    """The twenty highest spreads, a report of its own."""
    from pyspark.sql import Window

    top = t.scored().select("id", "fuel", "spread_cent").orderBy(F.col("spread_cent").desc_nulls_last(), "fuel", "id").limit(20)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.col("spread_cent").desc_nulls_last(), "fuel", "id")))  # of twenty rows
