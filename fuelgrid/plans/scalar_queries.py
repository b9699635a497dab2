"""Scalar rules, filters and text sources over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.functions import scalars as S
from fuelgrid.operators import series as T

from .registry import query

_LINE = "l_orderkey, l_linenumber"


@query("d1_fair_price", f"SELECT {_LINE}, round((l_extendedprice / 100000.0::DOUBLE + l_tax + 0.6::DOUBLE) * 1.2::DOUBLE, 9) AS fair, round(l_extendedprice / 1.2::DOUBLE - 0.6::DOUBLE - l_tax, 6) AS margin FROM lineitem")
def fair_price(t):
    fair = S.fair_price(F.col("l_extendedprice") / 1e5, F.col("l_tax"), F.lit(0.6), F.lit(0.2))
    margin = S.implied_margin(F.col("l_extendedprice"), F.col("l_tax"), F.lit(0.6), F.lit(0.2))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(fair, 9).alias("fair"), F.round(margin, 6).alias("margin"))


@query("x17_unit_convert", f"SELECT {_LINE}, round(l_extendedprice / (1.0::DOUBLE + l_tax) / 158.987294928::DOUBLE, 6) AS eur_l_crude, round(l_extendedprice / (1.0::DOUBLE + l_tax) / 3.785411784::DOUBLE, 6) AS eur_l_product, round(l_quantity - l_extendedprice / (1.0::DOUBLE + l_tax) / 158.987294928::DOUBLE, 6) AS spread FROM lineitem")
def unit_convert(t):
    p, fx = F.col("l_extendedprice"), 1.0 + F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.usd_per_barrel_to_eur_per_litre(p, fx), 6).alias("eur_l_crude"), F.round(S.usd_per_gallon_to_eur_per_litre(p, fx), 6).alias("eur_l_product"), F.round(S.crude_spread(F.col("l_quantity"), p, fx), 6).alias("spread"))


@query("f13_bins", f"SELECT {_LINE}, CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity <= 2 THEN 'ISOLATED' WHEN l_quantity <= 5 THEN 'LOW' WHEN l_quantity <= 15 THEN 'MEDIUM' ELSE 'DENSE' END AS bucket FROM lineitem")
def bins(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.binned(F.col("l_quantity"), [2, 5, 15], ["ISOLATED", "LOW", "MEDIUM", "DENSE"]).alias("bucket"))


@query("f10_freshness", "SELECT o_orderkey, greatest(0, datediff('day', o_orderdate::DATE, DATE '2001-08-01'))::BIGINT AS age, CASE WHEN datediff('day', o_orderdate::DATE, DATE '2001-08-01') > 30 THEN 'VERY_OLD' WHEN datediff('day', o_orderdate::DATE, DATE '2001-08-01') > 7 THEN 'OLD' ELSE 'CURRENT' END AS flag FROM orders")
def freshness(t):
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.greatest(F.lit(0), age).cast("long").alias("age"), S.freshness(age).alias("flag"))


@query("x14_business_lag", "SELECT o_orderkey, len(list_filter(generate_series(o_orderdate::DATE, o_orderdate::DATE + (o_orderkey % 12)::INT - 1, INTERVAL 1 DAY), lambda x: isodow(x) <= 5))::BIGINT AS lag_days FROM orders")
def business_lag(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", S.business_days(day, F.date_add(day, (F.col("o_orderkey") % 12).cast("int"))).alias("lag_days"))


@query("f11_coordinates", """WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'bad' WHEN c_custkey % 2 = 0 THEN (4200000 + c_custkey)::VARCHAR ELSE '43.5' END AS a, CASE WHEN c_custkey % 11 = 0 THEN '99900000' ELSE '-1.25' END AS b FROM customer),
x AS (SELECT c_custkey, try_cast(a AS DOUBLE) AS a, try_cast(b AS DOUBLE) AS b FROM raw), y AS (SELECT c_custkey, CASE WHEN abs(a) > 90 THEN a / 100000 ELSE a END AS a, CASE WHEN abs(b) > 180 THEN b / 100000 ELSE b END AS b FROM x)
SELECT c_custkey, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN a END AS lat, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN b END AS lon FROM y""")
def coordinates(t):
    k = F.col("c_custkey")
    a = F.when(k % 7 == 0, "bad").when(k % 2 == 0, (4200000 + k).cast("string")).otherwise("43.5")
    lat, lon = S.coordinates(a, F.when(k % 11 == 0, "99900000").otherwise("-1.25"))
    return t.customer.select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("x18_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("x3_effective_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2026-05-31' ELSE o_orderdate::DATE END AS effective FROM orders")
def effective_date(t):
    status = F.when(F.col("o_orderkey") % 3 == 0, "official_provisional_to_2026-05-31_x").otherwise("official")
    return t.orders.select("o_orderkey", S.effective_date(status, F.to_date("o_orderdate")).alias("effective"))


@query("x1_text_key", r"SELECT conv_id, turn, trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS key, trim(regexp_replace(strip_accents(lower(role)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM conversations")
def text_key(t):
    return t.conversations.select("conv_id", "turn", S.text_key(F.col("text")).alias("key"), S.slug(F.col("role")).alias("slug"))


@query("f3_price", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1750.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 1.849::DOUBLE WHEN o_orderkey % 4 = 2 THEN 9.0::DOUBLE END AS p FROM orders), y AS (SELECT o_orderkey, CASE WHEN p > 20 THEN p / 1000 ELSE p END AS p FROM x) SELECT o_orderkey, CASE WHEN p BETWEEN 0.2 AND 5 THEN p END AS price FROM y")
def price(t):
    k = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", S.price(F.when(k == 0, "1750").when(k == 1, "1,849").when(k == 2, "9,0").otherwise("n/a")).alias("price"))


@query("f5_postcode", "SELECT c_custkey, lpad((c_custkey % 97)::VARCHAR, 2, '0') AS code, substr(regexp_replace('F-' || lpad((c_custkey % 99999)::VARCHAR, 5, '0'), '[^0-9]', '', 'g'), 1, 2) AS department, CASE WHEN c_custkey % 10 = 0 THEN 'AUTOROUTE' WHEN c_custkey % 10 = 1 THEN 'UNKNOWN' ELSE 'ROUTE' END AS road FROM customer WHERE substr(lpad((c_custkey % 99999)::VARCHAR, 5, '0'), 1, 2) NOT IN ('20', '97', '98')")
def postcode(t):
    k = F.col("c_custkey")
    dep = S.postcode_department(F.concat(F.lit("F-"), F.lpad((k % 99999).cast("string"), 5, "0")))
    road = S.road_type(F.when(k % 10 == 0, "a").when(k % 10 == 1, "x").otherwise("R"))
    return t.customer.select("c_custkey", S.padded_code((k % 97).cast("string")).alias("code"), dep.alias("department"), road.alias("road")).filter(~F.col("department").isin("20", "97", "98"))


@query("x4_french_month", "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS month, (o_orderkey % 1000)::DOUBLE / 100 AS number FROM orders")
def french_month(t):
    names = F.array(*[F.lit(x) for x in ("jan", "Fév.", "mars", "avr.", "MAI", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")])
    d = F.col("o_orderdate")
    token = F.concat(F.element_at(names, F.month(d)), F.when(F.dayofmonth(d) % 3 == 0, " ").when(F.dayofmonth(d) % 3 == 1, "-").otherwise(""), F.year(d).cast("string"))
    number = F.replace(((F.col("o_orderkey") % 1000) / 100).cast("string"), F.lit("."), F.lit(","))
    return t.orders.select("o_orderkey", S.french_month(token).alias("month"), S.decimal_comma(number).alias("number"))


@query("f8_mixed_date", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def mixed_date(t):
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, day.cast("string")).otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    return t.orders.select("o_orderkey", S.mixed_date(raw).alias("date"))


@query("a13_links", r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def links(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("f15_confidence", """SELECT c_custkey, CASE WHEN c_custkey % 150 >= 100 THEN 'HIGH' WHEN c_custkey % 150 >= 30 THEN 'MEDIUM' WHEN c_custkey % 150 >= 10 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence,
CASE WHEN c_custkey % 150 < 10 THEN 'INSUFFICIENT' WHEN c_custkey % 150 < 30 THEN 'LOW' WHEN c_custkey % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS least, CASE WHEN c_custkey % 24 >= 18 THEN 'HIGH' WHEN c_custkey % 24 >= 12 THEN 'MEDIUM' WHEN c_custkey % 24 >= 6 THEN 'LOW' ELSE 'INSUFFICIENT' END AS months_confidence,
CASE WHEN c_custkey % 24 < 12 THEN 'PROVISIONAL' WHEN c_acctbal / 400 > 15 THEN 'VERY_HIGH' WHEN c_acctbal / 400 > 10 THEN 'HIGH' WHEN c_acctbal / 400 > 5 THEN 'ELEVATED' ELSE 'NORMAL' END AS status FROM customer""")
def confidence(t):
    own, months = S.unit_confidence(F.col("c_custkey") % 150), F.col("c_custkey") % 24
    other = F.when(F.col("c_custkey") % 3 == 0, "LOW").otherwise("MEDIUM")
    return t.customer.select("c_custkey", own.alias("confidence"), S.least_confidence(own, other).alias("least"), S.months_confidence(months).alias("months_confidence"), S.bias_status(F.col("c_acctbal") / 400, months).alias("status"))


@query("x19_colour", """SELECT c_custkey, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN '#9e9e9e' WHEN x <= -5 THEN '#1a9850' WHEN x <= 0 THEN '#91cf60' WHEN x <= 5 THEN '#ffffbf' WHEN x <= 10 THEN '#fdae61' WHEN x <= 20 THEN '#f46d43' ELSE '#d73027' END AS colour
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'inf'::DOUBLE WHEN c_custkey % 11 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 13 = 0 THEN 5.0::DOUBLE ELSE c_acctbal / 300 END AS x FROM customer)""")
def colour(t):
    k = F.col("c_custkey")
    x = F.when(k % 7 == 0, float("inf")).when(k % 11 == 0, float("nan")).when(k % 13 == 0, 5.0).otherwise(F.col("c_acctbal") / 300)
    return t.customer.select("c_custkey", S.colour(x).alias("colour"))


_REGION = "CASE " + " ".join(f"WHEN d IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in S.REGIONS.items()) + " ELSE 'UNKNOWN' END"


@query("x7_region", f"SELECT c_custkey, d AS department, {_REGION} AS region, {_REGION} IN ('11', '24', '27', '28', '32', '44', '52', '53', '75', '76', '84', '93') AS mainland FROM (SELECT c_custkey, lpad((c_custkey % 99)::VARCHAR, 2, '0') AS d FROM customer)")
def region(t):
    d = F.lpad((F.col("c_custkey") % 99).cast("string"), 2, "0")
    return t.customer.select("c_custkey", d.alias("department"), S.region_of(d).alias("region"), S.region_of(d).isin(*S.REGIONS).alias("mainland"))


@query("f2_domain", "SELECT l_orderkey, l_linenumber, l_extendedprice / 20000 AS price FROM lineitem WHERE l_extendedprice / 20000 BETWEEN 0.5 AND 4.0 AND l_discount > 0")
def domain(t):
    x = S.missing(F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / 20000).otherwise(float("nan")))
    return t.lineitem.select("l_orderkey", "l_linenumber", x.alias("price")).na.drop(subset=["price"]).filter(F.col("price").between(0.5, 4.0))


@query("x9_html", r"SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS safe, printf('%.1f', page_id * 2 / 4.0) AS fixed FROM pages")
def html(t):
    return t.pages.select("page_id", S.html(F.col("html")).alias("safe"), S.fixed(F.col("page_id") * 2 / 4, 1).alias("fixed"))


@query("k6_map_box", "SELECT c_custkey, (40 + c_custkey % 14) BETWEEN 41 AND 52 AND (c_custkey % 20 - 8) BETWEEN -6 AND 10 AS on_map FROM customer")
def map_box(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", S.on_map((40 + k % 14).cast("double"), (k % 20 - 8).cast("double")).alias("on_map"))


@query("a17_calendars", """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), x AS (SELECT d, d + ((o.d - DATE '1990-01-01') % 70)::INT AS e FROM o)
SELECT d, len(list_filter(generate_series(d, e, INTERVAL 1 DAY), lambda x: isodow(x) = 5))::BIGINT AS fridays, len(list_filter(generate_series(d, e, INTERVAL 1 DAY), lambda x: day(x) = 1))::BIGINT AS month_starts, len(list_distinct(list_transform(generate_series(d, e, INTERVAL 1 DAY), lambda x: last_day(x::DATE))))::BIGINT AS month_ends FROM x""")
def calendars(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    e = F.date_add("d", (F.datediff("d", F.lit("1990-01-01").cast("date")) % 70).cast("int"))
    size = lambda c: F.size(c).cast("long")
    return d.select("d", size(T.fridays(F.col("d"), e)).alias("fridays"), size(T.month_starts(F.col("d"), e)).alias("month_starts"), size(T.month_ends(F.col("d"), e)).alias("month_ends"))
