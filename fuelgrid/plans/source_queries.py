"""Sources and sinks over the test tables: rows are written in a source's format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuelgrid.sources import readers, writers
from fuelgrid.storage import shared_dir

from .registry import query

MONTHS = ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc")


@query("a8_bulletins", """
WITH m AS (
  SELECT o_orderstatus AS status, date_trunc('month', o_orderdate)::DATE AS date, 1000 + count(*) % 8000 AS htt, 1000 + sum(o_custkey)::BIGINT % 400 AS quote
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL
),
two AS (SELECT *, lag(date) OVER w AS date0, lag(htt) OVER w AS htt0, lag(quote) OVER w AS quote0 FROM m WINDOW w AS (PARTITION BY status ORDER BY date)),
kept AS (SELECT *, CASE status WHEN 'F' THEN 'SP95' ELSE 'GAZOLE' END AS fuel, (date + INTERVAL 1 MONTH)::DATE AS issue_date FROM two WHERE date0 IS NOT NULL)
SELECT fuel, date, htt::DOUBLE / 10000 AS htt, quote::DOUBLE / 10000 AS quote, issue_date FROM kept
UNION ALL SELECT fuel, date0, htt0::DOUBLE / 10000, quote0::DOUBLE / 10000, issue_date FROM kept
""")
def bulletins(t):
    """Bulletins made of the orders' months, two months and two products each, and what is read from their text."""
    from pyspark.sql import Window

    date, w = F.trunc(F.to_date("o_orderdate"), "MM"), Window.partitionBy("status").orderBy("date")
    m = t.orders.filter("o_orderstatus IN ('F', 'O')").groupBy(F.col("o_orderstatus").alias("status"), date.alias("date")).agg((1000 + F.count("*") % 8000).alias("htt"), (1000 + F.sum("o_custkey") % 400).alias("quote"))
    two = m.withColumns({f"{c}0": F.lag(c).over(w) for c in ("date", "htt", "quote")}).filter("date0 IS NOT NULL")
    number = lambda c: F.concat(F.floor(F.col(c) / 100).cast("string"), F.lit(","), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    token = lambda c: F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(c)), F.lit(".-"), F.year(c).cast("string"))
    head = F.when(F.col("status") == "F", "Supercarburant sans plomb (sp95-e5)").otherwise("Gazole en c€/l")
    part = F.concat_ws(" ", head, token("date"), token("date0"), F.lit("\nFrance"), number("htt"), F.lit("|"), number("htt0"), F.lit("\nCotations"), number("quote"), number("quote0"))
    texts = two.groupBy("date").agg(F.concat_ws("\n", F.array_sort(F.collect_list(part))).alias("text"))  # two products a month
    texts = texts.select("text", F.add_months("date", 1).alias("issue_date"), F.lit("orders").alias("source_url"))
    return readers.bulletins(texts).select("fuel", "date", F.round("htt", 6).alias("htt"), F.round("quote", 6).alias("quote"), "issue_date")


@query("k1_csv_round_trip", "SELECT o_orderdate::DATE AS date, upper(o_orderstatus) AS fuel, min(o_totalprice) / 100000 AS htt_eur_l, max(o_totalprice) / 100000 AS ttc_eur_l FROM orders GROUP BY ALL")
def csv_round_trip(t):
    """A result table written as CSV files and read as the typed table of weekly prices."""
    path = f"{shared_dir(t.spark)}/prices"
    price = lambda f: f("o_totalprice") / 100000
    df = t.orders.groupBy(F.to_date("o_orderdate").alias("date"), F.lower("o_orderstatus").alias("fuel")).agg(price(F.min).alias("htt_eur_l"), price(F.max).alias("TTC_EUR_L"))
    writers.result(df, path)
    return readers.table(t.spark, path, "weekly_prices")


@query("a2_gzip_quotes", "SELECT l_shipdate::DATE AS date, round(avg(l_extendedprice), 4) AS quote FROM lineitem GROUP BY ALL HAVING round(avg(l_extendedprice), 4) IS NOT NULL")
def gzip_quotes(t):
    """A two-column series as gzip CSV."""
    path = f"{shared_dir(t.spark)}/quotes"
    df = t.lineitem.groupBy(F.to_date("l_shipdate").alias("DATE")).agg(F.round(F.avg("l_extendedprice"), 4).alias("VALUE"))
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return readers.quotes(t.spark, path, "quote")


@query("k2_panel_by_date", "SELECT o_orderdate::DATE AS date, o_orderstatus AS fuel, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY ALL")
def panel_by_date(t):
    """A panel written with a folder for each date; the read of some dates lists these alone."""
    path = f"{shared_dir(t.spark)}/panel"
    writers.panel(t.orders.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("fuel")).agg(F.count("*").alias("n")), path)
    return t.spark.read.parquet(path).filter("date >= DATE '1996-01-01'").select("date", "fuel", "n")


@query("a4_station_xml", """
WITH e AS (SELECT user_id AS u, event_type AS kind, date_trunc('second', ts) AS ts, value FROM events WHERE event_type IN ('click', 'view'))
SELECT u::VARCHAR AS station_id, CASE kind WHEN 'click' THEN 'SP95' ELSE 'GAZOLE' END AS fuel, ts AS updated_at, round(1 + floor(value) % 900 / 1000, 3)::DOUBLE AS price_eur_l
FROM e WHERE u % 7 <> 0
""")
def station_xml(t):
    """The log as stations' XML files, of which those off the mainland are left out."""
    path = f"{shared_dir(t.spark)}/stations"
    price = F.round(1 + F.floor("value") % 900 / 1000, 3)
    change = F.struct(F.when(F.col("event_type") == "click", "SP95").otherwise("Gazole").alias("_nom"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("_maj"), price.cast("string").alias("_valeur"))
    log = t.events.filter("event_type IN ('click', 'view')").groupBy("user_id").agg(F.collect_list(change).alias("prix"))  # a station's own changes
    code = F.when(F.col("user_id") % 7 == 0, "20100").otherwise("75001")
    log.select(F.col("user_id").alias("_id"), code.alias("_cp"), F.lit("R").alias("_pop"), "prix").write.format("xml").option("rootTag", "pdv_liste").option("rowTag", "pdv").save(path)
    return readers.station_xml(t.spark, path).select("station_id", "fuel", "updated_at", "price_eur_l")
