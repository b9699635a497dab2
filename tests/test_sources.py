import datetime as dt
import gzip

import pytest

from fuelgrid.operators import series
from fuelgrid.sources import readers, writers

BULLETIN = """Note de conjoncture
Fioul domestique 61,00 60,00
Gazole en c€/l : avr.-25 / mars-25 / écart
Cotation 44,80 ; 46,30 ; -1,50
Belgique 70,10 71,20
France 77,60 ; 78,40 ; -0,80
Supercarburant sans plomb (sp95-e5) en c€/l : avr.-25 / mars-25 / écart
Cotation 48,25 ; 47,05 ; 1,20
Belgique 69,90 69,10
France 73,15 ; 72,65 ; 0,50
"""


def test_csv_is_typed_plain_or_gzip_and_columns_match_by_name(spark, tmp_path):
    text = "fuel,htt_eur_l,date,more\nsp95,0.7,2026-01-02,x\nGazole,bad,2026-01-03,y\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        rows = readers.table(spark, str(tmp_path / name), "weekly_htt").orderBy("date").collect()
        assert [tuple(r) for r in rows] == [(dt.date(2026, 1, 2), "SP95", 0.7), (dt.date(2026, 1, 3), "GAZOLE", None)]
    assert readers.table(spark, str(tmp_path / "a.csv"), "weekly_prices").filter("ttc_eur_l IS NULL").count() == 2


def test_anchors_and_rules_get_their_derived_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,fuel,refined_quote_eur_l,source_status\n2026-05-01,sp95,0.5,provisional_to_2026-05-21\n2026-04-01,sp95,0.4,final\n")
    got = {r.date.month: r.effective_date for r in readers.table(spark, str(tmp_path / "a.csv"), "anchors").collect()}
    assert got == {5: dt.date(2026, 5, 21), 4: dt.date(2026, 4, 1)}
    (tmp_path / "m.csv").write_text("year,fuel,distribution_margin_eur_l\n2024,sp95,0.1\n2025,SP95,0.2\n")
    assert [tuple(r) for r in readers.latest_margins(readers.table(spark, str(tmp_path / "m.csv"), "margins")).collect()] == [("SP95", 0.2)]
    (tmp_path / "q.csv").write_text("observation_date,DCOIL\n2026-01-02,70.5\n2026-01-03,.\n")
    assert readers.quotes(spark, str(tmp_path / "q.csv"), "brent_usd_b").collect() == [(dt.date(2026, 1, 2), 70.5)]


def test_station_xml_keeps_the_mainland_the_two_fuels_and_sane_prices(spark, tmp_path):
    (tmp_path / "s.xml").write_text("""<?xml version="1.0" encoding="UTF-8"?><pdv_liste>
<pdv id="1" latitude="4620100" longitude="519800" cp="01000" pop="R"><adresse>a</adresse><ville>B</ville>
<prix nom="Gazole" id="1" maj="2026-01-01T08:00:00" valeur="1,749"/><prix nom="SP95" maj="2026-01-02 09:00:00" valeur="1859"/><prix nom="E85" maj="2026-01-02 09:00:00" valeur="0.8"/><prix nom="SP95" maj="nonsense" valeur="1.8"/></pdv>
<pdv id="2" cp="20000" pop="R"><prix nom="Gazole" maj="2026-01-01T08:00:00" valeur="1.7"/></pdv>
<pdv id="3" latitude="" longitude="" cp="75001" pop="A"><prix nom="SP95" maj="2026-01-01 08:00:00" valeur="99"/></pdv>
<pdv id="4" cp="75001" pop="Z"><prix nom="SP95" maj="2026-01-01 08:00:00" valeur="1.5"/></pdv></pdv_liste>""")
    got = sorted(tuple(r) for r in readers.station_xml(spark, str(tmp_path / "s.xml")).select("station_id", "cp", "ville", "road_type", "latitude", "fuel", "updated_at", "price_eur_l").collect())
    assert got == [
        ("1", "01000", "B", "ROUTE", 46.201, "GAZOLE", dt.datetime(2026, 1, 1, 8), 1.749),
        ("1", "01000", "B", "ROUTE", 46.201, "SP95", dt.datetime(2026, 1, 2, 9), 1.859),
        ("4", "75001", None, "UNKNOWN", None, "SP95", dt.datetime(2026, 1, 1, 8), 1.5),
    ]


def test_bulletins_give_two_months_of_two_fuels(spark):
    issue = dt.date(2025, 5, 9)
    rows = [(BULLETIN, issue, "whole"), ("nothing here", issue, "none"), (None, issue, "null"), ("", issue, "empty"), (BULLETIN.replace("Cotation", "Valeur"), issue, "unnamed"), (BULLETIN.replace("; 46,30 ", ""), issue, "short")]
    got = readers.bulletins(spark.createDataFrame(rows, "text string, issue_date date, source_url string")).collect()
    by = {(r.source_url, r.fuel, r.date.month): (round(r.htt, 6), round(r.quote, 6), round(r.margin, 6)) for r in got}
    petrol = {("SP95", 4): (0.7315, 0.4825, 0.249), ("SP95", 3): (0.7265, 0.4705, 0.256)}
    diesel = {("GAZOLE", 4): (0.776, 0.448, 0.328), ("GAZOLE", 3): (0.784, 0.463, 0.321)}
    assert by == {("whole", *k): v for k, v in (petrol | diesel).items()} | {("short", *k): v for k, v in petrol.items()} and len(got) == 6


def test_final_months_come_from_the_first_friday_with_both_fuels(spark):
    d = dt.date
    rows = [(d(2026, 2, 1), f, 0.7, d(2026, 3, k)) for k in (6, 13) for f in ("SP95", "GAZOLE")][1:] + [(d(2026, 2, 1), "SP95", 0.7, d(2026, 2, 27))]
    got = readers.finalized(spark.createDataFrame(rows, "date date, fuel string, htt double, issue_date date"), "2026-01-01", "2026-02-15").collect()
    assert {r.issue_date for r in got} == {d(2026, 3, 13)} and len(got) == 2


def test_charts_give_a_dates_last_close_in_the_zone(spark):
    good = '{"chart": {"result": [{"timestamp": [1767222000, 1767225600, 1767312000], "indicators": {"quote": [{"close": [60.0, 61.0, null]}]}}]}}'
    got = readers.charts(spark.createDataFrame([("a", good), ("b", "{}"), ("c", None)], "source string, payload string")).collect()
    assert [tuple(r) for r in got] == [("a", dt.date(2026, 1, 1), 61.0)]


def test_the_history_link_is_the_first_that_fits(spark):
    pages = [(1, '<a href="x/History_a.xlsx">'), (2, "<a href='b/Weekly_Oil_Bulletin_Prices_History.xlsx?a=1&amp;b=2'><a href=\"c/History.xlsx\">"), (3, "none"), (4, None)]
    got = {r.id: r.link for r in readers.history_link(spark.createDataFrame(pages, "id int, html string"), "html", *readers.HISTORY_LINKS).collect()}
    assert got == {1: "x/History_a.xlsx", 2: "b/Weekly_Oil_Bulletin_Prices_History.xlsx?a=1&b=2", 3: None, 4: None}


def test_a_feed_gives_a_row_for_each_fuel_in_utc(spark):
    prix = '[{"@nom": "SP95", "@maj": "", "@valeur": "9"}, {"@nom": "SP95", "@maj": "2026-07-01 12:00:00", "@valeur": "1.85"}, {"@nom": "Gazole", "@maj": "2026-01-05T12:00:00", "@valeur": "1,70"}]'
    rows = [("1", "84", "R", prix), ("2", "94", "R", prix), ("3", "11", "A", "no json"), ("4", "11", "A", None)]
    got = sorted((r.id, r.fuel, r.price, r.updated_at.hour, r.road_type) for r in readers.live_prices(spark.createDataFrame(rows, "id string, code_region string, pop string, prix string")).collect())
    assert [x[:3] + x[4:] for x in got] == [("1", "GAZOLE", 1.7, "ROUTE"), ("1", "SP95", 1.85, "ROUTE")]


def test_results_panels_and_metadata_come_back(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2026, 1, d), f"s{d}", float(d)) for d in (1, 2, 2)], "date date, station string, price double")
    writers.result(df, str(tmp_path / "r"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3
    writers.panel(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).filter("date = DATE'2026-01-02'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().toString()
    writers.metadata(spark, {"version": "1", "fuels": {"SP95": {"centre": 0.5}}}, str(tmp_path / "m"))
    assert readers.metadata(spark, str(tmp_path / "m")).select("fuels.SP95.centre").first()[0] == 0.5


def test_calendars(spark):
    from pyspark.sql import functions as F

    d = lambda x: F.lit(x).cast("date")
    row = spark.range(1).select(series.fridays(d("2026-01-02"), d("2026-01-16")).alias("f"), series.fridays(d("2026-01-03"), d("2026-01-05")).alias("g"), series.month_starts(d("2026-01-02"), d("2026-03-01")).alias("m")).first()
    assert [x.day for x in row.f] == [2, 9, 16] and row.g == [] and [x.month for x in row.m] == [2, 3]
