"""Views that give the test tables the shapes of the domain, in Spark and, as WITH clauses, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelgrid.storage import counted


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def log(self) -> DataFrame:
        """A dense price log: station_id, fuel, updated_at, price."""
        return self.events.select(F.col("user_id").alias("station_id"), F.col("event_type").alias("fuel"), F.col("ts").alias("updated_at"), F.col("value").alias("price"))

    def long_log(self) -> DataFrame:
        """A log over years, with ties: station_id, fuel, updated_at, price, tie."""
        return self.orders.selectExpr("o_custkey station_id", "o_orderstatus fuel", "o_orderdate updated_at", "o_totalprice price", "o_orderkey tie")

    def last_day(self) -> str | None:
        """The date of the log's last change."""
        return self._day("ts", F.max)

    def _day(self, column: str, of, table: str = "events") -> str | None:
        day = getattr(self, table).agg(of(F.to_date(column))).first()[0]
        return day and str(day)

    def months(self) -> tuple[str | None, str | None]:
        """The first and the last month's end of the long log."""
        return self._day(F.last_day("o_orderdate"), F.min, "orders"), self._day(F.last_day("o_orderdate"), F.max, "orders")

    def daily(self) -> DataFrame:
        """A daily series for each kind of event and group of users, with the gaps that it has: fuel, date, value."""
        fuel = F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(20)).cast("string"))
        return self.events.groupBy(fuel.alias("fuel"), F.to_date("ts").alias("date")).agg(F.median("value").alias("value"))

    def monthly(self) -> DataFrame:
        """Month-end quotes: fuel, date, quote."""
        return self.orders.groupBy(F.col("o_orderstatus").alias("fuel"), F.last_day(F.to_date("o_orderdate")).alias("date")).agg(F.median("o_totalprice").alias("quote"))

    def anchors(self) -> DataFrame:
        """A quote for each quarter, known half a year later: fuel, date, quote."""
        date = F.last_day(F.add_months(F.trunc("o_orderdate", "QUARTER"), 8))
        return self.orders.groupBy(F.col("o_orderstatus").alias("fuel"), date.alias("date")).agg(F.median("o_totalprice").alias("quote"))

    def stations(self) -> DataFrame:
        c = self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        return c.selectExpr("c_custkey id", "c_mktsegment fuel", "42.0D + (c_custkey * 7919 % 9000) / 1000.0D lat", "-4.0D + (c_custkey * 104729 % 12000) / 1000.0D lon", "concat('r', n_regionkey) region", "concat('d', c_nationkey) department", "CASE WHEN c_custkey % 10 = 0 THEN 'AUTOROUTE' ELSE 'ROUTE' END road", "c_acctbal / 1000.0D excess")

    def scored(self) -> DataFrame:
        """Stations with a price of one market: id, fuel, lat, lon, region, department, road, city, price, fair_price."""
        c = self.stations().join(F.broadcast(self.nation.selectExpr("concat('d', n_nationkey) department", "n_name city")), "department")
        return c.selectExpr("id", "fuel", "lat", "lon", "region", "department", "road", "city", "1.5D + excess / 100 price", "1.5D fair_price", "excess spread_cent")

    def rules(self) -> DataFrame:
        """Overrides of accessibility, two of them for one city."""
        rows = [("ville", " FRANCÉ ", "FERRY_ISLAND", "ISLE_A", 0), ("ville", "France", "MAINLAND", "LATER", 1), ("ville", "Perú", "FERRY_ISLAND", "ISLE_B", 2), ("VILLE", "Kenya", "ROAD_CONNECTED_ISLAND", "BRIDGE", 3), ("id", "17", "FERRY_ISLAND", "ISLE_C", 4), ("id", "18", "MAINLAND", "MAINLAND", 5)]
        return self.spark.createDataFrame(rows, "match_type string, match_value string, accessibility_class string, logistics_peer_group string, rank int")

    def panel(self) -> DataFrame:
        """Last price of each station and fuel on each day, its distance to the day's median, and factors."""
        from fuelgrid.operators import robust, series

        df, n = counted(series.snapshots(self.log(), ["station_id", "fuel"], "updated_at", "day", 3, last=self.last_day()))
        df = robust.group_median(df, "price", ["date", "fuel"], "m", n).withColumn("relative", F.col("price") - F.col("m"))
        df = robust.robust_z(df, "relative", ["date", "fuel"], "robust_score", 1.0, n)
        return df.selectExpr("station_id", "fuel", "date", "price", "relative", "robust_score", "CASE WHEN station_id % 11 > 0 THEN concat('a', station_id % 5) END region", "concat('b', station_id % 3) road", "CASE WHEN station_id % 9 = 0 THEN 'FERRY_ISLAND' ELSE 'MAINLAND' END accessibility_class")


def log_stream(t: Tables) -> DataFrame:
    """The log as a stream: station_id, fuel, updated_at, price."""
    from fuelgrid.streaming import prices

    path = f"{t.folder}/events.parquet"
    one_file = t.spark.read.format("binaryFile").option("pathGlobFilter", "events.parquet").load(t.folder).limit(1).count() == 1
    raw = prices.read(t.spark, t.folder if one_file else path, t.events.schema, "events.parquet" if one_file else "*.parquet")
    return raw.select(F.col("user_id").alias("station_id"), F.col("event_type").alias("fuel"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("value").alias("price"))


LOG = "log AS (SELECT user_id AS station_id, event_type AS fuel, ts AS updated_at, value AS price FROM events)"
LONG = "long_log AS (SELECT o_custkey AS station_id, o_orderstatus AS fuel, o_orderdate AS updated_at, o_totalprice AS price, o_orderkey AS tie FROM orders)"
DAILY = "daily AS (SELECT event_type || '-' || (user_id % 20) AS fuel, ts::DATE AS date, median(value) AS value FROM events GROUP BY 1, 2)"
MONTHLY = "monthly AS (SELECT o_orderstatus AS fuel, last_day(o_orderdate::DATE) AS date, median(o_totalprice) AS quote FROM orders GROUP BY 1, 2)"
ANCHORS = "anchors AS (SELECT o_orderstatus AS fuel, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 8 MONTH)::DATE) AS date, median(o_totalprice) AS quote FROM orders GROUP BY 1, 2)"
STATIONS = """stations AS (SELECT c_custkey AS id, c_mktsegment AS fuel, 42.0::DOUBLE + (c_custkey * 7919 % 9000)::DOUBLE / 1000.0::DOUBLE AS lat,
  -4.0::DOUBLE + (c_custkey * 104729 % 12000)::DOUBLE / 1000.0::DOUBLE AS lon, 'r' || n_regionkey AS region, 'd' || c_nationkey AS department,
  CASE WHEN c_custkey % 10 = 0 THEN 'AUTOROUTE' ELSE 'ROUTE' END AS road, c_acctbal / 1000.0::DOUBLE AS excess FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
#: The last price at each day's end, if three days old at most, by comparing each day with each price.
SNAPS = f"""{LOG}, days AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS date),
snaps AS (SELECT station_id, fuel, date, arg_max(price, updated_at) AS price, max(updated_at) AS updated_at FROM log JOIN days ON updated_at < date + INTERVAL 1 DAY GROUP BY 1, 2, 3
  HAVING (epoch_us((date + INTERVAL 1 DAY)::TIMESTAMP) - 1 - epoch_us(max(updated_at)))::DOUBLE / 86400000000.0 <= 3)"""
PANEL = f"""{SNAPS}, rel AS (SELECT station_id, fuel, date, price, price - median(price) OVER (PARTITION BY date, fuel) AS relative FROM snaps),
dev AS (SELECT *, median(relative) OVER (PARTITION BY date, fuel) AS m FROM rel), panel AS (SELECT station_id, fuel, date, price, relative,
  (relative - m) / greatest(1.4826 * median(abs(relative - m)) OVER (PARTITION BY date, fuel), 1.0::DOUBLE) AS robust_score,
  CASE WHEN station_id % 11 > 0 THEN 'a' || (station_id % 5) END AS region, 'b' || (station_id % 3) AS road, CASE WHEN station_id % 9 = 0 THEN 'FERRY_ISLAND' ELSE 'MAINLAND' END AS accessibility_class FROM dev)"""
SCORED = f"{STATIONS}, scored AS (SELECT s.* EXCLUDE (excess), n_name AS city, 1.5::DOUBLE + excess / 100 AS price, 1.5::DOUBLE AS fair_price, excess AS spread_cent FROM stations s JOIN nation ON s.department = 'd' || n_nationkey)"
