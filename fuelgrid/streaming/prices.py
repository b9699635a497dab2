"""Structured Streaming forms of the price log's operators. On a stream that ended they equal the batch forms.

A log has station_id, fuel, updated_at (timestamp) and price. Rows without a time can't be placed: watermarks drop them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fuelgrid.operators import panel
from fuelgrid.operators import robust as R
from fuelgrid.storage import shared_dir


def read(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, as they come."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return (raw.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else raw).parquet(folder)


def latest(log: DataFrame) -> DataFrame:
    """The last price of each station and fuel, of several at one time the greatest; a state of one row for each."""
    return log.groupBy("station_id", "fuel").agg(F.max("updated_at").alias("updated_at"), F.max_by("price", F.struct("updated_at", "price")).alias("price"))


def windows(log: DataFrame, width: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and extremes of windows that tumble, or start every ``slide``; rows later than ``late`` are left out where
    the mode drops state."""
    df = log.withWatermark("updated_at", late).groupBy("fuel", F.window("updated_at", width, slide or width).alias("w"))
    return df.agg(F.count("*").alias("n"), F.max("price").alias("highest"), F.min("price").alias("lowest")).select("fuel", F.col("w.start").alias("start"), "n", "highest", "lowest")


def window_quantiles(log: DataFrame, width: str, shares: Sequence[float] = (0.1, 0.5, 0.9), accuracy: int = 10_000, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(fuel, start, n, quantiles) of windows, from mergeable sketches: a window's state is of a size that ``accuracy``
    bounds, whatever comes. A quantile's rank is off by n / ``accuracy`` at most; windows of fewer rows are exact."""
    df = log.withWatermark("updated_at", late).groupBy("fuel", F.window("updated_at", width, slide or width).alias("w"))
    return df.agg(F.count("*").alias("n"), F.percentile_approx("price", list(shares), accuracy).alias("quantiles")).select("fuel", F.col("w.start").alias("start"), "n", "quantiles")


def window_values(log: DataFrame, width: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(fuel, start, price, c): how often windows have each price. State is a row for each, dealt by all three."""
    df = log.withWatermark("updated_at", late).groupBy("fuel", F.window("updated_at", width, slide or width).alias("w"), "price")
    return df.agg(F.count("*").alias("c")).select("fuel", F.col("w.start").alias("start"), "price", "c")


def exact_quantiles(values: DataFrame, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(fuel, start, n, quantiles) of ``window_values``: the least price that this share of the window's prices doesn't
    exceed. Null prices count in n alone."""
    w, c = Window.partitionBy("fuel", "start"), F.when(F.col("price").isNotNull(), F.col("c"))
    df = values.withColumns({"known": F.sum(c).over(w), "upto": F.sum(c).over(w.orderBy("price"))})  # spills; one window's different prices
    parts = [Fraction(str(q)) for q in shares]
    ranks = [F.greatest(F.ceil(F.col("known") * p.numerator / F.lit(p.denominator)), F.lit(1)) for p in parts]
    found = [F.min(F.when(F.col("price").isNotNull() & (F.col("upto") >= r), F.struct("price"))).getField("price") for r in ranks]
    return df.groupBy("fuel", "start").agg(F.sum("c").alias("n"), F.array(*found).alias("quantiles"))


def unrepeated(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Change events once each, if a repetition comes within ``late``."""
    return log.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["station_id", "fuel", "updated_at", "price"])


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    df = log.withWatermark("updated_at", late).groupBy("station_id", F.session_window("updated_at", gap).alias("w"))
    return df.agg(F.count("*").alias("n")).select("station_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def scored(log: DataFrame, groups: DataFrame, fair: DataFrame) -> DataFrame:
    """Each price as it comes, against static tables: the fair price of its fuel (fuel, fair_price), and the median and
    MAD of its fuel's spread (fuel, median, mad), as robust.mad gives them."""
    df = R.joined(R.joined(log, fair, ["fuel"], fair_price="fair_price"), groups, ["fuel"], _m="median", _d="mad")
    df = df.withColumn("spread", F.col("price") - F.col("fair_price"))
    scale = R.MAD_TO_SIGMA * F.col("_d")
    return df.withColumn("z", F.when(scale > 0, (F.col("spread") - F.col("_m")) / scale).otherwise(0.0)).drop("_m", "_d")


def stale(log: DataFrame, days: int, late: str = "1 day") -> DataFrame:
    """(station_id, fuel, updated_at, price) once for each spell of ``days`` without a change: a timer on each station and
    fuel, in event time, goes off when the watermark passes it. A state of one row for each."""
    wait = days * 86_400_000
    ids = {f.name: f.dataType.simpleString() for f in log.select("station_id", "fuel").schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, price = state.get
            state.remove()
            yield pd.DataFrame({"station_id": [key[0]], "fuel": [key[1]], "updated_at": [pd.Timestamp(at, unit="us")], "price": [price]})
            return
        last = state.get if state.exists else (-(1 << 62), 0.0)
        for b in batches:
            for at, price in zip(b["updated_at"].astype("datetime64[us]").astype("int64"), b["price"]):
                last = max(last, (int(at), float(price)))
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    grouped = log.withWatermark("updated_at", late).groupBy("station_id", "fuel")
    out = f"station_id {ids['station_id']}, fuel {ids['fuel']}, updated_at timestamp, price double"
    return grouped.applyInPandasWithState(run, out, "at long, price double", "append", GroupStateTimeout.EventTimeTimeout)


def by_model(batch: DataFrame, folder: str) -> DataFrame:
    """A batch (fuel, factors) with structural_premium, coverage and premium_confidence by the newest model of ``folder``, and
    model_version. Each batch looks for it anew, so a model that is written meanwhile serves from the next batch on."""
    version, model = panel.load(batch.sparkSession, folder)
    return panel.predict(batch, model).withColumn("model_version", F.lit(version))


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Runs a stream over what there is and returns its result, a table of the shared folder, so it survives the loss of
    any executor. ``each`` may turn a batch's rows into others. Each batch is written under its own number: one that is
    tried again replaces itself."""
    spark = stream.sparkSession
    place, done = shared_dir(spark), []

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = each(spark.createDataFrame([], stream.schema))
    if not done:
        return empty
    kept = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(empty.schema).parquet(*[f"{place}/out/batch={k}" for k in kept])

