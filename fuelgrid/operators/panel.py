"""The historical panel of station prices, the additive model fitted to it, and the model's validation.

A panel has station_id, fuel, date, relative (cents above the date's national median), robust_score and factor columns.
A model is three tables: effects, meta (a row for each fuel) and bias (a row for each station and fuel). Null labels, and
factors that a table doesn't have, are UNKNOWN; an empty panel gives empty tables.

A panel may hold several folds of rows, told apart by a column, each with its own model: all are fitted in the steps of one,
and the tables have that column too. So the regimes and the steps of an ablation cost one fit over their rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuelgrid.functions import scalars as S
from fuelgrid.operators import local, series
from fuelgrid.operators import robust as R
from fuelgrid.storage import counted, written

# Fixed values of the domain: shrinkage of each factor by stations, and the factors that enter the price of each fuel.
SHRINK = {"region": 80.0, "department": 40.0, "road": 100.0, "competition_bucket": 80.0, "isolation_bucket": 50.0, "accessibility_class": 10.0}
ACTIVE = {"GAZOLE": ("region", "department", "road", "competition_bucket", "isolation_bucket"), "SP95": ("region", "department", "competition_bucket", "isolation_bucket")}
DIAGNOSTIC = {"GAZOLE": ("accessibility_class",), "SP95": ("road", "accessibility_class")}


def monthly_panel(log: DataFrame, start: str, end: str, rules: DataFrame | None = None, max_age_days: int = 30, lowest: float = 0.5, highest: float = 4.0, floor: float = 1.0, tie: str | None = None) -> DataFrame:
    """Each station's last price at each month's end, if it is young and sane, its distance to the national median and
    its robust score; with ``rules``, and lat, lon and city in the log, also competition and accessibility on that date.

    ``log`` has station_id, fuel, updated_at, price and further columns, which stay. Without a region or a department they
    are derived from the postcode, cp.
    """
    ok = log.filter(F.col("updated_at").isNotNull() & F.col("price").between(lowest, highest))
    snaps = series.snapshots(ok, ["station_id", "fuel"], "updated_at", "month", max_age_days, tie, end).filter(F.col("date") >= F.last_day(F.lit(start).cast("date")))
    if "cp" in snaps.columns:
        code = S.postcode_department(F.col("cp").cast("string"))
        snaps = snaps if "department" in snaps.columns else snaps.withColumn("department", F.when(F.length(code) == 2, code).otherwise("UNKNOWN"))
        snaps = snaps if "region" in snaps.columns else snaps.withColumn("region", S.region_of(F.col("department")))
    if rules is not None:
        own = written(snaps.withColumnsRenamed({"fuel": "_fuel"}).withColumns({"fuel": F.concat_ws("|", "_fuel", F.col("date").cast("string")), "id": F.col("station_id")}))
        snaps = local.accessibility(local.with_features(own), rules).drop("fuel", "id").withColumnRenamed("_fuel", "fuel")
    snaps, n = counted(snaps)
    df = R.group_median(snaps, "price", ["date", "fuel"], "national_median", n).withColumn("relative", 100 * (F.col("price") - F.col("national_median")))
    return R.robust_z(df, "relative", ["date", "fuel"], "robust_score", floor, n)


def stabilized(factor: str, effects: DataFrame, keys: Sequence[str] = ("fuel",), least: int = 10) -> DataFrame:
    """``effects`` (fuel, level, effect, n_units) under the rules of the trade, with provisional_effect and constraint.

    Accessibility: the mainland is 0, classes that are hard to reach are 0 at least, and a class of fewer than ``least``
    stations counts for nothing. Roads of SP95: measured from ROUTE, and AUTOROUTE never below it.
    """
    level, e = F.col("level"), F.col("effect")
    if factor == "accessibility_class":
        e = F.when(level == "MAINLAND", 0.0).when(level.isin(*local.CONSTRAINED), F.greatest(e, F.lit(0.0))).otherwise(e)
        few = F.col("n_units") < least
        return effects.withColumns({"provisional_effect": e, "constraint": F.when(few, "INSUFFICIENT_ZEROED").otherwise("NONE"), "effect": F.when(few, 0.0).otherwise(e)})
    df = effects.withColumns({"provisional_effect": e, "constraint": F.lit("NONE")})
    if factor != "road":
        return df
    base = F.coalesce(F.max(F.when(level == "ROUTE", F.col("effect"))).over(Window.partitionBy(*keys)), F.lit(0.0))  # levels, not rows
    own, sp95 = F.col("effect") - base, F.col("fuel") == "SP95"
    moved = F.when(level == "ROUTE", 0.0).when(level == "AUTOROUTE", F.greatest(own, F.lit(0.0))).otherwise(own)
    named = F.when(level == "ROUTE", "SP95_ROUTE_REFERENCE_ZERO").when(level == "AUTOROUTE", "SP95_AUTOROUTE_NONNEGATIVE_PREMIUM").otherwise("NONE")
    return df.withColumns({"constraint": F.when(sp95, named).otherwise("NONE"), "effect": F.when(sp95, moved).otherwise(F.col("effect"))})


class Model:
    def __init__(self, effects: DataFrame, meta: DataFrame, bias: DataFrame | None, active: dict[str, Column], keys: tuple[str, ...] = ("fuel",)):
        """``active`` says of each factor, by a condition on the keys, where it is in the price. ``centre`` (keys, median) is
        a table of meta's centres alone, if there is one."""
        self.effects, self.meta, self.bias, self.active, self.keys = effects, meta, bias, active, keys
        self.centre: DataFrame | None = None


def save(model: Model, folder: str, version: int) -> None:
    """Adds a version of a model to a folder. Its meta table comes last, so a version that is seen is whole."""
    for table, df in (("effects", model.effects), ("meta", model.meta)):
        df.write.mode("overwrite").parquet(f"{folder}/{table}/version={version}")


def load(spark: SparkSession, folder: str) -> tuple[int, Model]:
    """The newest version in a folder, and its model: what it needs to predict for the fuels that it was fitted to."""
    meta = spark.read.parquet(f"{folder}/meta")
    version = meta.agg(F.max("version")).first()[0]
    effects, meta = spark.read.parquet(f"{folder}/effects/version={version}"), meta.filter(F.col("version") == version).drop("version")
    used = effects.filter("role = 'ACTIVE'").groupBy("factor").agg(F.collect_set("fuel").alias("fuels")).collect()  # a row for each factor
    return version, Model(effects, meta, None, {r["factor"]: F.col("fuel").isin(r["fuels"]) for r in sorted(used)})


def _by_fuel(table: dict[str, tuple[str, ...]], others: tuple[str, ...]) -> dict[str, Column]:
    """factor -> where it counts: for the fuels that ``table`` names with it, and with ``others`` for fuels it doesn't name."""
    fuel = F.col("fuel")
    out = {}
    for f in SHRINK:
        named = fuel.isin([k for k, v in table.items() if f in v])
        rest = ~fuel.isin(list(table)) & F.lit(f in others)
        if f in others or any(f in v for v in table.values()):
            out[f] = F.coalesce(named | rest, F.lit(f in others))
    return out


def _known(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``df`` with all of the factors, UNKNOWN where it has none."""
    missing = [f for f in factors if f not in df.columns]
    return df.withColumns({f: F.lit("UNKNOWN") for f in missing}) if missing else df


def fit(panel: DataFrame, factors: Sequence[str] | dict[int, Sequence[str]] | None = None, rounds: int = 10, trim: float = 4.0, with_bias: bool = True, fold: str | None = None, folds: Column | None = None) -> Model:
    """The model of a panel, or of each fold of it. Without ``factors``, each fuel has its own active factors, and its
    diagnostic ones are estimated on what these leave but never enter the price; else all of ``factors`` are active, or of
    each fold those that it names for it. ``folds`` is an array of the folds that a row is in, which are then spread only where
    they are read; else a row is in the one that its column ``fold`` names."""
    keys = (fold, "fuel") if fold else ("fuel",)
    extra: dict[str, Column] = {}
    if factors is None:
        rest = tuple(f for f in SHRINK if f != "accessibility_class")
        active, extra = _by_fuel(ACTIVE, rest), _by_fuel(DIAGNOSTIC, ("accessibility_class",))
        active, extra = ({f: c for f, c in x.items() if f in panel.columns} for x in (active, extra))
    elif isinstance(factors, dict):
        active = {f: F.col(fold).isin([k for k, v in factors.items() if f in v]) for f in dict.fromkeys(f for v in factors.values() for f in v)}
    else:
        active = {f: F.lit(True) for f in factors}
    panel = written(_known(panel, list(active)))
    in_folds = lambda rows: rows if folds is None else rows.withColumn(fold, F.explode(folds))
    trim_rows = R.trimming(in_folds(panel), "robust_score", trim, keys)
    spread = lambda rows: trim_rows(in_folds(rows))
    train = spread(panel)
    adjust = {f: (lambda e, f=f: stabilized(f, e, keys)) for f in active if f in ("road", "accessibility_class")}
    effects = R.backfit(panel, "relative", keys, {f: SHRINK[f] for f in active}, rounds, "station_id", adjust, active, spread)
    for c, none in (("provisional_effect", F.col("effect")), ("constraint", F.lit("NONE"))):
        effects = effects.withColumn(c, F.coalesce(c, none) if c in effects.columns else none)
    effects = written(effects.withColumn("role", F.lit("ACTIVE")))  # levels, not rows; of known size, so rows aren't dealt by level
    model = Model(effects, None, None, active, keys)
    summed = _summed(train, model)
    summed, n = counted(summed if extra else summed.select(*keys, "_sum"))
    model.centre = written(R.group_medians(summed, "_sum", keys, n))
    facts = train.groupBy(*keys).agg(F.min("date").alias("train_start"), F.max("date").alias("train_end"), F.count("*").alias("n_obs"), F.count_distinct("station_id").alias("n_units"), F.count_distinct("date").alias("n_months"))
    model.meta = R.joined(facts, model.centre, keys, centre="median")  # counted only where it is read
    if extra:
        left = R.joined(summed, model.centre, keys, _centre="median")
        left = left.withColumn("_left", F.col("relative") - (F.col("_sum") - F.col("_centre")))
        for f, where in extra.items():
            rows = left.filter(where).withColumn("level", S.or_unknown(F.col(f)))
            got = stabilized(f, R.shrunk_effect(rows, F.col("_left"), [*keys, "level"], SHRINK[f], "station_id").filter("effect IS NOT NULL"), keys)
            effects = effects.unionByName(got.withColumns({"factor": F.lit(f), "role": F.lit("DIAGNOSTIC_ONLY")}))
    sure = S.unit_confidence(F.col("n_units"))
    model.effects = written(effects.withColumn("confidence", sure).withColumn("status", F.when(sure == "INSUFFICIENT", "PROVISIONAL").otherwise("ESTIMATED")))
    if with_bias:
        out = R.joined(_summed(in_folds(panel), model), model.centre, keys, _centre="median").withColumn("_left", F.col("relative") - (F.col("_sum") - F.col("_centre")))
        model.bias = lasting_bias(out, "_left", keys=keys)
    return model


def _summed(df: DataFrame, model: Model, coverage: bool = False) -> DataFrame:
    """``df`` with _sum, the active effects of each row, and their matches and least confidence."""
    total, seen, of, labels = F.lit(0.0), F.lit(0), F.lit(0), []
    df = _known(df, list(model.active))
    for f, on in model.active.items():
        part = model.effects.filter((F.col("factor") == f) & (F.col("role") == "ACTIVE"))
        cols = {f"_e_{f}": "effect"} | ({f"_c_{f}": "confidence"} if coverage else {})
        df = df.withColumn(f"_l_{f}", S.or_unknown(F.col(f)))
        df = R.joined(df, part.withColumnRenamed("level", f"_l_{f}"), [*model.keys, f"_l_{f}"], **cols).drop(f"_l_{f}")
        e = F.col(f"_e_{f}")
        total = total + F.coalesce(F.when(on, e), F.lit(0.0))
        seen, of = seen + (on & e.isNotNull()).cast("int"), of + on.cast("int")
        if coverage:
            labels.append(F.when(on, F.coalesce(F.col(f"_c_{f}"), F.lit("INSUFFICIENT"))))
    more = {"_sum": total}
    if coverage:
        least = F.lit("INSUFFICIENT")
        for label in ("INSUFFICIENT", "LOW", "MEDIUM", "HIGH")[::-1]:
            least = F.when(F.array_contains(F.array(*labels), label), label).otherwise(least) if labels else least
        more |= {"coverage": F.coalesce(F.try_divide(seen, of), F.lit(0.0)), "premium_confidence": least}
    return df.withColumns(more).drop(*[c for c in df.columns if c.startswith(("_e_", "_c_"))])


def predict(df: DataFrame, model: Model) -> DataFrame:
    """``df`` (fuel, factors) with structural_premium, coverage and premium_confidence, the least of its levels'."""
    centre = model.meta.withColumnRenamed("centre", "median") if model.centre is None else model.centre
    out = R.joined(_summed(df, model, True), centre, model.keys, _centre="median")
    return out.withColumn("structural_premium", F.col("_sum") - F.coalesce("_centre", F.lit(0.0))).drop("_sum", "_centre")


def lasting_bias(df: DataFrame, residual: str, shrink: float = 6.0, keys: Sequence[str] = ("fuel",)) -> DataFrame:
    """(keys, station_id, raw_bias, bias, months, n_obs, confidence, status): what a station keeps above the model."""
    each = [*keys, "station_id"]
    out = df.groupBy(*each).agg(F.median(residual).alias("raw_bias"), F.count_distinct("date").alias("months"), F.count(residual).alias("n_obs"))  # a row a date
    out = out.withColumn("bias", F.col("raw_bias") * F.col("months") / (F.col("months") + F.lit(shrink)))
    return out.withColumns({"confidence": S.months_confidence(F.col("months")), "status": S.bias_status(F.col("bias"), F.col("months"))})


def apply(scored: DataFrame, model: Model, rules: DataFrame, **peers) -> DataFrame:
    """Live scores (id, fuel, price, fair_price ...) under the model: premium, residual, lasting bias, peers, flag."""
    featured = scored if {"competition_bucket", "isolation_bucket", "nearest_km", "within_20"} <= set(scored.columns) else local.with_features(scored)
    out = local._priced(predict(local.accessibility(featured, rules), model))
    if model.bias is not None:
        bias = model.bias.withColumn("_id", F.col("station_id").cast("string"))
        out = R.matched(out.withColumn("_id", F.col("id").cast("string")), bias, ["fuel", "_id"], bias="bias", bias_months="months", bias_confidence="confidence", bias_status="status").drop("_id")
    out = R.joined(out, written(model.meta), ["fuel"], train_start="train_start", train_end="train_end", train_months="n_months")
    return local.peer_flags(out, **peers)


def anomaly_history(panel: DataFrame, model: Model, **peers) -> DataFrame:
    """(fuel, date, assessed, anomalies, very_high ...): how many stations of each date stand out from their peers of that
    date, under one model for all dates. ``panel`` has lat and lon."""
    df = predict(panel, model).withColumn("local_residual", F.col("relative") - F.col("structural_premium"))
    df = written(df.withColumnRenamed("fuel", "_fuel").withColumns({"fuel": F.concat_ws("|", "_fuel", F.col("date").cast("string")), "id": F.col("station_id")}))
    flagged = local.peer_flags(df, **peers).drop("fuel").withColumnRenamed("_fuel", "fuel")
    return local.anomaly_rate(flagged, ["fuel", "date"])


def last_dates(panel: DataFrame, months: int, more: int = 0) -> DataFrame:
    """(fuel, date) of each fuel's last ``months`` dates, for fuels with more than ``more`` dates besides."""
    dates = panel.select("fuel", "date").distinct()
    w = Window.partitionBy("fuel")
    ranked = dates.withColumns({"_k": F.row_number().over(w.orderBy(F.col("date").desc())), "_n": F.count("*").over(w)})  # dates, not rows
    return ranked.filter((F.col("_k") <= months) & (F.col("_n") > months + more)).select("fuel", "date")


def errors(test: DataFrame, keys: Sequence[str] = ("fuel",)) -> DataFrame:
    """Absolute and squared errors of relative and of relative less structural_premium, and what the model gains."""
    y, e = F.col("relative"), F.col("relative") - F.col("structural_premium")
    out = test.groupBy(*keys).agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count("*").alias("n_test"),
        F.avg(F.abs(y)).alias("mae_baseline"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(y * y)).alias("rmse_baseline"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )
    return out.withColumns({f"{m}_gain_pct": 100 * (1 - F.try_divide(F.col(m), F.col(f"{m}_baseline"))) for m in ("mae", "rmse")})


def split(panel: DataFrame, test_dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the fuels that ``test_dates`` (fuel, date) names."""
    test = panel.join(test_dates, ["fuel", "date"], "left_semi")
    train = panel.join(test_dates.select("fuel").distinct(), "fuel", "left_semi").join(test_dates, ["fuel", "date"], "left_anti")
    return train, test


def validate(panel: DataFrame, months: int = 3, factors: Sequence[str] | None = None, **how) -> DataFrame:
    """The errors on each fuel's last ``months`` dates of a model of those before. Fuels with fewer than four dates
    before are left out."""
    panel = written(panel)
    train, test = split(panel, written(last_dates(panel, months, 3)))
    return errors(predict(test, fit(train, factors, with_bias=False, **how)))


def regimes(panel: DataFrame, shock: str, pre: int = 3, onset: int = 4, current: int = 3, **how) -> DataFrame:
    """The errors on three stretches of time around a shock, each of a model of all that came before; one fit for all."""
    day, panel = F.lit(shock).cast("date"), written(panel)
    w = Window.partitionBy("fuel", "post")
    dates = panel.select("fuel", "date").distinct().withColumn("post", F.col("date") >= day)
    dates = dates.withColumns({"from_end": F.row_number().over(w.orderBy(F.col("date").desc())), "k": F.row_number().over(w.orderBy("date")), "n": F.count("*").over(w)})
    post, k = F.col("post"), F.col("k")
    named = F.when(~post & (F.col("from_end") <= pre) & (F.col("n") > pre), "PRE_SHOCK").when(post & (k <= onset), "SHOCK_ONSET").when(post & (k <= onset + current), "CURRENT_REGIME")
    chosen = written(dates.select("fuel", "date", named.alias("split")).filter("split IS NOT NULL"))  # dates, not rows
    first = chosen.groupBy("fuel", "split").agg(F.min("date").alias("_first"))
    # the splits that a date is trained in: dates are few, so they go out to the rows
    into = dates.join(first, "fuel").filter(F.col("date") < F.col("_first"))
    into = written(into.groupBy("fuel", "date").agg(F.collect_set("split").alias("_splits")))
    train = panel.join(F.broadcast(into), ["fuel", "date"])
    seen = F.broadcast(into.select("fuel", F.explode("_splits").alias("split")).distinct())
    test = panel.join(F.broadcast(chosen), ["fuel", "date"]).join(seen, ["fuel", "split"], "left_semi")
    model = fit(train, with_bias=False, fold="split", folds=F.col("_splits"), **how)
    return errors(predict(test, model), ("split", "fuel"))


def ablation(panel: DataFrame, order: Sequence[str], months: int = 3, **how) -> DataFrame:
    """The errors with none of the factors, the first, the first two ... of ``order``; one fit for all of these steps."""
    panel = written(panel)
    train, test = split(panel, written(last_dates(panel, months, 3)))
    sets = {k: tuple(order[:k]) for k in range(len(order) + 1)}
    steps = F.array(*map(F.lit, sets))
    model = fit(train, sets, with_bias=False, fold="step", folds=steps, **how)
    test = predict(test.select("*", F.explode(steps).alias("step")), model)
    test = test.withColumn("structural_premium", F.when(F.col("step") == 0, 0.0).otherwise(F.col("structural_premium")))
    names = F.element_at(F.array(*[F.lit("+".join(v)) for v in sets.values()]), F.col("step") + 1)
    return errors(test, ("step", "fuel")).withColumn("factors", names)
