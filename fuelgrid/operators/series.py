"""Ordered operators over series: fills, rolling statistics, as-of and interval joins, snapshots, chained indices.

Each works by one shuffle on the series' key. None pairs rows of a key with one another. A key's series is one task's, a
sorted stream that can spill, so keys should be series, not classes.

Cases: null keys are a key; rows without a date come first in their series and never match another's date; an empty
table gives an empty result; repeated rows stay. Helpers' columns take names that the input doesn't use; a column that has an
output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuelgrid.operators.robust import _apart, group_medians, joined
from fuelgrid.storage import written


def _order(keys: Sequence[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(l, r): each left row, whole, with each right row of its keys, or NULL; null keys meet. A table's columns stay in a
    struct of their own, so none of their names can clash."""
    own = lambda df, side: df.select(F.struct("*").alias(side), *[F.col(f"`{k}`").alias(f"{side}{i}") for i, k in enumerate(keys)])
    a, b = own(left, "l"), own(right, "r")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & a[f"l{i}"].eqNullSafe(b[f"r{i}"])
    return a.join(b, on, "left").select("l", "r")


def densify(df: DataFrame, keys: Sequence[str], date: str, step: str = "1 day") -> DataFrame:
    """A row for each date from a key's first to its last; other columns are NULL where the input has none."""
    ends = df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min(f"`{date}`").alias("a"), F.max(f"`{date}`").alias("b"))
    every = ends.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(date))
    both = _beside(every, df, [*keys, date])
    return both.select(*[F.col("l")[c].alias(c) for c in (*keys, date)], *[F.col("r")[c].alias(c) for c in df.columns if c not in (*keys, date)])


def month_ends(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH")), lambda d: F.last_day(d))


def fridays(first: Column, last: Column) -> Column:
    """Every Friday from ``first`` to ``last``."""
    start = F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)).cast("int"))
    return F.when(start <= last, F.sequence(start, last, F.expr("INTERVAL 7 DAY"))).otherwise(F.array().cast("array<date>"))


def month_starts(first: Column, last: Column) -> Column:
    """The first days of the months whose first day lies from ``first`` to ``last``."""
    every = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    return F.filter(every, lambda d: d >= first)


def forward_fill(df: DataFrame, keys: Sequence[str], date: str, value: str, limit: int | None = None) -> DataFrame:
    """``value`` carried forward, over ``limit`` rows at most, and <value>_date, the date it was observed."""
    w = _order(keys, date).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    return df.withColumns({f"{value}_date": F.last(seen, True).over(w), value: F.last(value, True).over(w)})


def rolling_mean(df: DataFrame, keys: Sequence[str], date: str, value: str, widths: Sequence[int]) -> DataFrame:
    return df.withColumns({f"{value}_ma{n}": F.avg(value).over(_order(keys, date).rowsBetween(1 - n, 0)) for n in widths})


def lagged_median(df: DataFrame, keys: Sequence[str], date: str, value: str, out: str, width: int = 12, least: int = 3, otherwise: Column | None = None) -> DataFrame:
    """The median of the ``width`` rows before, if they hold ``least`` values, else another."""
    w = _order(keys, date).rowsBetween(-width, -1)
    m = F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))
    return df.withColumn(out, m if otherwise is None else F.coalesce(m, otherwise))


def log_return(df: DataFrame, keys: Sequence[str], date: str, value: str, out: str = "log_return") -> DataFrame:
    return df.withColumn(out, F.ln(value) - F.lag(F.ln(value)).over(_order(keys, date)))


def rebased(df: DataFrame, keys: Sequence[str], date: str, value: str, out: str, base: float = 100.0) -> DataFrame:
    whole = _order(keys, date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, base * F.col(value) / F.first(value, True).over(whole))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, tolerance_days: int | None = None) -> DataFrame:
    """Each left row with right's last row of its keys at or before it, or NULLs; further back than the tolerance too.

    The sides are stacked and right's last row is carried along the order: linear, with one shuffle. Right must have
    one row for each key and time. Right's columns other than the keys are added under their own names.
    """
    extra = [c for c in right.columns if c not in keys]
    plain = [c for c in left.columns if c not in keys]
    names = [f"k{i}" for i in range(len(keys))]
    own = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    fields = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    none = lambda df, columns: F.lit(None).cast(df.select(fields(columns)).schema[0].dataType)
    a = left.select(*own(left), F.col(f"`{left_on}`").alias("t"), F.lit(1).alias("side"), fields(plain).alias("l"), none(right, extra).alias("r"))
    b = right.select(*own(right), F.col(f"`{right_on}`").alias("t"), F.lit(0).alias("side"), none(left, plain).alias("l"), fields(extra).alias("r"))
    w = Window.partitionBy(*names).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.union(b.filter("t IS NOT NULL")).withColumn("r", F.last("r", True).over(w)).filter("side = 1")
    if tolerance_days is not None:
        out = out.withColumn("r", F.when(F.datediff("t", F.col("r")[right_on]) <= tolerance_days, F.col("r")))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[F.col("l")[c].alias(c) for c in plain], *[F.col("r")[c].alias(c) for c in extra])


def effective(df: DataFrame, table: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """``df`` with the one row of an effective-dated table (effective_from, effective_to or NULL) that holds at its
    date. Fails where none or several do.

    A sweep: each row of the table opens at its first day and closes after its last; along a key's days the number of open
    rows is a running sum, and where it is one, the running exclusive or of their numbers is the open row's. It runs over a
    key's different days alone, so no schedule, however long, is held or compared with dates, and it may overlap and nest.
    """
    names = [f"k{i}" for i in range(len(keys))]
    own = lambda d: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    rest = [c for c in table.columns if c not in keys]
    spans = table.select(*own(table), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("span"), F.monotonically_increasing_id().alias("id"))
    spans = written(spans)  # so that a row's number stays
    first, last = F.to_date("span.effective_from"), F.to_date("span.effective_to")
    spans_on = spans.filter(first.isNotNull() & (last.isNull() | (first <= last)))
    opens = spans_on.select(*names, first.alias("t"), F.lit(0).alias("side"), F.lit(1).alias("d"), "id")
    closes = spans_on.filter(last.isNotNull()).select(*names, F.date_add(last, 1).alias("t"), F.lit(0).alias("side"), F.lit(-1).alias("d"), "id")
    days = df.select(*own(df), F.to_date(F.col(f"`{date}`")).alias("t")).distinct()
    w = Window.partitionBy(*names).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    swept = opens.union(closes).union(days.select(*names, "t", F.lit(1), F.lit(0), F.lit(0).cast("long")))
    swept = swept.withColumns({"n": F.sum("d").over(w), "open": F.bit_xor("id").over(w)}).filter("side = 1")
    one = F.when(F.col("n") == 1, F.col("open")).otherwise(F.raise_error(F.lit("not exactly one effective row")).cast("long"))
    held = swept.select(*names, "t", one.alias("id")).join(spans.select("id", "span"), "id")
    found, day = _apart(df, "_found", "_day")
    at = held.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("t").alias(day), "span")
    out = joined(df.withColumn(day, F.to_date(F.col(f"`{date}`"))), at, [*keys, day], **{found: "span"})
    return out.select(*df.columns, *[F.col(found)[c].alias(c) for c in rest])


def snapshots(log: DataFrame, keys: Sequence[str], time: str, every: str, max_age_days: int, tie: str | None = None, last: str | None = None) -> DataFrame:
    """(log's columns, date, age_days): at the end of each cut-off date, each key's last row, if it isn't too old.

    Cut-offs are every "day" or "month" end, up to ``last`` if given. A row is shown at those between it and its key's
    next row, so nothing is compared with each cut-off.
    """
    order = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else []))
    day = F.to_date(time)
    stops = [F.coalesce(F.date_sub(F.to_date(F.lead(time).over(order)), 1), F.date_add(day, max_age_days)), F.date_add(day, max_age_days)]
    to = _apart(log, "_to")[0]
    df = log.withColumn(to, F.least(*stops, *([F.lit(last).cast("date")] if last else [])))
    dates = F.sequence(day, to) if every == "day" else F.filter(month_ends(day, F.col(to)), lambda d: (d >= day) & (d <= F.col(to)))
    df = df.filter(F.col(to) >= day).withColumn("date", F.explode(dates))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    df = df.withColumn("age_days", (micros(F.date_add("date", 1)) - 1 - micros(F.col(time))) / 86400e6)
    return df.filter(F.col("age_days") <= max_age_days).drop(to)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; rows that tie are told apart by their other columns, which must sort."""
    rest = [c for c in df.columns if c not in keys]
    by = [*order, *[c for c in rest if c not in order]]
    row = _apart(df, "_row")[0]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias(row)).select(*keys, f"{row}.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by name; where both have a key, the new one."""
    mark = _apart(old.join(new.limit(0), list(keys), "left"), "_new")[0]
    both = old.withColumn(mark, F.lit(0)).unionByName(new.withColumn(mark, F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [mark]).drop(mark)


def overwritten(df: DataFrame, live: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with the live values where there are any; source says which."""
    both, old, new = _beside(df, live.select(*keys, *columns), keys), F.col("l"), F.col("r")
    any_live = F.coalesce(*[new[c].isNotNull() for c in columns], F.lit(False))
    rest = [F.coalesce(new[c], old[c]).alias(c) if c in columns else old[c].alias(c) for c in df.columns if c != "source"]
    return both.select(*rest, F.when(F.coalesce(any_live, F.lit(False)), "LIVE").otherwise("HISTORY").alias("source"))


def carried(log: DataFrame, keys: Sequence[str], time: str, start: str, tie: str) -> DataFrame:
    """Rows from ``start`` on, and each key's last row before it."""
    at = F.lit(start).cast("timestamp_ntz")
    return latest(log.filter(F.col(time) < at), keys, [time, tie]).unionByName(log.filter(F.col(time) >= at))


def chained_index(prices: DataFrame, group: str, unit: str, date: str, value: str, base: float = 100.0, least: int = 30, sure: float = 0.7) -> DataFrame:
    """(group, date, median, index, change_pct, n_units, n_matched, matched_share, method, confidence): ``base`` times
    the running product of the growth between successive dates.

    Growth is the median of the ratios of the units that both dates have, if there are ``least`` of them (confidence
    HIGH if they are ``sure`` of the smaller date's units or more, else MEDIUM); else the ratio of the two dates'
    medians, with LOW confidence, or 1 where the earlier one isn't positive. The first date is the base. ``prices`` has one
    row for each unit and date.
    """
    names = {group: "g", unit: "u", date: "d", value: "v"}
    p = prices.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    dates = joined(p.groupBy("g", "d").agg(F.count_distinct("u").alias("n")), group_medians(p, "v", ["g", "d"]), ["g", "d"], m="median")
    w = Window.partitionBy("g").orderBy("d")
    dates = dates.withColumns({"k": F.row_number().over(w), "m_was": F.lag("m").over(w), "n_was": F.lag("n").over(w), "d_was": F.lag("d").over(w)})
    before = joined(p, dates, ["g", "d"], d_was="d_was").filter("d_was IS NOT NULL")
    was = p.select(F.col("g").alias("g2"), F.col("u").alias("u2"), F.col("d").alias("d2"), F.col("v").alias("v_was"))
    both = before.join(was, before["g"].eqNullSafe(was["g2"]) & (before["u"] == was["u2"]) & (before["d_was"] == was["d2"]))
    both = both.filter((F.col("v_was") > 0) & F.col("v").isNotNull()).withColumn("ratio", F.col("v") / F.col("v_was"))
    matched = both.groupBy("g", "d").agg(F.count("*").alias("matched"))
    out = joined(joined(dates, matched, ["g", "d"], matched="matched"), group_medians(both, "ratio", ["g", "d"]), ["g", "d"], ratio="median")
    first = F.col("k") == 1
    n = F.when(~first, F.coalesce("matched", F.lit(0)))
    enough = n >= least
    plain = F.when(F.col("m_was") > 0, F.col("m") / F.col("m_was")).otherwise(1.0)
    share = n / F.greatest(F.least("n", "n_was"), F.lit(1))
    growth = F.when(first, 1.0).when(enough, F.col("ratio")).otherwise(plain)
    out = out.withColumns({"n_matched": n, "matched_share": share, "growth": growth})
    run = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        F.col("g").alias(group),
        F.col("d").alias(date),
        F.col("m").alias("median"),
        (F.lit(base) * F.product("growth").over(run)).alias("index"),
        (100 * (F.col("growth") - 1)).alias("change_pct"),
        F.col("n").alias("n_units"),
        F.col("n_matched").cast("long").alias("n_matched"),
        "matched_share",
        F.when(first, "BASE").when(enough, "MATCHED_STATIONS").otherwise("MEDIAN_FALLBACK").alias("method"),
        F.when(first, "HIGH").when(~enough, "LOW").when(share >= sure, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def anchored(targets: DataFrame, anchors: DataFrame, proxy: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Targets with anchor_date, anchor_quote, quote and quote_source, from anchors (date, quote) and a proxy series
    (proxy_date, proxy).

    An anchor is stated for the month of its date; effective_date, if the table has it and it isn't NULL, is the day that
    its quote holds for. The last anchor stated for the target's month is taken as it is (SAME_MONTH). Else the last that
    is effective at the target (ANCHORED), or else the first of all (BACKCAST), is moved by the proxy's ratio between the
    target and the anchor's effective date; days without a proxy value are passed over. Without anchors, a proxy series, or
    values for the ratio, the quote is NULL (UNAVAILABLE). anchor_date is the effective date.
    """
    names = [f"k{i}" for i in range(len(keys))]
    own = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    stated = F.to_date("date")
    holds = F.coalesce(F.to_date("effective_date"), stated) if "effective_date" in anchors.columns else stated
    a = anchors.select(*own(anchors), F.trunc(stated, "MM").alias("month"), F.struct(holds.alias("at"), stated.alias("stated"), F.col("quote").cast("double").alias("quote")).alias("anchor"))
    by_month = a.groupBy(*names, "month").agg(F.max("anchor").alias("own"))
    firsts = a.groupBy(*names).agg(F.min(F.struct("anchor.at", "anchor.stated", "anchor.quote")).alias("first"))
    past = a.groupBy(*names, F.col("anchor.at").alias("at")).agg(F.max("anchor").alias("past"))
    p = proxy.select(*own(proxy), F.to_date("proxy_date").alias("p_date"), F.col("proxy").cast("double").alias("p"))
    there = p.select(*names, F.lit(True).alias("there")).distinct()
    p = p.filter("p IS NOT NULL")
    t = targets.select(F.struct("*").alias("row"), *own(targets), F.to_date(F.col(f"`{date}`")).alias("day"))
    t = joined(t.withColumn("month", F.trunc("day", "MM")), by_month, [*names, "month"], own="own")
    t = joined(joined(t, firsts, names, first="first"), there, names, there="there")
    t = asof(t, past, names, "day", "at")
    t = t.withColumn("anchor", F.when(F.col("there"), F.coalesce("own", "past", "first"))).withColumn("anchor_date", F.col("anchor.at"))
    t = asof(t, p.withColumnsRenamed({"p_date": "d1", "p": "p1"}), names, "day", "d1")
    t = asof(t, p.withColumnsRenamed({"p_date": "d2", "p": "p2"}), names, "anchor_date", "d2")
    same = F.col("there") & F.col("own").isNotNull()
    quote = F.when(same, F.col("own.quote")).when(F.col("p2") > 0, F.col("anchor.quote") * F.col("p1") / F.col("p2"))
    source = F.when(same, "SAME_MONTH").when(quote.isNull(), "UNAVAILABLE").when(F.col("past").isNotNull(), "ANCHORED").otherwise("BACKCAST")
    rest = [F.col("row")[c].alias(c) for c in targets.columns if c not in ("anchor_date", "anchor_quote", "quote", "quote_source")]
    return t.select(*rest, "anchor_date", F.col("anchor.quote").alias("anchor_quote"), quote.alias("quote"), source.alias("quote_source"))
