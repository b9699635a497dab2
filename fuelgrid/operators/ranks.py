"""Values at given ranks of each group, whatever a group's size: exact medians without a task that holds a group.

Groups of up to ``WHOLE`` rows are one task's work: the counts of their different values, formed on every task first.
Larger ones are narrowed down, all together, a round at a time. A round takes evenly spaced quantiles of what is left of a
group from a mergeable sketch, picks two of them around the ranks, and counts exactly what lies below, at, between and above
these two; what is left is what the ranks can lie in. The sketch only proposes; the counts decide, so the result is exact,
and since the proposed values themselves are counted apart, ties of any size don't hold a group back. When at most ``WHOLE``
rows are left strictly between two values, their values are counted and sorted. A round reads the rows twice and shuffles a
row for each group and task.

Where the caller knows how many rows there are at most, few enough for one task, nothing is counted and the result is a plan
like any other. Else the rows are written, and counted by that.

Cases: null keys are a group. Null values are left out (``medians`` gives NULL where nothing else is there). NaN is the
greatest value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuelgrid.storage import counted, written

#: Rows of one group that a task may hold; quantiles that a sketch gives, and its accuracy.
WHOLE, GRID, ACCURACY = 1 << 18, 256, 2048


def _met(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str, *columns: str) -> DataFrame:
    """``df`` joined to ``groups`` by equal keys, nulls met, with some of its columns.

    ``groups`` have more than ``WHOLE`` rows each, so they are few and go out to all tasks. Spark would else choose by files'
    size, and the rows' file may be the smaller one: values that repeat take next to nothing there, and all in memory."""
    right = F.broadcast(groups.select(*[F.col(k).alias(f"{k}_r") for k in keys], *columns))
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(right[f"{k}_r"])
    if not keys and how != "inner":
        raise ValueError("without keys there is one group")
    return df.crossJoin(right) if not keys else df.join(right, on, how).drop(*[f"{k}_r" for k in keys])


def _parts(rows: DataFrame, keys: Sequence[str], at_most: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups that a task may hold, rows of larger ones); None where there are none."""
    if at_most is None or at_most > WHOLE:
        rows, at_most = counted(rows)
    if at_most <= WHOLE:
        return rows, None
    large = written(rows.groupBy(*keys).agg(F.count("v").alias("n")).filter(F.col("n") > WHOLE))
    if large.isEmpty():
        return rows, None
    return (_met(rows, large, keys, "left_anti"), _met(rows, large, keys, "left_semi")) if keys else (None, rows)


def _counted(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """``at_ranks`` of groups that a task may hold each."""
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    counts = counts.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("v"))})
    picked = [F.min(F.when(F.col("upto") > r, F.struct("v"))).getField("v").alias(f"r{i}") for i, r in enumerate(ranks(F.col("n")))]
    return counts.groupBy(*keys).agg(F.first("n").alias("n"), *picked)


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """The next state of groups: between which two values the ranks lie, and how many rows are below, at and between."""
    known = ["n", "lo", "hi", "below", "at_lo", "between"]
    inner = _met(rows, state, keys, "inner", *known).filter((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q")
    sketch = inner.groupBy(*keys).agg(grid)
    wanted = ranks(F.col("n"))
    first, last = wanted[0], wanted[-1]
    start = F.col("below") + F.col("at_lo")
    spot = lambda r: F.least(F.greatest((r - start) / F.col("between") * GRID, F.lit(0)), F.lit(GRID))
    cuts = _met(state, sketch, keys, "inner", "q").withColumns({
        "x": F.get("q", F.greatest(F.floor(spot(first)) - 1, F.lit(0)).cast("int")),
        "y": F.get("q", F.least(F.ceil(spot(last + 1)) + 1, F.lit(GRID)).cast("int")),
    }).drop("q")
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    near = _met(rows, cuts, keys, "inner", *known, "x", "y").filter((v > F.col("lo")) & (v < F.col("hi")))
    count = {"a": v < x, "b": v == x, "c": (v > x) & (v < y), "d": (v == y) & (y > x)}
    got = near.groupBy(*keys, *known, "x", "y").agg(*[F.count_if(c).alias(k) for k, c in count.items()])
    c = {k: F.col(k) for k in (*known, *count)}
    starts = [c["below"], c["below"] + c["at_lo"] + c["a"], c["below"] + c["at_lo"] + c["a"] + c["b"] + c["c"], c["below"] + c["at_lo"] + c["between"]]
    ends = [c["below"] + c["at_lo"], starts[1] + c["b"], starts[2] + c["d"]]
    values, sizes = [c["lo"], x, y, c["hi"]], [c["at_lo"], c["b"], c["d"], F.lit(0)]
    pick = lambda of: F.when(first >= starts[3], of[3]).when(first >= starts[2], of[2]).when(first >= starts[1], of[1]).otherwise(of[0])
    until = lambda of: F.when(last < ends[0], of[0]).when(last < ends[1], of[1]).when(last < ends[2], of[2]).otherwise(of[3])
    lo, at_lo, below = pick(values), pick(sizes), pick(starts)
    return got.select(*keys, "n", lo.alias("lo"), until(values).alias("hi"), below.alias("below"), at_lo.alias("at_lo"), F.greatest(until(starts) - below - at_lo, F.lit(0)).alias("between"))


def _selected(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """``at_ranks`` of groups of any size."""
    least, most = F.lit(float("-inf")), F.lit(float("nan"))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("v") == least).alias("at_lo"), F.count_if(F.isnan("v")).alias("nan"))
    state = state.select(*keys, "n", least.alias("lo"), most.alias("hi"), F.lit(0).cast("long").alias("below"), "at_lo", (F.col("n") - F.col("at_lo") - F.col("nan")).alias("between"))
    ready = None
    while True:
        state = written(state)
        small = state.filter(F.col("between") <= WHOLE)
        ready = small if ready is None else ready.union(small)
        state = state.filter(F.col("between") > WHOLE)
        if state.isEmpty():
            break
        state = _narrowed(rows, state, keys, ranks)
    inside = _met(rows, ready, keys, "inner", "n", "lo", "hi", "below").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counts = inside.groupBy(*keys, "n", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    picked = [F.min(F.when(F.col("upto") > r, F.struct("v"))).getField("v").alias(f"r{i}") for i, r in enumerate(ranks(F.col("n")))]
    return counts.withColumn("upto", upto).groupBy(*keys).agg(F.first("n").alias("n"), *picked)


def _both(rows: DataFrame, keys: Sequence[str], at_most: int | None, small: Callable, large: Callable) -> DataFrame:
    few, many = _parts(rows, keys, at_most)
    if many is None:
        return small(few)
    return large(many) if few is None else large(many).union(small(few))


def at_ranks(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column], list[Column]], at_most: int | None = None) -> DataFrame:
    """(keys, n, r0, r1 ...) of ``rows`` (keys, v): each group's size, and its values at the ranks that ``ranks`` gives for
    a size, counted from 0, in ascending order; NULL for ranks beyond the group. ``at_most``: rows that there can be."""
    return _both(rows.filter("v IS NOT NULL"), keys, at_most, lambda df: _counted(df, keys, ranks), lambda df: _selected(df, keys, ranks))


def middle(n: Column) -> list[Column]:
    return [F.floor((n - 1) / 2), F.floor(n / 2)]


def medians(rows: DataFrame, keys: Sequence[str], at_most: int | None = None) -> DataFrame:
    """(keys, median) of ``rows`` (keys, v), for every group. ``at_most``: rows that there can be."""

    def small(df: DataFrame) -> DataFrame:
        counts = df.groupBy(*keys, "v").agg(F.count("*").alias("n"))
        return counts.groupBy(*keys).agg(F.percentile("v", 0.5, F.col("n")).alias("median"))

    def large(df: DataFrame) -> DataFrame:
        a, b = F.col("r0"), F.col("r1")
        return _selected(df.filter("v IS NOT NULL"), keys, middle).select(*keys, F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias("median"))

    return _both(rows, keys, at_most, small, large)
