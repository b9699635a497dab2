"""Medians and what is built of them: robust scores, shrunk group effects, backfitting of additive effects.

Medians are those of ``ranks``: exact, and no task holds a large group's rows. The table of groups is then joined back, which
is Spark's to plan: adaptive execution broadcasts it if its measured size allows, else shuffles and splits skewed keys.

Cases: null keys are a group of their own. Null values have no part in a median and get a null score (0 without a
floor); a group without values has the median NULL. Columns of the input keep their values whatever their names, but
for the output's own name, which is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelgrid.functions.scalars import MAD_TO_SIGMA
from fuelgrid.operators import ranks
from fuelgrid.storage import counted, written


def _apart(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def _narrow(df: DataFrame, value: Column | str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(k0, k1 ..., v) of ``df``, and the names of the keys."""
    v = F.col(f"`{value}`") if isinstance(value, str) else value
    names = [f"k{i}" for i in range(len(keys))]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], v.cast("double").alias("v")), names


def group_medians(df: DataFrame, value: Column | str, keys: Sequence[str], at_most: int | None = None) -> DataFrame:
    """(keys, median) of each group. ``at_most``: rows that there can be, if that is known."""
    rows, names = _narrow(df, value, keys)
    return ranks.medians(rows, names, at_most).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "median")


def _sized(groups: DataFrame, at_most: int | None) -> DataFrame:
    """A table of groups that is joined to many rows, written: by its known size the rows needn't be dealt by group first."""
    return groups if at_most is not None and at_most <= ranks.WHOLE else written(groups)


def joined(df: DataFrame, groups: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """``df`` with columns of its group (new name = column of ``groups``), null keys met."""
    if not keys:
        return df.crossJoin(groups.select(*[F.col(c).alias(n) for n, c in columns.items()]))  # one row
    right = [f"_key{i}" for i in range(len(keys))]
    right = _apart(df, *right)
    g = groups.select(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys, right)], *[F.col(c).alias(n) for n, c in columns.items()])
    on = [df[f"`{k}`"].eqNullSafe(g[r]) for k, r in zip(keys, right)]
    return df.join(g, on, "left").drop(*right)


def matched(df: DataFrame, rows: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """``joined`` to a table of as many rows as ``df``: a small file may hold more of them than a driver can broadcast."""
    return joined(df, rows.hint("merge"), keys, **columns)


def group_median(df: DataFrame, value: str, keys: Sequence[str], out: str, at_most: int | None = None) -> DataFrame:
    """Each row with its group's median."""
    return joined(df.drop(out) if out in df.columns else df, _sized(group_medians(df, value, keys, at_most), at_most), keys, **{out: "median"})


def mad(df: DataFrame, value: str, keys: Sequence[str], at_most: int | None = None) -> DataFrame:
    """(keys, median, mad) of each group."""
    rows, names = _narrow(df, value, keys)
    if at_most is None:
        rows, at_most = counted(rows)
    away = joined(rows, _sized(ranks.medians(rows, names, at_most), at_most), names, m="median").withColumn("v", F.abs(F.col("v") - F.col("m")))
    out = ranks.medians(away, [*names, "m"], at_most)  # a group has one median
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("m").alias("median"), F.col("median").alias("mad"))


def robust_z(df: DataFrame, value: str, keys: Sequence[str], out: str = "z", floor: float | None = None, at_most: int | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD). Without ``floor`` a scale of 0 or NULL gives 0, for null values too; with it the
    scale is ``floor`` at least."""
    m, s = _apart(df, "_median", "_mad")
    df = joined(df, _sized(mad(df, value, keys, at_most), at_most), keys, **{m: "median", s: "mad"})
    scale, off = MAD_TO_SIGMA * F.col(s), F.col(f"`{value}`") - F.col(m)
    z = F.when(scale > 0, off / scale).otherwise(0.0) if floor is None else off / F.greatest(scale, F.lit(floor))
    return df.withColumn(out, z).drop(m, s)


def trimming(df: DataFrame, score: str, limit: float, keys: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """What ``trimmed`` does to ``df`` or a part of it. The groups are a table of known size, so rows needn't be dealt by group."""
    near = F.coalesce(F.abs(F.col(f"`{score}`")) <= limit, F.lit(False))
    some = _apart(df, "_some")[0]
    groups = written(df.groupBy(*keys).agg(F.max(near).alias("some")))
    return lambda rows: joined(rows, groups, keys, **{some: "some"}).filter(near | ~F.col(some)).drop(some)


def trimmed(df: DataFrame, score: str, limit: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with |score| <= limit; all rows of a group that would be left without any."""
    return trimming(df, score, limit, keys)(df)


def shrunk_effect(df: DataFrame, value: Column, keys: Sequence[str], shrink: float, unit: str | None = None) -> DataFrame:
    """(keys, effect, n_obs, n_units): the group's median, drawn to 0 by n / (n + shrink).

    n is the rows with a value or, given a ``unit``, the distinct units; then the median is that of the units' medians.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], value.cast("double").alias("v"), *([F.col(f"`{unit}`").alias("u")] if unit else []))
    if unit is None:
        rows, n = counted(rows)
        sizes = rows.groupBy(*names).agg(F.count("v").alias("n_obs")).withColumn("n_units", F.col("n_obs"))
    else:
        rows, n = counted(rows.filter("v IS NOT NULL").groupBy(*names, "u").agg(F.median("v").alias("v"), F.count("*").alias("n")))  # a unit's own rows are few
        sizes = rows.groupBy(*names).agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_units"))
    out = joined(sizes, ranks.medians(rows.select(*names, "v"), names, n), names, m="median")
    effect = F.col("m") * F.col("n_units") / (F.col("n_units") + F.lit(float(shrink)))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_obs", "n_units", effect.alias("effect"))


#: Levels of all factors and groups that backfitting keeps on the driver; beyond, they are a table that each step joins.
LEVELS_ON_DRIVER = 20_000


def _array(values: Sequence[float | None]) -> Column:
    """A constant array: one object to Spark, so that a step's code is that of the step before."""
    return F.lit(np.array([0.0 if x is None else x for x in values], np.float64))


def backfit(df: DataFrame, value: str, group: str | Sequence[str], factors: dict[str, float], rounds: int, unit: str | None = None, adjust: dict[str, Callable[[DataFrame], DataFrame]] | None = None, active: dict[str, Column] | None = None, spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, factor, level, effect, n_obs, n_units): additive effects of each factor on ``value``, by median
    backfitting; a null level is UNKNOWN.

    Factors are taken in order and ``factors`` gives each one's shrinkage. A step subtracts the others' effects and
    re-estimates one factor for all groups at once. Groups may differ in their factors: ``active`` says, by a condition on
    the group's columns, where a factor counts. So many models, of folds of the data or of sets of factors, are fitted in
    the steps of one. ``adjust`` may change the effects of a factor, a table (group, level, effect, n_obs, n_units), after
    each of its steps, and add columns. ``spread`` makes the rows of the groups from those of ``df``, as where a row is in
    many folds; rows are then dealt to tasks before they are spread.

    The rows are reduced once to the combinations of levels (and unit) and the counts of their different values. Levels are
    numbered; their effects, a number each and ``LEVELS_ON_DRIVER`` at most, go out with a step's only job as arrays of
    constants, so a step joins nothing and reads what is left of the rows once. Where units are given, the rows stand by
    unit, and a step shuffles nothing but medians of units. Levels beyond what a task may hold are left to ``ranks``.
    """
    keys = [group] if isinstance(group, str) else list(group)
    adjust, active = adjust or {}, active or {}
    if not factors or not rounds:
        return df.select(*[F.col(f"`{k}`") for k in keys]).limit(0).selectExpr("*", "'' factor", "'' level", "0D effect", "0L n_obs", "0L n_units")
    g, names, spread = [f"g{i}" for i in range(len(keys))], {f: f"f{i}" for i, f in enumerate(factors)}, spread or (lambda rows: rows)

    def narrow(rows: DataFrame) -> DataFrame:
        return spread(rows.filter(F.col(f"`{value}`").isNotNull())).select(
            *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, g)], F.col(f"`{value}`").cast("double").alias("v"), *([F.col(f"`{unit}`").alias("u")] if unit else []),
            *[F.when(active.get(f, F.lit(True)), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("UNKNOWN"))).alias(n) for f, n in names.items()],
        )

    by = [*g, *names.values(), *(["u"] if unit else []), "v"]
    every = narrow(df).groupBy(*g, *names.values()).agg(F.count("*").alias("n"))
    every = every.select(*g, "n", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("level")) for i, n in enumerate(names.values())])).alias("x"))
    levels = every.select(*g, "x.f", "x.level", "n").filter("level IS NOT NULL").groupBy(*g, "f", "level").agg(F.sum("n").alias("rows"))
    table = levels.take(LEVELS_ON_DRIVER + 1)
    if len(table) > LEVELS_ON_DRIVER:
        work = written(narrow(df).groupBy(*by).agg(F.count("*").alias("n")))
        return _backfit_by_tables(work, g, keys, names, factors, rounds, unit, adjust)
    table = sorted(table, key=lambda r: (r["f"], r["level"], str(r[:-3])))
    shape = ", ".join(f"{n} {levels.schema[n].dataType.simpleString()}" for n in g)
    work = narrow(df.repartition(F.col(f"`{unit}`")) if unit else df)
    for i, (f, n) in enumerate(names.items()):
        mine = [r for r in table if r["f"] == i]
        numbers = df.sparkSession.createDataFrame([(*r[: len(g)], r["level"], k) for k, r in enumerate(mine)], f"{shape}, {n} string, i{i} int")
        work = joined(work, F.broadcast(numbers), [*g, n], **{f"i{i}": f"i{i}"}).drop(n)  # LEVELS_ON_DRIVER bounds it
    # by unit, all of a combination's rows are in one task already
    work = work.groupBy(*[f"i{i}" for i in range(len(names))], *(["u"] if unit else []), "v").agg(F.count("*").alias("n")).persist()
    effects: dict[int, list] = {}
    n_of: dict[int, list] = {}
    more: dict[int, list] = {}
    for _ in range(rounds):
        for i, (f, shrink) in enumerate(factors.items()):
            mine = [r for r in table if r["f"] == i]
            rest = F.col("v")
            for j, known in effects.items():
                if j != i:
                    rest = rest - F.coalesce(F.get(_array(known), F.col(f"i{j}")), F.lit(0.0))
            left = work.filter(F.col(f"i{i}").isNotNull()).select(F.col(f"i{i}").alias("k"), *(["u"] if unit else []), rest.alias("v"), "n")
            if unit:
                left = left.groupBy("k", "u").agg(F.percentile("v", 0.5, F.col("n")).alias("v"), F.sum("n").alias("rows"))
                sizes = [F.sum("rows").alias("n_obs"), F.count("*").alias("n_units")]
            else:
                sizes = [F.sum("n").alias("n_obs"), F.sum("n").alias("n_units")]
            if max((r["rows"] for r in mine), default=0) <= ranks.WHOLE:
                middle = F.percentile("v", 0.5) if unit else F.percentile("v", 0.5, F.col("n"))
                got = left.groupBy("k").agg(middle.alias("m"), *sizes)
            else:  # each value as often as it counts, ranked without holding a level
                flat = left.select("k", "v") if unit else left.select("k", "v", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("k", "v")
                got = joined(left.groupBy("k").agg(*sizes), ranks.medians(flat, ["k"]), ["k"], m="median")
            new, n_new, m_new = [None] * len(mine), [(0, 0)] * len(mine), [{}] * len(mine)
            for r in got.collect():  # a row for each level
                new[r["k"]], n_new[r["k"]] = r["m"] * r["n_units"] / (r["n_units"] + float(shrink)), (r["n_obs"], r["n_units"])
            if f in adjust:
                own = ", ".join(f"`{c}` {levels.schema[n].dataType.simpleString()}" for c, n in zip(keys, g))
                frame = df.sparkSession.createDataFrame([(k, *r[: len(g)], r["level"], new[k], *n_new[k]) for k, r in enumerate(mine)], f"_k int, {own}, level string, effect double, n_obs long, n_units long")
                for r in adjust[f](frame).collect():
                    new[r["_k"]] = r["effect"]
                    m_new[r["_k"]] = {c: v for c, v in r.asDict().items() if c not in {"_k", *keys, "level", "effect", "n_obs", "n_units"}}
            effects[i], n_of[i], more[i] = new, n_new, m_new
    work.unpersist()
    extra = list(dict.fromkeys(c for m in more.values() for x in m for c in x))
    kinds = {c: next("double" if isinstance(x[c], float) else "string" for m in more.values() for x in m if x.get(c) is not None) for c in extra}
    out, seen = [], dict.fromkeys(range(len(names)), 0)
    for r in table:
        i, k = r["f"], seen[r["f"]]
        seen[i] += 1
        if effects[i][k] is not None:
            out.append((*r[: len(g)], list(factors)[i], r["level"], effects[i][k], *n_of[i][k], *[more[i][k].get(c) for c in extra]))
    own = ", ".join(f"`{c}` {levels.schema[n].dataType.simpleString()}" for c, n in zip(keys, g))
    return df.sparkSession.createDataFrame(out, f"{own}, factor string, level string, effect double, n_obs long, n_units long" + "".join(f", `{c}` {t}" for c, t in kinds.items()))


def _backfit_by_tables(work: DataFrame, g: list[str], keys: list[str], names: dict[str, str], factors: dict[str, float], rounds: int, unit: str | None, adjust: dict) -> DataFrame:
    """``backfit`` with the levels' effects in tables, written once a step and joined by the others."""
    work = written(work.withColumn("x", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("n", "x"))
    found: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for f, shrink in factors.items():
            rows, rest = work.filter(F.col(names[f]).isNotNull()), F.col("v")
            for other, effects in found.items():
                if other != f:
                    e = f"e_{names[other]}"
                    rows = joined(rows, effects, [*g, names[other]], **{e: "effect"})
                    rest = rest - F.coalesce(F.col(e), F.lit(0.0))
            got = shrunk_effect(rows, rest, [*g, names[f]], shrink, "u" if unit else None).filter("effect IS NOT NULL")
            if f in adjust:
                own = got.withColumnsRenamed({**dict(zip(g, keys)), names[f]: "level"})
                got = adjust[f](own).withColumnsRenamed({**dict(zip(keys, g)), "level": names[f]})
            found[f] = written(got)
    out = None
    for f, effects in found.items():
        part = effects.withColumnsRenamed({**dict(zip(g, keys)), names[f]: "level"}).withColumn("factor", F.lit(f))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def predict(df: DataFrame, effects: DataFrame, group: str, factors: Sequence[str], out: str = "predicted") -> DataFrame:
    """``df`` with the sum of its levels' effects (0 for a level never seen) and coverage, the share of levels seen."""
    total, seen, drop = F.lit(0.0), F.lit(0), []
    for f in factors:
        level, e = _apart(df, f"_level_{f}", f"_effect_{f}")
        part = effects.filter(F.col("factor") == f).select(F.col(group), F.col("level").alias(level), F.col("effect").alias(e))
        df = joined(df.withColumn(level, F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("UNKNOWN"))), part, [group, level], **{e: e})
        seen = seen + F.col(e).isNotNull().cast("int")
        total = total + F.coalesce(F.col(e), F.lit(0.0))
        drop += [level, e]
    return df.withColumns({out: total, "coverage": seen / F.lit(len(factors) or 1)}).drop(*drop)


def error_metrics(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def persistent_bias(df: DataFrame, residual: str, unit: str, month: Column, shrink: float = 6.0) -> DataFrame:
    out = df.groupBy(unit).agg(F.count_distinct(month).alias("months"), F.count(residual).alias("n_obs"))
    out = joined(out, group_medians(df, residual, [unit]), [unit], raw_bias="median")
    return out.withColumn("bias", F.col("raw_bias") * F.col("months") / (F.col("months") + shrink))


def conditional_rate(df: DataFrame, keys: Sequence[str], hit: Column, base: Column) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count_if(base).alias("n"), F.count_if(base & hit).alias("hits"))
    return out.withColumn("rate", F.try_divide("hits", "n"))


def group_premium(df: DataFrame, value: str, group: str, label: str, reference: str, shrink: float = 10.0, floored: Sequence[str] | None = None) -> DataFrame:
    """(group, label, n, raw, premium): each label's median above the reference label's, shrunk by rows with a value.

    The reference is 0. Without it in a group, its place is taken by the median of the whole group. The labels of
    ``floored`` (all, if it isn't given) are 0 at least. A label without values is 0.
    """
    by_label = df.groupBy(group, label).agg(F.count(value).alias("n"))
    m = joined(by_label, group_medians(df, value, [group, label]), [group, label], m="median")
    base = m.groupBy(group).agg(F.max(F.when(F.col(label) == reference, F.col("m"))).alias("base"))
    m = joined(joined(m, base, [group], base="base"), group_medians(df, value, [group]), [group], every="median")
    raw = F.coalesce(F.col("m") - F.coalesce("base", "every"), F.lit(0.0))
    raw = F.when(F.col(label) == reference, 0.0).otherwise(raw)
    up = raw * F.col("n") / (F.col("n") + F.lit(float(shrink)))
    if floored is None:
        up = F.greatest(up, F.lit(0.0))
    elif floored:
        up = F.when(F.col(label).isin(*floored), F.greatest(up, F.lit(0.0))).otherwise(up)
    return m.select(group, label, "n", raw.alias("raw"), F.when(F.col(label) == reference, 0.0).otherwise(up).alias("premium"))


def others_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(``df``, n_others, others_median, others_mad): for each row with a value, of its group without the row itself.

    Without one value, the middle of the others lies at one of three ranks of the whole group, and those are ``ranks``' to
    find. So nothing is paired, and no task holds a large group.
    """
    around = lambda n: [F.when(n % 2 == 0, n / 2).otherwise((n - 1) / 2).cast("long") - 1 + k for k in (0, 1, 2)]

    def without(rows: DataFrame, names: list[str], at_most: int) -> DataFrame:
        """Distinct (names, v, n, middle): the median of the group's other rows, for a row of value v."""
        got = joined(rows.select(*names, "v").distinct(), ranks.at_ranks(rows, names, around, at_most), names, n="n", r0="r0", r1="r1", r2="r2")
        low = F.when(F.col("v") > F.col("r0"), F.col("r0")).otherwise(F.col("r1"))
        high = F.when(F.col("v") > F.col("r1"), F.col("r1")).otherwise(F.col("r2"))
        middle = F.when(F.col("n") % 2 == 0, low).otherwise((low + high) / 2)
        return got.select(*names, "v", "n", F.when(F.col("n") > 1, middle).alias("middle"))

    df = df.filter(F.col(f"`{value}`").isNotNull())
    rows, names = _narrow(df, value, keys)
    rows, n_rows = counted(rows)
    base = written(without(rows, names, n_rows))
    # at most three medians a group: each with the deviations of the whole group from it; a left join never broadcasts the rows
    kinds = base.select(*names, F.col("middle").alias("of")).distinct()
    away = rows.join(kinds.withColumnsRenamed({n: f"{n}_" for n in names}), [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], "left").drop(*[f"{n}_" for n in names])
    away = away.withColumn("v", F.abs(F.col("v") - F.col("of"))).filter("of IS NOT NULL")
    spread = without(away, [*names, "of"], 3 * n_rows).select(*names, F.col("of").alias("middle"), F.col("v").alias("d"), F.col("middle").alias("mad"))
    base = base.withColumn("d", F.abs(F.col("v") - F.col("middle")))
    base = matched(base, spread, [*names, "middle", "d"], mad="mad")
    own = _apart(df, *[f"_key{i}" for i in range(len(keys))], "_v")
    found = base.select(*[F.col(n).alias(o) for n, o in zip(names, own)], F.col("v").alias(own[-1]), (F.col("n") - 1).alias("n_others"), F.col("middle").alias("others_median"), F.col("mad").alias("others_mad"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in zip(keys, own)] + [F.col(f"`{value}`").cast("double") == F.col(own[-1])]
    return df.join(found.hint("merge"), on, "left").drop(*own)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n) of each combination of values; null is a value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
