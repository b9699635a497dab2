"""Mixing sources to target weights.

Sizes are summed by source before anything is shuffled, each source gets a target by weighted shares with a ceiling,
and rate = target / size. A document is emitted floor(rate) times, and once more if a number hashed from its id and a
seed, even over [0, 1), is below the rate's fraction. So reruns agree, and no task depends on another.

The targets are worked out over one row for each source, in one task: sources are meant to be fewer than millions.

Cases: a null or blank text has size 0. A null source is a source of its own, last in order. A row with a null id draws
by its text. Repeated rows draw alike, as their ids do. A source of size 0 has target and rate 0. An empty table
gives an empty result. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"
#: The table of sources is broadcast up to this many rows; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Ranked by ceiling / weight, the sources that reach their ceiling come first: the first k do, where k is the least
    for which the rest, shared by weight, fits under every later ceiling. All sums are of whole numbers, so exact.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(order) - 1) % len(weights)).cast("long")
    df = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), w.alias("weight"))
    by_room = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(F.lit(0)), by_room.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "rest": F.sum("source_size").over(every) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.col("rest").cast("double") / F.col("rest_weight")
    df = df.withColumn("level", F.max(F.when(level * F.col("weight") <= ceiling * F.col("source_size"), level)).over(every))
    room = (ceiling * F.col("source_size")).cast("double")
    return df.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), room), room).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """An even number in [0, 1) from a row's key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs``, whole, with how often the mix takes it."""
    own = lambda c: F.col(f"`{c}`")
    key = F.coalesce(own(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(own(text_col), F.lit("")))))
    sized = docs.select(F.struct("*").alias("row"), own(source_col).alias("source"), size_of(own(text_col)).alias("size"), draw(key, seed).alias("drawn"))
    sums = docs.groupBy(own(source_col).alias("source")).agg(F.sum(size_of(own(text_col))).alias("source_size"))
    goal = written(targets(sums, weights, ceiling).withColumnRenamed("source", "of"))
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    return out.select("row", "size", "source_size", "target", (whole + (F.col("drawn") < rate - whole).cast("long")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken."""
    return copies(docs, **how).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return copies(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sums
), ranked AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight
  FROM weighed WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(rest::DOUBLE / rest_weight::DOUBLE) AS level FROM ranked WHERE rest::DOUBLE / rest_weight::DOUBLE * weight <= 3 * source_size
), goal AS (
  SELECT source, source_size, least(coalesce(level * weight, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM weighed, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken FROM rated
"""
