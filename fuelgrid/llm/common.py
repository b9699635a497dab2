"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelgrid.storage import shared_dir, written  # noqa: F401  what the operators write, storage.forget() deletes

#: A word is a run of anything but these six ASCII characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The array of a text's words; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
