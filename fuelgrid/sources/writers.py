"""Writers: result tables as CSV, panels as Parquet by date, metadata as JSON. All go through Spark's own writers, so
an attempt that fails leaves no half-written result."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def result(df: DataFrame, path: str, one_file: bool = False, mode: str = "overwrite") -> None:
    """A table as CSV with a header. ``one_file`` is for summaries of a few rows: one task writes them all."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


def panel(df: DataFrame, path: str, by: str = "date", mode: str = "overwrite") -> None:
    """A panel as Parquet with a folder for each date, so that a read of some dates lists and reads these alone. The
    rows of a date are spread over tasks as they come; nothing is shuffled."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def metadata(spark: SparkSession, values: dict[str, Any], path: str, mode: str = "overwrite") -> None:
    """A small dictionary as one JSON document."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode(mode).text(path)
