"""Tables that outlive a job: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors all see, in the one that ``spark.checkpoint.dir`` names.

    Only where that is unset and Spark runs in one process (tests) is it a local temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
        base = f"file://{_own_dir[0]}"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a shared folder: computed once, its lineage cut, safe from lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(f"{path}/t")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/t")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as ``written`` gives it, and its number of rows, which the write itself counts."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def forget() -> None:
    """Deletes the folders given out so far. Call it when no result that reads them is needed any more."""
    while _kept:
        spark, path = _kept.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
