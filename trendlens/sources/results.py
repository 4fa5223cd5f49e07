"""Result sinks and re-reads.

Results are tables partitioned by ``run_id`` (and ``target`` where one is
involved) instead of one CSV per target per run: a later roll-up selects the
latest run with a partition filter, and nothing is overwritten between
targets.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_run_id() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def preview(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in an explicit order (distributed top-n)."""
    return df.orderBy(*key).limit(n)


def write_result(df: DataFrame, base: str, name: str, run_id: str,
                 partition_by: Sequence[str] = ()) -> str:
    """Append one result table under ``base/name`` partitioned by
    run (and e.g. target)."""
    path = f"{base.rstrip('/')}/{name}"
    (df.withColumn("run_id", F.lit(run_id)).write.mode("append")
       .partitionBy("run_id", *partition_by).parquet(path))
    return path


MANIFEST = "_runs"


def commit_run(spark: SparkSession, base: str, run_id: str, tables: Sequence[str]) -> None:
    """Record a finished run with the tables it wrote: the last thing a run
    does.  Tables of a run without this record are not results yet."""
    (spark.createDataFrame([(run_id, sorted(tables))], "run_id string, tables array<string>").coalesce(1)
     .write.mode("append").parquet(f"{base.rstrip('/')}/{MANIFEST}"))


def committed_runs(spark: SparkSession, base: str) -> DataFrame | None:
    """``run_id, tables`` of the finished runs under ``base``; None where none was recorded."""
    path = f"{base.rstrip('/')}/{MANIFEST}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("run_id string, tables array<string>").parquet(path)


def latest_run(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of the newest finished run that wrote ``name``; only its files
    are listed or read.  Under a base that records no runs (``commit_run``) the
    newest folder counts."""
    root = f"{base.rstrip('/')}/{name}"
    done = committed_runs(spark, base)
    if done is not None:
        newest = done.where(F.array_contains("tables", name)).agg(F.max("run_id")).first()[0]
        if newest is None:
            raise ValueError(f"no finished run of {name!r} under {base}")
        newest = f"run_id={newest}"
    else:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        runs = [p for p in (s.getPath().getName() for s in listed) if p.startswith("run_id=")]
        if not runs:
            raise ValueError(f"no run of {name!r} under {base}")
        newest = max(runs)
    return (spark.read.option("basePath", root).parquet(f"{root}/{newest}")
            .withColumn("run_id", F.lit(newest.split("=", 1)[1])))
