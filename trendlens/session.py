"""Session helpers.

The library never creates machine-local scratch space: anything it must
persist (lineage cuts, saved forests) goes under the shared folder named by
``spark.checkpoint.dir``.  A default is only set when the session has none,
which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "trendlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # fits the 7 GB bench budget; override with TRENDLENS_DRIVER_MEMORY
    conf["spark.driver.memory"] = os.environ.get("TRENDLENS_DRIVER_MEMORY", "6g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trendlens`` importable in executor Python workers.

    Task closures reference library functions by module, so executors need
    the package: it is zipped once per application and registered with
    ``SparkContext.addPyFile``, which distributes it to every executor (the
    same as ``--py-files``).  Idempotent per application.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="trendlens-pyfiles-")  # driver-side; Spark ships it
    zpath = os.path.join(out_dir, "trendlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and saved models.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir); only when both are unset (local tests) a folder under
    the system temp dir is chosen and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.startswith("local"):
            # single machine (tests): a private temp folder is shared by all tasks
            conf_dir = tempfile.mkdtemp(prefix="trendlens-ckpt-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
