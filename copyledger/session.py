"""Session construction and the shared scratch folder.

Jobs that need to cut lineage or stage intermediate tables write under the
folder the cluster names in ``spark.checkpoint.dir``.  A local folder is only
created (and registered as the checkpoint dir) when the session has none,
which is the case in tests and local benches.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "copyledger", extra: dict | None = None) -> SparkSession:
    """Session for tests and benches (local mode unless ``master`` says otherwise)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("COPYLEDGER_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; created locally only when none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="copyledger-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"



_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``copyledger`` importable by Python workers (data source, pandas
    functions): zip the package into the shared folder and ``addPyFile`` it,
    once per application."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    # Only the driver reads this file: addPyFile serves it to the executors.
    zpath = os.path.join(tempfile.mkdtemp(prefix="copyledger-py-"), "copyledger.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def pickle_by_value(module_name: str) -> None:
    """Serialise the functions and classes of a module by value, so Python
    workers run them without importing this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])
