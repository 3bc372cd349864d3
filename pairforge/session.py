"""Session construction and the shared scratch location.

Library code never creates a session on its own; it takes the caller's.
``get_session`` is a convenience for tests, benches and scripts.
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
    # AQE turns a shuffled join into a broadcast only when the measured
    # shuffle output of one side is below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pairforge", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("PAIRFORGE_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(
        shuffle_partitions or int(os.environ.get("PAIRFORGE_SHUFFLE_PARTITIONS", "8")))
    conf.setdefault("spark.driver.memory", os.environ.get("PAIRFORGE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read;
    a cluster session without it is an error. When it is unset in local
    mode (tests) a fresh local folder is registered as the SparkContext
    checkpoint folder (the setting itself cannot change at runtime), so
    later calls in the session agree.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder on shared storage "
                           "(stages write their tables and checkpoints there)")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairforge-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def replace_partitions(df, *by: str):
    """A writer that replaces only the partitions ``df`` has rows for, whatever
    the session's ``partitionOverwriteMode`` is."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def materialize(df, name: str = "table"):
    """Write ``df`` as a Parquet table in a fresh folder under the shared
    checkpoint root and return a DataFrame reading it back.

    Cuts the lineage (a lost executor no longer forces recomputing the
    upstream plan), fixes nondeterministic columns once, and lets later
    consumers prune columns and push filters into the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ship_package(spark) -> None:
    """Make ``pairforge`` importable in Python workers (like ``--py-files``).

    Python-side operators (verifier, formatting hook, Arrow data source)
    are unpickled on executors and import this package there. The package
    is zipped once per SparkContext on the driver and added with
    ``addPyFile``; Spark ships it to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pairforge_shipped", False):
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="pairforge-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "pairforge"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="pairforge")
    sc.addPyFile(archive)
    sc._pairforge_shipped = True
