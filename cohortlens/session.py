"""Session helpers.

On a cluster the session is created by the launcher; these helpers only fill
in settings that are unset, so cluster values always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "cohortlens", **conf) -> SparkSession:
    """Return the active session or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        ship_library(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_library(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder.

    Uses ``spark.checkpoint.dir`` as named by the cluster.  Only when it is
    unset (local tests) a fresh scratch folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # local runs only (no cluster setting): a scratch folder of this machine
    local = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001  (some deployments reject runtime core confs)
        pass
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, eager: bool = True):
    """Cut lineage of an expensive, reused intermediate with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def ensure_parallelism(df, *keys, factor: int = 1):
    """Hash-spread a frame whose partition count is below the cluster's parallelism.

    Used before row-multiplying steps (bootstrap replicates): a one-file
    input would otherwise run the whole fan-out in one task.  On a cluster
    reading many files the input already has enough partitions and nothing
    is shuffled.  Hashing on ``keys`` keeps the placement deterministic for
    task retries.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def ship_library(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    Sends one archive per Spark context through the driver's file server;
    does nothing once it was sent.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cohortlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cohortlens-lib-"), "cohortlens_lib.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._cohortlens_shipped = True
