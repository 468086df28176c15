"""Session helpers: one place for the knobs every job relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rankforge") -> SparkSession:
    """Return the active session, or build one (tests, bench, local runs).

    On a cluster the session is normally created by the launcher and this
    simply returns it; the settings below only apply to a new session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only a local
    session without the setting (tests) gets a fresh scratch folder: other
    machines would not see one.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        current = tempfile.mkdtemp(prefix="rankforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Prepare a session for rankforge jobs.

    * Make ``rankforge`` importable on executors (pandas UDFs reference it):
      zip the package once per session and add it with ``addPyFile``.
    * Turn off union output-partitioning inheritance
      (``spark.sql.unionOutputPartitioning``): with AQE coalescing, a union
      of hash-partitioned children can claim a partitioning its partitions do
      not have (wrong aggregates, or "Can't zip RDDs with unequal numbers of
      partitions"); fusion unions ranked lists and then aggregates, so the
      union must not be trusted. The cost is at most one extra exchange.
    """
    import os
    import zipfile

    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="rankforge-pkg-")
    archive = os.path.join(out_dir, "rankforge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(key)
