"""Session construction and the shared scratch location.

On a cluster the session already names ``spark.checkpoint.dir`` (a shared
file system path). Operators that must cut lineage or store results before
reuse write below that folder; a machine-local folder is only created when
the setting is missing, which is the case in unit tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "palaver", driver_memory: str | None = None,
                  checkpoint_dir: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators assume (ANSI, UTC, AQE).

    ``checkpoint_dir`` is the shared folder for scratch tables, which a cluster
    needs; ``settings`` come last (see ``cluster_settings``). Loopback addresses
    are set for local masters only.

    ``driver_memory`` only takes effect when this call starts the JVM (local
    mode runs every task inside the driver, so it is the executor heap too).
    """
    # local runs bind to loopback; advertise the same address, or task results
    # too large for direct return cannot be fetched back (only read at JVM start)
    local = (master or os.environ.get("MASTER", "")).startswith("local[") or master == "local"
    if local:
        os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.appName(app_name)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if local:
        builder = builder.config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is made only for a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palaver-ckpt-")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name below the checkpoint root (not created)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/palaver/{label}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for plain-file helpers used by tests."""
    return path[len("file:"):] if path.startswith("file:") else path


def ensure_dir(path: str) -> str:
    p = local_path(path)
    if "://" not in p:
        os.makedirs(p, exist_ok=True)
    return path


_PACKAGES = ("palaver", "checks")


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (``--py-files`` at run time).

    Functions run in workers (pandas UDFs, ``mapInPandas``, stream state)
    are pickled by reference to this package, so the workers need it too.
    The zip is built once per session on the driver and distributed by
    Spark; it is written below the checkpoint root when that is a local
    path, else in a driver temp folder (Spark copies it to the executors).
    """
    import zipfile

    if spark.conf.get("palaver.shipped", "false") == "true":
        return
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = local_path(checkpoint_root(spark))
    folder = root if "://" not in root else tempfile.mkdtemp(prefix="palaver-pyfiles-")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"palaver-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for pkg in _PACKAGES:
            top = os.path.join(repo, pkg)
            if not os.path.isdir(top):
                continue
            for dirpath, _, files in os.walk(top):
                if "__pycache__" in dirpath:
                    continue
                for f in files:
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, repo))
    spark.sparkContext.addPyFile(target)
    spark.conf.set("palaver.shipped", "true")


def cluster_settings(shuffled_bytes: int, task_bytes: int = 1 << 30, most_partitions: int = 20_000) -> dict[str, str]:
    """Settings for a large cluster run, sized from the bytes its largest shuffle moves.

    A shuffle of m map and r reduce tasks has m * r blocks for the driver to
    track, so both grow with the square root of the data: scans take splits of
    ``task_bytes``, and reduce partitions are bounded (at 100 TB, 20,000 of
    5 GB before AQE splits skewed ones and joins small ones). Skew splitting is
    forced even where it adds a shuffle; stream state goes to RocksDB. Pass the
    result as ``settings`` of ``build_session``.
    """
    partitions = min(most_partitions, max(200, -(-shuffled_bytes // task_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes // 4),
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(task_bytes),
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
