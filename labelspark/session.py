"""Spark session helpers.

The library never creates its own cluster settings on a real cluster: it
reads what the session already has and only fills in what is missing
(tests, the local bench).
"""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labelspark") -> SparkSession:
    """Local session for tests and the bench (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LABELSPARK_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared filesystem and is
    used as is.  Only a local session (tests, the bench) without a folder gets
    a scratch folder of its own; a cluster session without one is an error.
    Works without a SparkContext (Spark Connect), where the server-side
    setting is used.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no driver-side context)
        sc = None
    if sc is None:
        if not current:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return current
    if sc.getCheckpointDir() is None:
        if current:
            sc.setCheckpointDir(current)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="labelspark-ckpt-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return current or sc.getCheckpointDir()


_scratch: set[tuple[SparkSession, str]] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables; it goes
    with :func:`drop_scratch`, at the latest when this Python process ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.add((spark, f"{base}/{name}"))
    return f"{base}/{name}"


def drop_scratch() -> None:
    """Delete the tables written under :func:`scratch_path` so far.  Frames
    that still read them can't be used any more."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  (the session is gone, or has no driver-side context)
            continue
