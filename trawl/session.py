"""Session helpers shared by the command-line entry points, the bench and the tests."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even when the driver found it through ``sys.path`` only."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if REPO not in paths and REPO not in os.environ.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join([REPO, *paths])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``; it goes when the driver ends.

    A session without that setting must be one local process, and gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trawl-')}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone when the driver ends
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return folder


def local_session(name: str = "trawl", cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
