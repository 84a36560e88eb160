"""A local session for tests and measurements, and the package on every worker of any session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, app: str = "epitrove") -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once.

    Workers start in a folder of their own, and functions travel to them by name.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Only this process reads the file: it serves it to the executors as long as it lives.
    folder = Path(tempfile.mkdtemp(prefix="epitrove-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(root, folder / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / root.name), "zip", folder / "tree"))
    _shipped.add(application)
