"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


# Settings of a running session that the operators rely on. Without the skewed join
# being forced Spark leaves it whole where splitting it costs one more shuffle. Rows go to
# Python in batches of so many bytes: by rows alone, 10,000 texts of any length make one.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; those of a cluster on this machine share its path."""
    context = spark.sparkContext
    if context.master.startswith("local-cluster") or context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(context.applicationId)


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the settings on a session that was built elsewhere, and the package on its executors."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    ship_package(spark)
    return spark


def get_session(app_name: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """Build (or fetch) a session with ANSI on, UTC time and adaptive execution.

    On a cluster pass no master: it comes from spark-submit, like memory and
    the number of shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.ui.enabled", "false")
                .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
                .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
            )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark
