"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, where driver and
    tasks are one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


# Shuffle files of a finished query go at once, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, grouped by application for cleaning up."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidemark/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result is read more than once and its input is much larger
    than the result (ticks to bars), or where row numbers must not change
    between two uses. The written files survive the loss of executors. The
    shuffle files of the write are deleted when it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the sub-folders whose write was committed."""
    path, files = _folder(spark, folder)
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path) if status.isDirectory()]
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return [p.getName() for p in found if files.exists(marker(p, "_SUCCESS"))]


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, files = _folder(spark, folder)
    files.delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged by this application; no result may be read from them after this."""
    delete_folder(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few fixed rows as a table of literals."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
