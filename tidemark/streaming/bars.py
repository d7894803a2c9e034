"""Bars and indicators kept up to date from a stream of ticks.

Each micro-batch writes the bars it changed as a new version into a bar log
(``batch=<id>/day=<date>``); readers take the latest version of each bar. The
folder of a batch is overwritten if the batch runs again, so a restart after
the loss of a driver or an executor neither loses nor doubles a bar.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.constants import BAR_SECONDS
from tidemark.operators import indicators
from tidemark.operators.bars import KEYS, bar_aggregates, with_tick_order
from tidemark.operators.ordered import ema_reach
from tidemark.sources.tables import as_ticks
from tidemark.staging import complete_folders, delete_folder, new_path, stage

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BAR_VALUES = ["open", "high", "low", "close", "volume", "quote_volume", "trades"]


def tick_stream(spark: SparkSession, folder: str, glob: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Ticks from parquet files that land in a folder.

    A watermark needs a timestamp with a time zone, so the session must run in
    UTC for naive times to keep their value.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    events = reader.parquet(folder)
    return as_ticks(events.withColumn("ts", F.col("ts").cast("timestamp")))


def live_bars(ticks: DataFrame, bar: str, delay: str) -> DataFrame:
    """Bars over a tick stream; ticks later than ``delay`` behind the newest are dropped."""
    priced = with_tick_order(ticks.withWatermark("ts", delay))
    width = f"{BAR_SECONDS[bar]} seconds"
    shift = "4 days" if bar == "1w" else "0 seconds"
    windowed = priced.groupBy("symbol", F.window("ts", width, width, shift).alias("_w")).agg(*bar_aggregates())
    return windowed.select(
        "symbol", F.lit(bar).alias("bar"), F.col("_w.start").cast("timestamp_ntz").alias("open_time"), *BAR_VALUES
    )


def write_versions(rows: DataFrame, path: str, batch_id: int) -> None:
    """One version of the changed rows, in the folder of its batch.

    Rebalancing by day keeps the files few; a day with very many rows is split.
    """
    dated = rows.withColumn("day", F.col("open_time").cast("date")).hint("rebalance", "day")
    dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")


def latest_versions(spark: SparkSession, path: str, values: list[str], start_day: str | None = None) -> DataFrame:
    """The latest version of each row of a log; ``start_day`` prunes older folders."""
    log = spark.read.parquet(path)
    if start_day:
        log = log.where(F.col("day") >= F.lit(start_day).cast("date"))
    # Keys are (symbol, bar, open_time): groups are as small as the number of versions.
    return log.groupBy(*KEYS, "open_time").agg(*[F.max_by(v, "batch").alias(v) for v in values])


def run_bars(ticks: DataFrame, bar: str, path: str, checkpoint: str, delay: str = "1 hour", after=None, once: bool = True) -> StreamingQuery:
    """Start the upsert of bars into the log at ``path``; ``after(rows, batch_id)`` runs per batch."""

    def upsert(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            if rows.isEmpty():  # a batch that only moves the watermark
                return
            write_versions(rows, path, batch_id)
            if after is not None:
                after(rows, batch_id)
        finally:
            rows.unpersist()

    writer = live_bars(ticks, bar, delay).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(upsert)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_closed_bars(ticks: DataFrame, bar: str, path: str, checkpoint: str, delay: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Append each bar once, when the watermark has passed its end."""
    writer = live_bars(ticks, bar, delay).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact(spark: SparkSession, path: str, target: str, values: list[str]) -> None:
    """Write the latest versions of a log as a new log with one version per row."""
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    write_versions(latest_versions(spark, path, values), target, newest)


def refresh_indicators(
    indicator_path: str, tail_path: str, columns: list[str], late_bars: int = 48, vol_window: int = 20
):
    """A per-batch step: recompute the indicators from the first changed bar of each changed series on.

    The step carries the last bars of every series from batch to batch (the
    tail): as many as an indicator remembers in double precision, and
    ``late_bars`` more, which must cover the watermark delay. Tails are kept by
    series: a batch reads and writes those of the series it changes, and a
    directory, one row per series, says which batch wrote each. So a batch costs as
    much as its own series, however many others there are and however long
    the bar log has become. Folders that no series needs go.
    """
    reach = max(ema_reach(26) + ema_reach(9), 50, vol_window + 1)

    def step(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        fresh = changed.select(*KEYS, "open_time", *BAR_VALUES).withColumn("_new", F.lit(1))
        named = stage(fresh.select(*KEYS).distinct(), "changed-series")
        versions = [b for b in batch_ids(spark, f"{tail_path}/directory") if b < batch_id]
        directory = spark.read.parquet(f"{tail_path}/directory/batch={versions[-1]}") if versions else None
        # One number per batch whose folder still holds the tail of a changed series.
        held = directory.join(named, KEYS).select("written").distinct().collect() if versions else []
        if held:
            tails = spark.read.parquet(*[f"{tail_path}/tails/batch={row['written']}" for row in held])
            places = directory.join(named, KEYS).select(*KEYS, "written")
            tail = tails.join(places, [*KEYS, "written"], "left_semi").withColumn("_new", F.lit(0))
            both = fresh.unionByName(tail.select(*fresh.columns))
            fresh = both.groupBy(*KEYS, "open_time").agg(
                *[F.max_by(v, "_new").alias(v) for v in BAR_VALUES], F.max("_new").alias("_new")
            )
        series = indicators.numbered(fresh)
        # Staged, so that Spark knows its size: one row per changed series.
        first = series.where("_new = 1").groupBy(*KEYS).agg(F.min("open_time").alias("_first"), F.min("pos").alias("_start"))
        touched = series.join(stage(first, "touched"), KEYS).where(F.col("pos") >= F.col("_start") - reach)
        updated = indicators.all_indicators(touched, vol_window).where("open_time >= _first")
        write_versions(updated.select(*KEYS, "open_time", *columns), indicator_path, batch_id)
        kept = series.where(F.col("pos") >= F.col("n") - (reach + late_bars)).withColumn("written", F.lit(batch_id).cast("long"))
        kept.select(*KEYS, "open_time", *BAR_VALUES, "written").write.mode("overwrite").parquet(f"{tail_path}/tails/batch={batch_id}")
        places = named.withColumn("written", F.lit(batch_id).cast("long"))
        if versions:
            places = places.unionByName(directory.join(named, KEYS, "left_anti"))
        places.write.mode("overwrite").parquet(f"{tail_path}/directory/batch={batch_id}")
        # What this batch and the one before it name stays, for running this batch again.
        live = spark.read.parquet(*[f"{tail_path}/directory/batch={b}" for b in [*versions[-1:], batch_id]])
        needed = {row["written"] for row in live.select("written").distinct().collect()}
        for old in versions[:-1]:
            delete_folder(spark, f"{tail_path}/directory/batch={old}")
        for old in batch_ids(spark, f"{tail_path}/tails"):
            if old < batch_id and old not in needed:
                delete_folder(spark, f"{tail_path}/tails/batch={old}")

    return step


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches of a log that were written whole, oldest first."""
    return sorted(int(name.removeprefix("batch=")) for name in complete_folders(spark, path) if name.startswith("batch="))


def land_in_order(spark: SparkSession, events: DataFrame, part: Column, count: int) -> Iterator[str]:
    """Write the events part by part, 0 to ``count`` - 1, and yield the folder pattern after each: what a stream finds as time goes on."""
    path = new_path(spark, "landing")
    parts = stage(events.withColumn("_part", part), "arrivals")
    for k in range(count):
        parts.where(F.col("_part") == k).drop("_part").write.parquet(f"{path}/part={k:05d}")
        yield f"{path}/*"


def replay(spark: SparkSession, events: DataFrame) -> str:
    """Write events as files in mixed order, as many as the session's shuffle partitions, to stream them file by file."""
    path = new_path(spark, "landing")
    events.repartition(F.xxhash64("event_id")).write.parquet(path)
    return path
