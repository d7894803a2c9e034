"""Bars from a tick stream in which every tick is accounted for.

A tick is late if its bar ended ``delay`` or more before the newest tick of
earlier batches. Late ticks go to a table of their own, with the batch that
brought them; all others become partial bars, which merge exactly. Each batch writes its
parts below ``batch=<id>`` and one row of progress: the newest time so far and
its numbers of ticks. Nothing else is remembered between batches, so a batch
costs as much as its own ticks and the bars they touch. A batch that runs again overwrites
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.constants import BAR_SECONDS
from tidemark.functions.numbers import AMOUNT
from tidemark.operators.bars import KEYS, bar_start, with_tick_order
from tidemark.staging import complete_folders
from tidemark.streaming.bars import write_versions

_PROGRESS = "newest timestamp, ticks long, late long"


def partial_bars(ticks: DataFrame, bar: str) -> DataFrame:
    """Bars of some ticks in a form that merges with the bars of others: with the order of the first and last tick."""
    priced = ticks.withColumn("open_time", bar_start("ts", bar))
    parts = priced.groupBy("symbol", "open_time").agg(
        F.min("_ord").alias("first_ord"), F.min_by("price", "_ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("_ord").alias("last_ord"), F.max_by("price", "_ord").alias("close"), F.count(F.lit(1)).alias("trades"),
        F.coalesce(F.sum(F.col("quote").cast(AMOUNT)), F.lit(0)).cast("decimal(38,8)").alias("quote"),
    )
    return parts.select("symbol", F.lit(bar).alias("bar"), F.col("open_time").cast("timestamp_ntz").alias("open_time"), *parts.columns[2:])


def merged_bars(parts: DataFrame) -> DataFrame:
    """Partial bars of any number of batches to bars."""
    return parts.groupBy(*KEYS, "open_time").agg(
        F.min_by("open", "first_ord").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_ord").alias("close"),
        F.sum("trades").cast("double").alias("volume"), F.sum("quote").cast("double").alias("quote_volume"), F.sum("trades").alias("trades"),
    )


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.removeprefix("batch=")) for name in complete_folders(spark, folder) if name.startswith("batch="))


def run_ledger(ticks: DataFrame, bar: str, folder: str, checkpoint: str, delay_seconds: int = 3600, after=None, once: bool = True) -> StreamingQuery:
    """Start the ledger of a tick stream below ``folder``: partial bars, late ticks, progress.

    ``after(rows, batch_id)`` gets the bars that a batch changed, merged with what earlier batches brought.
    """

    def take(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        done = [b for b in _batches(spark, f"{folder}/progress") if b < batch_id]
        before = None
        if done:
            before = spark.read.schema(_PROGRESS).parquet(f"{folder}/progress/batch={done[-1]}").first()["newest"]
        ended = F.col("_end") <= F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
        end = bar_start("ts", bar) + F.make_dt_interval(secs=F.lit(BAR_SECONDS[bar]))
        marked = with_tick_order(rows).withColumn("_end", end).withColumn("_late", F.coalesce(ended, F.lit(False))).persist()
        try:
            late = marked.where("_late")
            late.drop("_end", "_late", "_ord").withColumn("bar", F.lit(bar)).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            write_versions(partial_bars(marked.where("NOT _late"), bar), f"{folder}/bars", batch_id)
            facts = marked.agg(F.max("ts").cast("timestamp").alias("newest"), F.count(F.lit(1)).alias("ticks"), F.count_if("_late").alias("late"))
            newest = F.greatest(F.col("newest"), F.lit(before).cast("timestamp")).alias("newest")
            facts.select(newest, "ticks", "late").write.mode("overwrite").parquet(f"{folder}/progress/batch={batch_id}")
            if after is not None:
                touched = spark.read.parquet(f"{folder}/bars/batch={batch_id}").select(*KEYS, "open_time", "day")
                first = touched.agg(F.min("day")).first()[0]
                if first is not None:
                    parts = read_parts(spark, folder).where(F.col("day") >= F.lit(first))
                    after(merged_bars(parts.join(touched.drop("day"), [*KEYS, "open_time"], "left_semi")), batch_id)
        finally:
            marked.unpersist()

    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The partial bars of all batches."""
    return spark.read.parquet(f"{folder}/bars")


def ledger_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of all ticks that were in time."""
    return merged_bars(read_parts(spark, folder))


def late_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The ticks that came too late, with the batch that brought them."""
    return spark.read.parquet(f"{folder}/late")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per batch: newest time so far, ticks, late ticks."""
    return spark.read.parquet(f"{folder}/progress").select("batch", "newest", "ticks", "late")
