"""Registered streaming queries: the tick table replayed as a stream of files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.plans import market_plans
from tidemark.plans.common import TICKS, r, rounded, with_ctes
from tidemark.sources.tables import table
from tidemark.staging import new_path
from tidemark.streaming import bars as live, ledger

PARTS = 6
BATCHES = 8  # of a replay of all files
STRAGGLERS = 11  # one tick in so many arrives a part late
MANY = 1_000_000


def _span_hours(spark, d) -> int:
    """Hours between the first and the last tick: files come in mixed order, so a tick may be late by that much."""
    first, last = table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    return 1 if first is None else math.ceil((last - first).total_seconds() / 3600) + 1


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _part_of_time(events):
    """The part of the whole span, cut into equal parts, that a tick falls in."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = (events.agg(f(micros)).scalar() for f in (F.min, F.max))
    return F.floor((micros - first) * PARTS / (last - first + 1)).cast("int")


def stream_ohlcv(spark, d):
    """Hourly bars after all micro-batches, from files in mixed order.

    Each batch updates every state partition, and files and state partitions grow with the table: the number of batches does not.
    """
    path = new_path(spark, "live-bars")
    folder = live.replay(spark, _events(spark, d))
    files = len(spark.read.parquet(folder).inputFiles())
    ticks = live.tick_stream(spark, folder, files_per_batch=max(1, -(-files // BATCHES)))
    live.run_bars(ticks, "1h", path, new_path(spark, "offsets"), f"{_span_hours(spark, d)} hours").awaitTermination()
    return rounded(live.latest_versions(spark, path, live.BAR_VALUES))


def stream_indicators(spark, d):
    """All indicators after all micro-batches, refreshed batch by batch; files arrive by time, a tick may be an hour late."""
    path, out, offsets = new_path(spark, "live-bars"), new_path(spark, "live-indicators"), new_path(spark, "offsets")
    values = ["close", *market_plans.INDICATORS]
    step = live.refresh_indicators(out, new_path(spark, "tail"), values, late_bars=2)
    events = _events(spark, d)
    for folder in live.land_in_order(spark, events, _part_of_time(events), PARTS):
        live.run_bars(live.tick_stream(spark, folder, files_per_batch=MANY), "1h", path, offsets, "1 hour", after=step).awaitTermination()
    return rounded(live.latest_versions(spark, out, values))


def _kept_ledger(spark, d) -> str:
    """A ledger of ticks that arrive by time, some of them late."""
    folder, offsets = new_path(spark, "ledger"), new_path(spark, "offsets")
    events = _events(spark, d)
    arrival = F.least(_part_of_time(events) + F.when(F.col("event_id") % STRAGGLERS == 0, 1).otherwise(0), F.lit(PARTS - 1))
    for pattern in live.land_in_order(spark, events, arrival, PARTS):
        ledger.run_ledger(live.tick_stream(spark, pattern, files_per_batch=MANY), "1h", folder, offsets, 3600).awaitTermination()
    return folder


def stream_ledger(spark, d):
    """Per hour and symbol, the bar of the ticks in time and the number of late ones."""
    folder = _kept_ledger(spark, d)
    late = ledger.late_ticks(spark, folder).groupBy("symbol", ledger.bar_start("ts", "1h").cast("timestamp_ntz").alias("open_time"))
    joined = ledger.ledger_bars(spark, folder).drop("bar").join(late.agg(F.count(F.lit(1)).alias("late")), ["symbol", "open_time"], "full")
    zero = F.lit(0).cast("long")
    return rounded(joined.withColumns({"trades": F.coalesce("trades", zero), "late": F.coalesce("late", zero)}))


def stream_progress(spark, d):
    """Ticks and late ticks per batch."""
    return ledger.progress(spark, _kept_ledger(spark, d)).select(F.col("batch").cast("int").alias("batch"), "ticks", "late")


_LEDGER = {
    "ticks": TICKS,
    "timed": "SELECT *, epoch_us(ts) AS us FROM ticks",
    "span": "SELECT MIN(epoch_us(ts)) AS lo, MAX(epoch_us(ts)) AS hi FROM events",
    "arrived": f"""SELECT t.*, least((us - lo) * {PARTS} // (hi - lo + 1) + CASE WHEN tick_id % {STRAGGLERS} = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS part,
      time_bucket(INTERVAL '1 hour', ts) AS open_time FROM timed t, span""",
    "newest": "SELECT part, MAX(MAX(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arrived GROUP BY part",
    "judged": """SELECT a.*, COALESCE(epoch_us(open_time) + 3600000000 <= seen - 3600000000, FALSE) AS late
      FROM arrived a JOIN newest n ON n.part = a.part""",
}

QUERIES = {
    "stream_ohlcv": (stream_ohlcv, market_plans.QUERIES["ohlcv_resample"][1].split(" UNION ALL ")[0] + ")"),
    "stream_indicators": (stream_indicators, market_plans.QUERIES["all_indicators"][1]),
    "stream_ledger": (
        stream_ledger,
        with_ctes(
            f"""SELECT symbol, open_time, {r('first(price ORDER BY ts, tick_id) FILTER (NOT late)')} AS open, {r('MAX(price) FILTER (NOT late)')} AS high,
              {r('MIN(price) FILTER (NOT late)')} AS low, {r('last(price ORDER BY ts, tick_id) FILTER (NOT late)')} AS close,
              CAST(NULLIF(COUNT(*) FILTER (NOT late), 0) AS DOUBLE) AS volume,
              {r('CASE WHEN COUNT(*) FILTER (NOT late) > 0 THEN COALESCE(CAST(SUM(CAST(quote AS DECIMAL(28,8))) FILTER (NOT late) AS DOUBLE), 0) END')} AS quote_volume,
              COUNT(*) FILTER (NOT late) AS trades, COUNT(*) FILTER (late) AS late FROM judged GROUP BY symbol, open_time""",
            **_LEDGER,
        ),
    ),
    "stream_progress": (
        stream_progress,
        with_ctes("SELECT CAST(part AS INTEGER) AS batch, COUNT(*) AS ticks, COUNT(*) FILTER (late) AS late FROM judged GROUP BY part", **_LEDGER),
    ),
}
