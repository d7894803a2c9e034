"""Files in and out, and the streaming family."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.sources import files
from tidemark.sources.tables import as_ticks
from tidemark.staging import new_path
from tidemark.streaming import bars as live


def test_sales_csv(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(' Order ID ,Order Date,Ship Date,Sales,State\nCA-1,08/11/2017,11/11/2017,"12.5","New, York"\nCA-2,bad,,x,Ohio\n')
    rows = files.read_sales_csv(spark, str(path), date_formats=["dd/MM/yyyy"]).collect()
    assert rows[0]["Order Date"] == dt.datetime(2017, 11, 8) and rows[0]["Sales"] == 12.5 and rows[0]["State"] == "New, York"
    assert rows[1]["Order Date"] is None and rows[1]["Sales"] == 0.0 and rows[1]["Profit"] == 0.0


def test_customer_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("customer ID, Monthly Charge \n1, 20.5\n2, 30\n")
    got = files.read_customers_csv(spark, str(path))
    assert got.columns == ["customer_ID", "Monthly_Charge"] and dict(got.dtypes)["Monthly_Charge"] == "double"


KLINE = [1499040000000, "0.01", "0.8", "0.015", "0.0157", "148976.1", 1499644799999, "2434.19", 308, "1756.87", "28.46", "17"]


def test_klines_from_lines_and_from_a_response(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps(KLINE) + "\n" + json.dumps(["x"] * 3) + "\n")
    rows = files.read_klines(spark, str(tmp_path / "k.json"), "BTCUSDT", "1w").orderBy(F.col("open_time").desc_nulls_last()).collect()
    assert rows[0]["open_time"] == dt.datetime(2017, 7, 3) and rows[0]["close"] == 0.0157 and rows[0]["trades"] == 308
    assert rows[0]["taker_buy_base"] == "1756.87" and rows[1]["open_time"] is None
    response = spark.createDataFrame([("s", "1w", json.dumps([KLINE, KLINE]))], "symbol string, bar string, value string")
    assert files.parse_klines(files.explode_kline_response(response)).where("volume = 148976.1").count() == 2


def test_ticker_falls_back_to_the_latest_bar(spark):
    tickers = files.parse_ticker(spark.createDataFrame([("a", '{"lastPrice":"5.5","priceChangePercent":"oops"}'), ("b", "{}")], "symbol string, value string"))
    latest = spark.createDataFrame([("a", "1h", 1.0, 7.0), ("b", "1h", 2.0, 8.0), ("c", "1h", 3.0, 9.0)], "symbol string, bar string, close double, quote_volume double")
    got = {r["symbol"]: (r["price"], r["change_pct"], r["volume_24h"]) for r in bars.ticker_kpi(latest, tickers).collect()}
    assert got == {"a": (5.5, 0.0, 7.0), "b": (2.0, 0.0, 8.0), "c": (3.0, 0.0, 9.0)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string")
    files.write_csv(df, str(tmp_path / "out"), partition_by=["k"])
    assert sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("k=")) == ["k=x", "k=y"]
    assert files.read_csv_text(spark, str(tmp_path / "out")).count() == 2
    files.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_ticks_at_the_same_time_are_told_apart_by_id(spark):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(2, at, 1, "s", 20.0, '{"k": 1}'), (1, at, 1, "s", 10.0, '{"k": 2}'), (3, at, 1, "s", 30.0, "junk"), (4, at, 1, "s", None, "{}")]
    events = spark.createDataFrame(rows, live.EVENT_SCHEMA)
    bar = bars.resample(as_ticks(events), "1h").first()
    assert (bar["open"], bar["close"], bar["high"], bar["low"], bar["trades"], bar["quote_volume"]) == (10, 30, 30, 10, 3, 40)


def test_week_bars_start_on_monday(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 7, 23), 1, "s", 1.0, "{}"), (2, dt.datetime(2024, 1, 8), 1, "s", 2.0, "{}")], live.EVENT_SCHEMA)
    starts = sorted(r["open_time"] for r in bars.resample(as_ticks(events), "1w").collect())
    assert starts == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)]


def land(spark, folder, name, hours):
    """One parquet file of ticks, given as (id, hour)."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "s", float(i), '{"k": 1}') for i, h in hours]
    spark.createDataFrame(rows, live.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.mark.parametrize("delay,kept", [("1 hour", 4), ("10 days", 6)])
def test_late_ticks_drop_behind_the_watermark(spark, tmp_path, delay, kept):
    """Six ticks in three files; two come more than an hour late."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "bars")
    os.makedirs(folder)
    for name, hours in (("f1", [(1, 0.1), (2, 5.5)]), ("f2", [(3, 5.6), (4, 1.0)]), ("f3", [(5, 8.0), (6, 2.5)])):
        land(spark, folder, name, hours)
        ticks = live.tick_stream(spark, f"{folder}/*")
        live.run_bars(ticks, "1h", path, str(tmp_path / "cp"), delay).awaitTermination()
    got = live.latest_versions(spark, path, live.BAR_VALUES)
    assert got.agg(F.sum("trades")).first()[0] == kept


def test_restart_neither_loses_nor_doubles(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "bars")
    os.makedirs(folder)
    land(spark, folder, "f1", [(1, 0.1), (2, 0.2)])
    for _ in range(2):  # the second start finds nothing new
        live.run_bars(live.tick_stream(spark, f"{folder}/*"), "1h", path, str(tmp_path / "cp"), "1 day").awaitTermination()
    land(spark, folder, "f2", [(3, 0.3)])
    live.run_bars(live.tick_stream(spark, f"{folder}/*"), "1h", path, str(tmp_path / "cp"), "1 day").awaitTermination()
    rows = live.latest_versions(spark, path, live.BAR_VALUES).collect()
    assert [(r["open"], r["close"], r["trades"]) for r in rows] == [(1.0, 3.0, 3)]


def test_closed_bars_are_appended_once(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "closed")
    os.makedirs(folder)
    for name, hours in (("f1", [(1, 0.1), (2, 1.5)]), ("f2", [(3, 6.0)]), ("f3", [(4, 12.0)])):
        land(spark, folder, name, hours)
        live.run_closed_bars(live.tick_stream(spark, f"{folder}/*"), "1h", path, str(tmp_path / "cp"), "1 hour").awaitTermination()
    got = spark.read.parquet(path).orderBy("open_time").collect()
    assert [r["open"] for r in got][:2] == [1.0, 2.0] and len({r["open_time"] for r in got}) == len(got)


def test_shared_folder_needs_a_setting_on_a_cluster():
    from tidemark.staging import shared_dir

    class Context:
        master = "yarn"
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default: "hdfs://shared/")
    assert shared_dir(Session()) == "hdfs://shared"


def test_staged_tables_are_separate(spark):
    assert new_path(spark, "x") != new_path(spark, "x")


def test_indicators_from_the_tail_equal_a_full_run(spark, tmp_path):
    """A long series arrives in five files, another in the first and the last only; each batch sees only its bars and their tails."""
    import numpy as np

    from tidemark.operators import indicators

    folder, path, out, tail = (str(tmp_path / n) for n in ("in", "bars", "ind", "tail"))
    os.makedirs(folder)
    rng = np.random.default_rng(4)
    hours = np.cumsum(rng.integers(1, 4, 2500))
    values = ["ma50", "ema20", "rsi", "macd_signal", "annualized_vol"]
    step = live.refresh_indicators(out, tail, values, late_bars=24)
    price = 50 + 10 * rng.random(2500)
    every = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)), 1, "s", float(price[i]), "{}") for i, h in enumerate(hours)]
    other = [(9000 + k, at, 1, "t", value, "{}") for k, (_, at, _, _, value, _) in enumerate([*every[:100], *every[-60:]])]
    for part in range(5):
        more = other[:100] if part == 0 else other[100:] if part == 4 else []
        rows = spark.createDataFrame(every[part * 500 : part * 500 + 500] + more, live.EVENT_SCHEMA)
        rows.coalesce(1).write.parquet(f"{folder}/f{part}")
        live.run_bars(live.tick_stream(spark, f"{folder}/*"), "1h", path, str(tmp_path / "cp"), "1 day", after=step).awaitTermination()
    directory = spark.read.parquet(f"{tail}/directory").groupBy("batch", "symbol").agg(F.max("written")).collect()
    numbers = live.batch_ids(spark, f"{tail}/directory")
    assert len(numbers) == 2 and len(live.batch_ids(spark, f"{tail}/tails")) <= 3
    assert {tuple(row) for row in directory} == {(numbers[0], "s", numbers[0]), (numbers[0], "t", 0), (numbers[1], "s", numbers[1]), (numbers[1], "t", numbers[1])}
    assert spark.read.parquet(f"{tail}/tails").groupBy("batch", "symbol").count().agg(F.max("count")).first()[0] < 1000
    got = live.latest_versions(spark, out, values).orderBy("symbol", "open_time").toPandas()
    events = spark.createDataFrame(every + other, live.EVENT_SCHEMA)
    whole = indicators.all_indicators(indicators.numbered(bars.resample(as_ticks(events), "1h"))).orderBy("symbol", "open_time").toPandas()
    assert len(got) == len(whole) == 2660
    for v in values:
        np.testing.assert_allclose(got[v].astype(float), whole[v].astype(float), rtol=1e-9, atol=1e-9, err_msg=v)


def test_compacted_log_reads_the_same(spark, tmp_path):
    rows = [("s", "1h", dt.datetime(2024, 1, 1), 1.0), ("s", "1h", dt.datetime(2024, 1, 2), 2.0)]
    df = spark.createDataFrame(rows, "symbol string, bar string, open_time timestamp_ntz, close double")
    live.write_versions(df, str(tmp_path / "log"), 0)
    live.write_versions(df.where("close = 2").withColumn("close", F.lit(3.0)), str(tmp_path / "log"), 7)
    live.compact(spark, str(tmp_path / "log"), str(tmp_path / "short"), ["close"])
    for name in ("log", "short"):
        got = live.latest_versions(spark, str(tmp_path / name), ["close"]).orderBy("open_time").collect()
        assert [r["close"] for r in got] == [1.0, 3.0]
    assert live.latest_versions(spark, str(tmp_path / "log"), ["close"], "2024-01-02").count() == 1


def test_ledger_accounts_for_every_tick(spark, tmp_path):
    """Six ticks in three files; two come more than an hour late. A second start and a batch that runs again change nothing."""
    from tidemark.streaming import ledger

    folder, out, changed = str(tmp_path / "in"), str(tmp_path / "ledger"), {}
    os.makedirs(folder)

    def after(rows, batch_id):
        changed[batch_id] = sorted((r["open_time"].hour, r["open"], r["close"], r["trades"]) for r in rows.collect())

    for name, hours in (("f1", [(1, 0.1), (2, 5.5)]), ("f2", [(3, 5.6), (4, 1.0), (7, 5.55)]), ("f3", [(5, 8.0), (6, 2.5)])):
        land(spark, folder, name, hours)
        for _ in range(2):
            ledger.run_ledger(live.tick_stream(spark, f"{folder}/*"), "1h", out, str(tmp_path / "cp"), 3600, after).awaitTermination()
    assert changed == {0: [(0, 1.0, 1.0, 1), (5, 2.0, 2.0, 1)], 1: [(5, 2.0, 3.0, 3)], 2: [(8, 5.0, 5.0, 1)]}
    assert sorted((r["tick_id"], r["batch"]) for r in ledger.late_ticks(spark, out).collect()) == [(4, 1), (6, 2)]
    bars_ = {r["open_time"].hour: (r["open"], r["high"], r["low"], r["close"], r["trades"], r["volume"], r["quote_volume"]) for r in ledger.ledger_bars(spark, out).collect()}
    assert bars_ == {0: (1, 1, 1, 1, 1, 1, 1), 5: (2, 7, 2, 3, 3, 3, 12), 8: (5, 5, 5, 5, 1, 1, 5)}
    assert [tuple(r)[2:] for r in ledger.progress(spark, out).orderBy("batch").collect()] == [(2, 0), (3, 1), (2, 1)]


def test_ledger_without_ticks_that_count(spark, tmp_path):
    from tidemark.streaming import ledger

    folder, out = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows = [(1, dt.datetime(2024, 1, 1), 1, "s", None, "{}"), (2, dt.datetime(2024, 1, 1), 1, None, 1.0, None)]
    spark.createDataFrame(rows, live.EVENT_SCHEMA).write.parquet(f"{folder}/f1")
    land(spark, folder, "f2", [(3, 1.0)])
    ledger.run_ledger(live.tick_stream(spark, f"{folder}/*"), "1h", out, str(tmp_path / "cp")).awaitTermination()
    assert ledger.ledger_bars(spark, out).count() == 1 and ledger.late_ticks(spark, out).count() == 0


def test_a_replay_has_few_batches_however_many_files(spark, tmp_path, monkeypatch):
    from tidemark.plans import stream_plans

    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), 1, "aa", float(i), '{"k": 2}') for i in range(300)]
    events = spark.createDataFrame(rows, live.EVENT_SCHEMA)
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(live, "replay", lambda spark, events: (events.repartition(20, "event_id").write.parquet(str(tmp_path / "landed")), str(tmp_path / "landed"))[1])
    batches, write = [], live.write_versions
    monkeypatch.setattr(live, "write_versions", lambda rows, path, batch: (batches.append(batch), write(rows, path, batch)))
    bars = stream_plans.stream_ohlcv(spark, str(tmp_path)).collect()
    assert sum(r["trades"] for r in bars) == 300
    assert 2 <= len(batches) <= stream_plans.BATCHES
