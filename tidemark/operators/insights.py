"""Rules that turn indicator and segment tables into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.numbers import amount_of, ratio
from tidemark.functions.text import dollars, fill, fixed, grouped, percent
from tidemark.operators.bars import KEYS

_STATE = ["close", "rsi", "macd", "macd_signal", "ma20", "ma50", "bb_upper", "bb_lower", "annualized_vol"]


def latest_state(indicators: DataFrame) -> DataFrame:
    """The last row of each series with the MACD values of the row before it."""
    ends = indicators.where(F.col("pos") >= F.col("n") - 2)
    last, before = F.col("pos") == F.col("n") - 1, F.col("pos") == F.col("n") - 2
    read = [c for c in [*_STATE, "quote_volume"] if c in indicators.columns]
    return ends.groupBy(*KEYS, "n").agg(
        *[F.max(F.when(last, F.col(c))).alias(c) for c in read],
        F.max(F.when(before, F.col("macd"))).alias("prev_macd"),
        F.max(F.when(before, F.col("macd_signal"))).alias("prev_signal"),
    )


def _message(name: str, **parts: Column) -> Column:
    badge, label, text = C.MARKET_TEXTS[name]
    body = fill(text, **parts) if parts else F.lit(text)
    return F.struct(F.lit(badge).alias("badge"), F.lit(label).alias("label"), body.alias("text"))


def market_insights(indicators: DataFrame, least_bars: int = 30) -> DataFrame:
    """Messages per series from its latest bar; none for a series under ``least_bars``.

    A rule with a missing input stays silent.
    """
    state = latest_state(indicators).where(F.col("n") >= least_bars)
    c = {name: F.col(name) for name in [*_STATE, "prev_macd", "prev_signal"]}
    symbol = F.replace(F.col("symbol"), F.lit("USDT"), F.lit(""))
    rsi_text = {"symbol": symbol, "rsi": fixed(c["rsi"], 1)}
    ma_text = {"ma20": grouped(c["ma20"]), "ma50": grouped(c["ma50"])}
    macd_text = {"macd": fixed(c["macd"], 2)}
    has_prev = c["prev_macd"].isNotNull() & (F.col("n") > 2)
    above, below = c["macd"] > c["macd_signal"], c["macd"] < c["macd_signal"]
    width = ratio(c["bb_upper"] - c["bb_lower"], c["close"]) * 100
    vol = c["annualized_vol"] * 100
    vol_text = {"vol": fixed(vol, 1)}
    rules = [
        F.when(c["rsi"] > 70, _message("overbought", **rsi_text))
        .when(c["rsi"] < 30, _message("oversold", **rsi_text))
        .when(c["rsi"].isNotNull(), _message("rsi_neutral", **rsi_text)),
        F.when(above & (~has_prev | (c["prev_macd"] <= c["prev_signal"])), _message("cross_up"))
        .when(below & (~has_prev | (c["prev_macd"] >= c["prev_signal"])), _message("cross_down"))
        .when(c["macd_signal"].isNotNull() & (c["macd"] > 0), _message("trend_up", **macd_text))
        .when(c["macd_signal"].isNotNull() & c["macd"].isNotNull(), _message("trend_down", **macd_text)),
        F.when(c["ma20"] > c["ma50"], _message("golden", **ma_text))
        .when(c["ma20"] <= c["ma50"], _message("death", **ma_text)),
        F.when(c["close"] > c["bb_upper"], _message("above_band"))
        .when(c["close"] < c["bb_lower"], _message("below_band")),
        F.when(width < 5, _message("narrow_band", width=fixed(width, 1))),
        F.when(vol > 80, _message("high_vol", **vol_text)).when(vol < 30, _message("low_vol", **vol_text)),
    ]
    listed = state.select(*KEYS, F.posexplode(F.array(*rules)).alias("ord", "_m")).where("_m IS NOT NULL")
    return listed.select(*KEYS, "ord", "_m.badge", "_m.label", "_m.text")


def market_kpis(indicators: DataFrame, ticker: DataFrame) -> DataFrame:
    """One row of figures and classes per series; missing inputs fall to the middle class."""
    state = latest_state(indicators).join(ticker, "symbol", "left")
    vol, rsi = F.col("annualized_vol") * 100, F.col("rsi")
    change = F.coalesce("change_pct", F.lit(0.0))
    return state.select(
        *KEYS,
        F.coalesce("last_price", "close").alias("price"),
        change.alias("change_pct"),
        (change >= 0).alias("is_up"),
        F.coalesce("quote_volume_24h", "quote_volume").alias("volume_24h"),
        vol.alias("ann_vol_pct"),
        F.when(vol > 80, "High").when(vol < 30, "Low").otherwise("Moderate").alias("vol_regime"),
        rsi.alias("rsi"),
        F.when(rsi > 70, "Overbought").when(rsi < 30, "Oversold").otherwise("Neutral").alias("rsi_class"),
        F.when(F.col("macd") > F.col("macd_signal"), "Bullish").otherwise("Bearish").alias("macd_class"),
        F.col("macd"),
        F.col("macd_signal"),
    )


def _pair(text: tuple[str, str], **parts: Column) -> Column:
    title, body = text
    return F.struct(F.lit(title).alias("title"), (fill(body, **parts) if parts else F.lit(body)).alias("body"))


def business_insights(segmented: DataFrame) -> DataFrame:
    """High-risk rate and the segment with the highest mean probability in three dimensions.

    One grouping-sets pass gives all means; on a tie the smaller label wins.
    """
    p, high = F.col("Churn_Probability"), (F.col("Risk_Level") == C.RISK_LEVELS[2]).cast("int")
    dims = ["Tenure_Segment", "Contract_Segment", "Payment_Segment"]
    sets = segmented.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.avg(p).alias("mean_p"), F.avg(high).alias("high_rate")
    )
    full = (1 << len(dims)) - 1
    facts = [F.max(F.when(F.col("gid") == full, F.col("high_rate"))).alias("high_rate")]
    for i, d in enumerate(dims):
        mine = F.col("gid") == full - (1 << (len(dims) - 1 - i))
        worst = F.struct((-F.round("mean_p", 12)).alias("k"), F.col(d).alias("segment"), F.col("mean_p"))
        facts.append(F.min(F.when(mine & F.col(d).isNotNull(), worst)).alias(d))
    row = sets.agg(*facts)
    messages = [
        _pair(C.RETENTION_TEXTS["queue"], rate=percent("high_rate")),
        F.when(
            F.col("Tenure_Segment").isNotNull(),
            _pair(C.RETENTION_TEXTS["tenure"], segment=F.col("Tenure_Segment.segment"), rate=percent("Tenure_Segment.mean_p")),
        ),
        F.when(F.col("Contract_Segment").isNotNull(), _pair(C.RETENTION_TEXTS["contract"], segment=F.col("Contract_Segment.segment"))),
        F.when(F.col("Payment_Segment").isNotNull(), _pair(C.RETENTION_TEXTS["payment"], segment=F.col("Payment_Segment.segment"))),
    ]
    listed = row.select(F.posexplode(F.array(*messages)).alias("ord", "_m")).where("_m IS NOT NULL")
    return listed.select("ord", "_m.title", "_m.body")


def executive_summary(scored: DataFrame, charge: str | None = "MonthlyCharges") -> DataFrame:
    """Churn rate, high-risk count and revenue at risk as four messages, from one pass."""
    high = F.col("Risk_Level") == C.RISK_LEVELS[2]
    facts = [
        F.avg("Predicted_Churn").alias("rate"),
        F.avg("Churn_Probability").alias("mean"),
        F.count_if(high).alias("high"),
    ]
    impact = _pair(C.SUMMARY_TEXTS["no_impact"])
    if charge in scored.columns:
        amount = F.sum(F.when(high, amount_of(scored, charge))).cast("double")
        facts.append(F.coalesce(amount, F.lit(0.0)).alias("revenue"))
        impact = _pair(C.SUMMARY_TEXTS["impact"], revenue=dollars("revenue"))
    row = scored.agg(*facts)
    messages = [
        _pair(C.SUMMARY_TEXTS["trend"], rate=percent("rate"), mean=percent("mean")),
        _pair(C.SUMMARY_TEXTS["risk"], high=grouped("high")),
        _pair(C.SUMMARY_TEXTS["advice"]),
        impact,
    ]
    return row.select(F.posexplode(F.array(*messages)).alias("ord", "_m")).select("ord", "_m.title", "_m.body")


def driver_text(importance: DataFrame, top: int = 3) -> DataFrame:
    """One sentence naming the strongest features."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(top)
    names = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("k"), "feature"))).alias("f"))
    joined = F.array_join(F.transform("f", lambda s: F.replace(s["feature"], F.lit("_"), F.lit(" "))), ", ")
    text = F.when(F.size("f") == 0, F.lit(C.DRIVERS_NONE)).otherwise(fill(C.DRIVERS_TEXT, features=joined))
    return names.select(text.alias("interpretation"))
