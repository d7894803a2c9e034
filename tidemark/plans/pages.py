"""All tables of one report page by name.

Sorted bars, ranks and model scores are staged when a page is made; the rest
is lazy, so only what is read is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import (
    attribution,
    bars,
    correlation,
    evaluation,
    forecast,
    indicators,
    insights,
    learning,
    quality,
    sales,
    scoring,
    segments,
)
from tidemark.sources.files import parse_ticker


def sales_overview(lines: DataFrame, measure: str = "sales") -> dict[str, DataFrame]:
    """Figures, growth, trend, regions, categories, products, shipping and segments of filtered sales lines."""
    kpis = sales.executive_kpis(lines)
    return {
        "kpis": kpis,
        "kpi_labels": sales.kpi_labels(kpis),
        "growth": sales.revenue_growth(lines),
        "trend": sales.monthly_total(lines, measure),
        "regions": sales.total_by(lines, "region", measure),
        "categories": sales.total_by(lines, "category"),
        "products": sales.top_by(lines, "product_name"),
        "ship_modes": sales.value_counts(lines, "ship_mode"),
        "segments": sales.total_by(lines, "segment"),
    }


def sales_places(lines: DataFrame, measure: str = "sales") -> dict[str, DataFrame]:
    return {"states": sales.sales_by_state_code(lines, measure), "top_states": sales.top_by(lines, "state")}


def sales_customers(lines: DataFrame) -> dict[str, DataFrame]:
    return {
        "kpis": sales.customer_kpis(lines),
        "top_customers": sales.top_customers(lines),
        "processing_days": sales.processing_histogram(lines),
    }


def sales_outlook(lines: DataFrame, months: int = 30, measure: str = "sales") -> dict[str, DataFrame]:
    """History, forecast with band, and summary; the usual horizons are 30, 60, 90 and 120 months."""
    dense, ahead = forecast.sales_forecast(lines, months, measure)
    return {"history": dense, "forecast": ahead, "summary": forecast.forecast_summary(ahead, dense, ["series"])}


def market_page(ticks: DataFrame, bar: str, pair: tuple[str, str], vol_window: int = 20, horizon: int = 7) -> dict[str, DataFrame]:
    """Latest bars with all indicators, figures, rules, correlation of a pair, and the price forecast."""
    if not 7 <= vol_window <= 60:
        raise ValueError("the volatility window goes from 7 to 60 bars")
    latest = bars.latest_bars(bars.resample(ticks, bar))
    series = indicators.numbered(latest)
    full = indicators.all_indicators(series, vol_window)
    moves = indicators.returns(series.where(F.col("symbol").isin(*pair)))
    aligned = correlation.aligned_returns(moves, list(pair))
    pairs = correlation.pair_table(ticks.sparkSession, [(x, y) for x in pair for y in pair])
    rolled = correlation.rolling_correlation(aligned, *pair, vol_window)
    percent = full.select("symbol", (F.col("returns") * 100).alias("returns_pct"))
    return {
        "bars": bars.bar_direction(full),
        "kpis": insights.market_kpis(full, parse_ticker(bars.ticker_24h(ticks))),
        "volatility": indicators.volatility_change(full),
        "returns": sales.histogram(percent, "returns_pct", 40, ["symbol"]),
        "correlation": correlation.correlation_matrix(moves, pairs),
        "rolling_correlation": rolled,
        "correlation_insight": correlation.correlation_insight(rolled, *pair),
        "normalized": indicators.normalized_returns(series),
        "insights": insights.market_insights(full),
        "recent": indicators.tail_bars(series),
        "forecast": forecast.ols_forecast(series, horizon),
    }


def data_page(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "counts": quality.profile_counts(df),
        "missing": quality.missing_percent(df),
        "duplicates": quality.duplicate_rows(df),
        "columns": quality.column_info(df),
    }


def churn_page(model: learning.ChurnModel, levels: list[str] | None = None, floor: float = 0.0) -> dict[str, DataFrame]:
    """Model quality, queue, segments, drivers and messages of a fitted model."""
    scored, test = model.scored(), model.test_scores()
    segmented = segments.with_segments(scored, model.id_column)
    queue = scoring.risk_queue(scored, levels, floor, model.id_column)
    charge = segments.find_column(scored.columns, segments.C.CHARGE_KEYWORDS)
    importance = model.importance()
    tables = {
        "kpis": scoring.churn_kpis(scored),
        "metrics": model.metrics(),
        "confusion": evaluation.confusion(test, model.target, "Predicted_Churn"),
        "report": evaluation.report(test, model.target, "Predicted_Churn"),
        "roc": evaluation.roc_points(test, model.target, "Churn_Probability"),
        "queue": queue.select(*scoring.display_columns(queue, model.target)),
        "risk_distribution": scoring.risk_distribution(queue),
        "tenure": segments.mean_risk(segmented, "Tenure_Segment"),
        "payment": segments.mean_risk(segmented, "Payment_Segment"),
        "contract_mix": segments.contract_risk_mix(segmented),
        "heat_map": segments.tenure_charge_pivot(segmented),
        "importance": importance,
        "attribution": attribution.mean_abs_attribution(model),
        "drivers": insights.driver_text(importance),
        "insights": insights.business_insights(segmented),
        "summary": insights.executive_summary(scored, charge),
    }
    if charge:
        tables["charges"] = segments.charge_quartiles(scored, charge)
    return tables
