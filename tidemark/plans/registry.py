"""All registered queries: name to (callable, check SQL or None)."""

from __future__ import annotations

from tidemark.plans import churn_plans, market_plans, model_plans, quality_plans, sales_plans, stream_plans

MODULES = [sales_plans, quality_plans, market_plans, churn_plans, model_plans, stream_plans]


def all_queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
