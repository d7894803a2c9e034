"""Tidemark: sales, market and churn analytics as Spark DataFrame jobs."""

from tidemark.session import apply_settings, get_session

__all__ = ["apply_settings", "get_session"]
