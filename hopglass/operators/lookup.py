"""Facts that depend on one attribute only (a domain, an address) are computed
once per distinct value and joined back without overloading a popular value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .skew import HOT_ROWS, hot_keys, join_on_hot_key


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``facts`` has at most one row per ``key``; the popular keys of ``rows`` are salted."""
    return join_on_hot_key(rows, facts, [key], hot_keys(rows.select(key), [key], hot_rows), how)
