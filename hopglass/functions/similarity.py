"""Similarity of short labels (D04, D06) as vectorised helpers for distinct values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from . import fixed_values as fx


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one machine word per row of the table."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - bin(state).count("1")


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def decode_punycode(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        try:
            return v.encode("ascii").decode("idna")
        except (UnicodeError, ValueError):
            return v
    return s.map(one)


def brand_parts(brand: str) -> tuple[str, list[str]]:
    """Core label of a brand and its long words."""
    core = brand.lower().split(".")[0]
    return core, [t for t in (core.split("-")) if len(t) >= 4] or [core]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def near_brands(sig: pd.Series, tokens: pd.Series) -> pd.Series:
    """Per brand, two flags: the longest label is close; some token is close."""
    brands = [brand_parts(b) for b in fx.PROTECTED_BRANDS]
    out = []
    for label, words in zip(sig, tokens):
        flags: list[bool] = []
        for core, names in brands:
            long_enough = label is not None and len(core) >= 4
            flags.append(bool(long_enough and indel_ratio(label, core) >= 82))
            flags.append(bool(long_enough and any(indel_ratio(t, n) >= 85 for n in names if len(n) >= 5 for t in words)))
        out.append(flags)
    return pd.Series(out)
