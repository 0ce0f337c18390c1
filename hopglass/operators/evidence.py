"""Evidence rows: the one shape every lane emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ["case_id", "analyzer", "signal", "status", "confidence", "detail"]


def row(signal: str | Column, status: str | Column, confidence: Column | float = 1.0, detail: Column | None = None,
        when: Column | None = None) -> Column:
    """One evidence struct; NULL (dropped later) when the condition is not true."""
    as_col = lambda v: F.lit(v) if isinstance(v, (str, float, int)) else v
    out = F.struct(as_col(signal).alias("signal"), as_col(status).alias("status"),
                   as_col(confidence).cast("double").alias("confidence"),
                   (F.to_json(detail) if detail is not None else F.lit(None).cast("string")).alias("detail"))
    return out if when is None else F.when(when, out)


def finding(signal: str, hit: Column, detail: Column | None = None, confidence: Column | float = 1.0) -> Column:
    """TRIGGERED when hit, otherwise CLEAR."""
    hit = F.coalesce(hit, F.lit(False))
    out = row(signal, F.when(hit, "TRIGGERED").otherwise("CLEAR"), confidence)
    return out.withField("detail", F.when(hit, F.to_json(detail))) if detail is not None else out


def emit(facts: DataFrame, analyzer: str, rows: list[Column]) -> DataFrame:
    """Explode several evidence structs of each case row: one pass, no unions."""
    # the array is a column before it is exploded, and the explode is an outer one:
    # otherwise the optimizer copies every expression into inferred predicates
    return (facts.select("case_id", F.array(*rows).alias("rows"))
            .select("case_id", F.lit(analyzer).alias("analyzer"), F.explode_outer("rows").alias("e"))
            .filter(F.col("e").isNotNull()).select("case_id", "analyzer", "e.*"))


def or_clear(rows: list[Column], fallback: Column) -> list[Column]:
    """The rows, plus ``fallback`` when none of them is present."""
    present = F.lit(False)
    for r in rows:
        present = present | r.isNotNull()
    return [*rows, F.when(~present, fallback)]
