"""Operator 3: quality rules whose cutoffs are risk-controlled.

A rule rejects a text when one of its shares (symbols, capitals, repeated lines ...) reaches a cutoff.  The cutoffs come
from labelled documents.  In each stratum (language), each rule's cutoffs are tested one after another from lenient to
strict: the hypothesis "the rule rejects more than ``risk`` / rules of the good documents" is rejected when the exact
binomial tail of the observed false rejections is at most ``level`` / (strata x rules), Bonferroni's correction; testing
in a fixed order needs no further one.  The first hypothesis that stands ends the rule's tests.  So with probability
1 - ``level`` at most the share ``risk`` of a stratum's good documents is rejected by all rules together.  Among the
admitted cutoffs the one is taken that rejects most bad documents, a good one weighing ``WEIGHT`` bad ones; a rule that
gains nothing, or a stratum with too few labels, gets none.

A null text has no words.  Labels with a null quality or id, or of unknown documents, are not used; a null language is a
stratum of its own.  Repeated rows get a verdict each.  Without labels only the base rules act; no documents, no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopglass.session import cut

from .text_stats import NAMES, SHARES, counts, shares

#: Cutoffs are multiples of 1/GRID.
GRID = 64
WEIGHT = 20
#: So many strata are joined by broadcast (a row of a few integers each); more are joined by a shuffle.
BROADCAST_STRATA = 10_000

MEASURES = ", ".join(f"{n} long" for n in NAMES) + ", bins array<int>"
MEASURED = "struct<" + ", ".join(f"{n}: bigint" for n in NAMES) + ", bins: array<int>>"


def measure_texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow arrays of texts to arrays of the counts and binned shares."""
    for texts in arrays:
        found = np.array([counts(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, len(NAMES))
        bins = np.minimum(np.floor(shares(found) * GRID + 1e-9), GRID).astype(np.int32)
        yield pa.StructArray.from_arrays([*(pa.array(c) for c in found.T), pa.array(list(bins), pa.list_(pa.int32()))], [*NAMES, "bins"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and measures of every document, without its text."""

    def run(batches):
        for b in batches:
            for k in range(0, max(1, b.num_rows), 2000):
                part = b.slice(k, 2000)
                for m in measure_texts([part.column(2)]):
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], *m.flatten()], ["doc_id", "stratum", *NAMES, "bins"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(run, "doc_id long, stratum string, " + MEASURES)


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly up to rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = log.max()
    return min(1.0, math.exp(top + math.log(np.exp(log - top).sum())))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """The cutoff for counts by bin (0..GRID); GRID + 1 rejects nothing."""
    n, best, gain = int(good.sum()), GRID + 1, 0.0
    for c in range(GRID, 0, -1):
        wrong = int(good[c:].sum())
        if not n or wrong > risk * n or tail(wrong, n, risk) > level:
            break
        now = bad[c:].sum() / max(1, bad.sum()) - WEIGHT * wrong / n
        if now > gain + 1e-12:
            best, gain = c, now
    return best


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """stratum and the cutoff of each rule (array in the order of SHARES)."""
    rules = len(SHARES)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measures.select("doc_id", "stratum", F.posexplode("bins").alias("rule", "bin")).join(known, "doc_id")
    hist = cut(rows.groupBy("stratum", "rule", "bin").agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")))
    tests = hist.agg(F.countDistinct("stratum")).first()[0] * rules

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        got = np.zeros((2, rules, GRID + 1))
        for x in h.itertuples():
            got[0, x.rule, x.bin], got[1, x.rule, x.bin] = x.good, x.bad
        return pd.DataFrame({"stratum": [h["stratum"].iloc[0]], "cuts": [[choose(got[0, r], got[1, r], risk / rules, level / max(1, tests)) for r in range(rules)]]})

    return hist.groupBy("stratum").applyInPandas(fit, "stratum string, cuts array<int>")


def with_cutoffs(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (stratum, n_words, n_repeat_words, bins ...) with base_failed and kept."""
    table = cut(table)
    small = table.count() <= BROADCAST_STRATA
    rows = rows.join(F.broadcast(table) if small else table, "stratum", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fired = F.coalesce(F.exists(F.zip_with("bins", "cuts", lambda b, c: b >= c), lambda x: x), F.lit(False))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~fired}).drop("cuts")


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Measures, base_failed and kept of every document."""
    measures = cut(measured(docs))
    return with_cutoffs(measures, cutoffs(measures, labels, risk, level))


def passing(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    measure = F.arrow_udf(measure_texts, MEASURED).asNondeterministic()
    table = cutoffs(cut(measured(docs)), labels, risk, level)
    m = "__measures"
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), measure(F.coalesce(F.col("text"), F.lit(""))).alias(m))
    rows = rows.select("__row", "stratum", f"{m}.n_words", f"{m}.n_repeat_words", f"{m}.bins")
    return with_cutoffs(rows, table).filter("kept").select("__row.*")
