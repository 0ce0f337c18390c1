"""Operator 9: token counts by an exact length histogram.

Documents are counted by encoded length (a combining aggregate); sums over the histogram then answer totals, quantiles
and truncated totals for every context limit.  The histogram has at most as many rows as the longest document has tokens.
Sums run inside ranges of ``RANGE`` lengths and are joined to the sums over whole ranges, so no task sees more than
``RANGE`` rows and the ranges' own table has (longest length / RANGE) rows.

A null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, steps
from .tokens import coder

RANGE = 4096


def lengths(docs: DataFrame, path: str, encode_special_tokens: bool = True) -> DataFrame:
    """doc_id and n_tokens of every document; ``encode_special_tokens`` as in ``tokens``."""

    def run(batches):
        chunks = coder(path, encode_special_tokens)
        for keys, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in chunks.encode(texts)], pa.int64())], ["doc_id", "n_tokens"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def by_limit(hist: DataFrame) -> DataFrame:
    """One row per occurring length L taken as context limit: documents of that length, of at least it and over it, the tokens
    of all documents up to it, the tokens left when every document is cut to L, and the share of documents that fit."""
    h = hist.withColumn("_range", F.floor(F.col("n_tokens") / RANGE)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    whole = h.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = whole.select("_range", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.sum("_d").over(everything).alias("_all"))
    inside = Window.partitionBy("_range").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_d1", F.sum("n_docs").over(inside)).withColumn("_t1", F.sum("_tokens").over(inside)).join(whole, "_range")
    fit, tokens = F.col("_d0") + F.col("_d1"), F.col("_t0") + F.col("_t1")
    over = F.col("_all") - fit
    return h.select(F.col("n_tokens").alias("context_limit"), "n_docs", (over + F.col("n_docs")).alias("docs_at_least"), over.alias("docs_over"), tokens.alias("tokens_within"),
                    (tokens + over * F.col("n_tokens")).alias("truncated_total"), (fit / F.col("_all")).alias("share_within"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of the documents does not exceed."""
    return limits.filter(F.col("share_within") >= q).agg(F.min("context_limit").alias("quantile"))
