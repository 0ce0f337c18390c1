"""Operator 2: approximate nearest neighbours by adaptive dimension scan.

Index: k-means centres (fitted on a bounded sample), every vector in the list of its nearest centre, after a random rotation.
A query probes the lists of its nearest centres.  Inside a list the rotated vectors are scanned in blocks of columns: the
partial distance over the first d of D columns estimates the whole, and a candidate is abandoned as soon as the hypothesis
"its distance is at most the query's k-th best" is rejected, that is when partial * D / d > (1 + EPSILON / sqrt(d))**2 times
the k-th best squared distance so far.  Survivors get their exact distance on the original vectors in double precision.

The number of lists that are probed is measured: a bounded sample of queries is compared with all vectors by brute force, and
the fewest lists are taken that hold the share ``recall`` of their neighbours.  Lists are dealt out in parts of bounded size, so a
popular list (say of copies) is not one task; each part gives its best k per query, which are then merged.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.  Ties go to the
smaller vec_id; repeated rows are candidates each.  Fewer than k candidates: all.  An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table_cut

SAMPLE, QUERY_SAMPLE, MAX_LISTS, COLUMNS, EPSILON = 20_000, 64, 1024, 16, 2.1
#: Vectors that one task scans at a time.
PART_ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector array<double> of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by norms; good enough to choose lists."""
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def centres_of(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = squared(sample, centres).argmin(1)
        n = np.bincount(near, minlength=lists)
        for d in range(sample.shape[1]):
            centres[:, d] = np.where(n, np.bincount(near, sample[:, d], lists) / np.maximum(n, 1), centres[:, d])
    return centres


def scan(query: np.ndarray, rotated: np.ndarray, block: np.ndarray, limit: float, k: int) -> np.ndarray:
    """Rows of the rotated ``block`` that the tests leave over for the rotated query; limit: k-th best squared distance so far."""
    left, partial, total = np.arange(len(block)), np.zeros(len(block)), block.shape[1]
    for d in range(0, total, COLUMNS):
        diff = block[left, d : d + COLUMNS] - rotated[d : d + COLUMNS]
        partial = partial + (diff**2).sum(1)
        done = min(d + COLUMNS, total)
        if done < total and np.isfinite(limit):
            stay = partial * total / done <= (1 + EPSILON / np.sqrt(done)) ** 2 * limit
            left, partial = left[stay], partial[stay]
    return left


def best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, distances))[:k]


def search_part(data: pd.DataFrame, queries: pd.DataFrame, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a part of a list for each query that probes it."""
    if data.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    order = np.argsort(data["vec_id"].to_numpy(), kind="stable")
    ids, own = data["vec_id"].to_numpy()[order], np.array(data["vector"].tolist(), float)[order]
    blocks, out = own @ turn, []
    for query_id, vector in zip(queries["query_id"], queries["vector"], strict=True):
        q = np.array(vector, float)
        r, limit, got_ids, got = q @ turn, np.inf, np.zeros(0, np.int64), np.zeros(0)
        for s in range(0, len(ids), 512):
            left = s + scan(q, r, blocks[s : s + 512], limit, k)
            left = left[ids[left] != query_id]
            now = np.sqrt(((own[left] - q) ** 2).sum(1))
            got_ids, got = np.append(got_ids, ids[left]), np.append(got, now)
            keep = best(got_ids, got, k)
            got_ids, got = got_ids[keep], got[keep]
            limit = got[-1] ** 2 if len(got) == k else np.inf
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": got_ids, "score": got}))
    return pd.concat(out)


def lists_needed(rows: DataFrame, centres: np.ndarray, queries: list, k: int, recall: float) -> int:
    """Fewest lists per query that hold the share ``recall`` of the sampled queries' true neighbours (found by brute force)."""
    q_ids, q = np.array([r["vec_id"] for r in queries]), np.array([r["vector"] for r in queries], float)

    def run(batches):
        for b in batches:
            ids, own = b.column(0).to_numpy(), matrix(b.column(1))
            near = squared(own, centres).argmin(1)
            for i in range(len(q_ids)):
                other = np.flatnonzero(ids != q_ids[i])
                d = np.sqrt(((own[other] - q[i]) ** 2).sum(1))
                keep = best(ids[other], d, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), i)), pa.array(ids[other][keep]), pa.array(d[keep]), pa.array(near[other][keep])], ["q", "vec_id", "score", "list"])

    found = rows.mapInArrow(run, "q long, vec_id long, score double, list long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("rank") <= k).select("q", "list").toPandas()  # k rows per sampled query
    place = squared(q, centres).argsort(1).argsort(1)
    at = np.sort(place[found["q"].to_numpy(), found["list"].to_numpy()])
    return int(at[int(np.ceil(recall * len(at))) - 1]) + 1 if len(at) else 1


def neighbours(vectors: DataFrame, is_query, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds."""
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    width, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("vector") == width)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))
    some = np.array([r["vector"] for r in rows.filter(drawn).select("vector").limit(2 * sample).collect()], float)
    some = some if len(some) else np.array([r["vector"] for r in rows.limit(1).collect()], float)
    centres = centres_of(some, max(1, min(MAX_LISTS, int(np.sqrt(n) / 4), len(some))))
    asked = rows.filter(is_query)
    first = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(QUERY_SAMPLE).collect()
    if not first:
        return empty
    probes = lists_needed(rows, centres, first, k, recall)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(squared(matrix(b.column(1)), centres).argmin(1))], ["vec_id", "vector", "list"])

    def probe(batches):
        for b in batches:
            if b.num_rows:
                near = np.argpartition(squared(matrix(b.column(1)), centres), probes - 1, 1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (b.num_rows, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(near), pa.list_(pa.int64()))], ["query_id", "vector", "lists"])

    index = table_cut(rows.mapInArrow(assign, "vec_id long, vector array<double>, list long"))
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # one row per list
    index = index.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "parts").cast("int")).select("list", "part", "vec_id", "vector")
    asked = asked.mapInArrow(probe, "query_id long, vector array<double>, lists array<long>")
    asked = asked.select("query_id", "vector", F.explode("lists").alias("list")).join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")

    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search_part(data, queries, turn, k)

    found = index.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
