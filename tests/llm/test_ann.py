"""Operator 2 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from hopglass.llm import ann


def brute(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            keep = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), d[j]) for j in keep]
    return out


def found(df):
    out = {}
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_and_scores_with_a_popular_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    x[1000:4000] = x[7] + rng.normal(size=(3000, 32)) * 1e-3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, near in got.items():
        exact = dict(brute([r for r in rows if r[0] in {i for i, _ in near} | {q}], 10)[q])
        assert len(near) == 10 and all(abs(exact[i] - s) < 1e-12 for i, s in near) and near == sorted(near, key=lambda t: (t[1], t[0]))


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall(found(df), brute([(r["vec_id"], r["embedding"]) for r in df.collect()])) >= 0.9


def test_odd_vectors_ties_few_rows_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y", 1.0) for i, v in rows], "vec_id long, embedding array<float>, vector string, list string, score double").repartition(3)
    got = found(df)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {0: [100, 2, 3], 100: [0, 2, 3]}
    assert found(df.limit(0)) == {} and found(df.filter("vec_id = 3")) == {}


def test_the_scan_abandons_far_candidates_and_keeps_near_ones():
    rng = np.random.default_rng(1)
    block, turn = rng.normal(size=(500, 64)), np.linalg.qr(rng.normal(size=(64, 64)))[0]
    q = block[3] + 0.05 * rng.normal(size=64)
    left = ann.scan(q, q @ turn, block @ turn, 1.0, 10)
    assert 3 in left and len(left) < 20
