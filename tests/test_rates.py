"""Windows from the first hit, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from hopglass.operators import skew
from hopglass.streaming import tracking


def plain(rows, limit, width):
    out, last = {}, {}
    for key, at, order in sorted(rows):
        reset, n = last.get(key, (None, 0))
        if reset is None or reset <= at:
            reset, n = at + width, 0
        last[key] = (reset, n + 1)
        out[order] = (n + 1, n + 1 <= limit)
    return out


@pytest.mark.parametrize("width", [1, 7, 60, 100_000])
def test_windows_from_the_first_hit(spark, width):
    rnd = random.Random(width)
    rows, order = [], 0
    for key, n, step in (("hot", 900, 1), ("b", 40, 9), ("c", 1, 1), ("d", 60, 0)):  # most hits belong to one key; d: all at one moment
        at = rnd.randrange(100)
        for _ in range(n):
            at += rnd.randrange(step * 3 + 1) if step else 0
            rows.append((key, at, order))
            order += 1
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, id long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.id: (r.n_in_window, r.ok) for r in tracking.rate_flags(df.select("k", "id", "ts"), "k", "ts", "id", 3, width, hot_rows=50).collect()}
    assert got == plain(rows, 3, width)


def test_no_hits(spark):
    df = spark.createDataFrame([], "k string, id long, ts timestamp")
    assert tracking.rate_flags(df, "k", "ts", "id", 3, 60).collect() == []


def test_running_values(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = skew.running(df, ["x"], {"total": F.col("x")}, {"top": F.when(F.col("x") % 100 == 3, F.col("x"))}).collect()
    assert all(r.total == r.x * (r.x + 1) // 2 and r.top == (None if r.x < 3 else (r.x - 3) // 100 * 100 + 3) for r in got) and len(got) == 1000
