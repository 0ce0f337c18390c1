"""Upserts that act, sinks, and lanes that fail."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hopglass.operators import lanes
from hopglass.sources import store


def mails(spark, ids):
    return spark.createDataFrame([("o", f"sha{i // 2}", f"c{i:03d}") for i in ids], "owner string, sha256 string, case_id string")


def scorer(version, calls=None):
    def score(cases):
        if calls is not None:
            calls.append(version)
        return cases.select("owner", "sha256", "bucket", "case_id", F.lit(version).alias("scorer_version"), F.length("case_id").alias("score"))
    return score


def stored(spark, path):
    return {r.sha256: (r.case_id, r.scorer_version) for r in store.read_cases(spark, path).collect()}


def test_upserts_interrupted_and_replayed(spark, tmp_path):
    path = str(tmp_path / "cases")
    store.upsert_cases(mails(spark, range(0, 20)), path, "b0", "1", scorer("1"), 4)
    first = stored(spark, path)
    assert len(first) == 10 and first["sha0"] == ("c000", "1")

    def broken(cases):
        return cases.select("owner", "sha256", "bucket", "case_id", F.raise_error(F.lit("cut off")).cast("string").alias("scorer_version"))

    with pytest.raises(Exception, match="cut off"):
        store.upsert_cases(mails(spark, range(10, 30)), path, "b1", "2", broken, 4)
    assert stored(spark, path) == first
    store.upsert_cases(mails(spark, range(11, 30)), path, "b1", "2", scorer("2"), 4)
    second = stored(spark, path)
    # stored under old rules: scored again under the same id; new: inserted; the others are not touched
    assert second["sha5"] == ("c010", "2") and second["sha14"] == ("c028", "2") and second["sha0"] == ("c000", "1") and len(second) == 15
    calls = []
    store.upsert_cases(mails(spark, range(0, 30)), path, "b1", "3", scorer("3", calls), 4)
    assert calls == [] and stored(spark, path) == second
    store.upsert_cases(mails(spark, range(20, 30)), path, "b2", "2", scorer("2"), 4)  # all current: nothing to do
    assert stored(spark, path) == second
    assert store.read_cases(spark, path).count() == 15


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "cases")
    store.upsert_cases(mails(spark, range(0, 200)), path, "b0", "1", scorer("1"), 16)
    before = store._live(store._manifest(spark, path))
    store.upsert_cases(mails(spark, [500]), path, "b1", "1", scorer("1"), 16)
    after = store._live(store._manifest(spark, path))
    assert len(before) == 16 and sum(before[b] != after[b] for b in after) == 1 and len(stored(spark, path)) == 101


def test_a_batch_given_twice_is_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, None)], "case_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for batch in ("a", "b", "b"):
        store.append(rows, "hops", str(tmp_path), batch)
    got = store.read_sink(spark, "hops", str(tmp_path))
    assert sorted((r.case_id, str(r.day), r.batch) for r in got.collect()) == [(1, "2024-01-01", "a"), (1, "2024-01-01", "b"), (2, "1970-01-01", "a"), (2, "1970-01-01", "b")]


ROW = "case_id string, analyzer string, signal string, status string, confidence double, detail string"


def test_lanes_fail_alone(spark):
    ctx = {"messages": spark.createDataFrame([("a",), ("b",)], "case_id string")}
    before = dict(lanes.LANES)

    def raising(ctx):
        raise KeyError("no such table")

    def failing_in_a_task(ctx):
        return ctx["messages"].select("case_id", F.lit("X2").alias("analyzer"), F.raise_error(F.lit("bad row")).cast("string").alias("signal"), F.lit("CLEAR").alias("status"), F.lit(1.0).alias("confidence"), F.lit("").alias("detail"))

    def endless(ctx):
        @F.pandas_udf("string")
        def wait(ids: pd.Series) -> pd.Series:
            time.sleep(600)
            return ids

        return ctx["messages"].select(wait("case_id").alias("case_id"), F.lit("X3").alias("analyzer"), F.lit("s").alias("signal"), F.lit("CLEAR").alias("status"), F.lit(1.0).alias("confidence"), F.lit("").alias("detail"))

    def good(ctx):
        return ctx["messages"].select("case_id", F.lit("X4").alias("analyzer"), F.lit("seen").alias("signal"), F.lit("TRIGGERED").alias("status"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("detail"))

    try:
        lanes.LANES.update(X1=raising, X2=failing_in_a_task, X3=endless, X4=good)
        start = time.monotonic()
        rows = lanes.run_lanes(ctx, ["X1", "X2", "X3", "X4"], lane_timeouts={"X3": 3.0}).orderBy("case_id", "pos").collect()
        assert time.monotonic() - start < 120
    finally:
        lanes.LANES.clear()
        lanes.LANES.update(before)
    assert [(r.case_id, r.analyzer, r.signal, r.status, r.pos) for r in rows] == [
        (c, *x) for c in "ab" for x in (("X1", "lane_error", "ERROR", 0), ("X2", "lane_error", "ERROR", 1), ("X3", "lane_timeout", "UNAVAILABLE", 2), ("X4", "seen", "TRIGGERED", 3))]
    assert '"error":"KeyError"' in rows[0].detail and "bad row" in rows[1].detail and rows[2].detail == '{"reason":"exceeded 3 s"}'
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
