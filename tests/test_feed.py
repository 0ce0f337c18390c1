"""The live feed over several micro-batches."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from hopglass.streaming import feed


def files(spark, rows, path, parts=4):
    for k in range(parts):
        rows.filter(F.col("n") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_case_whose_evidence_spans_batches_has_one_verdict_on_all_of_it(spark, tmp_path):
    rows = spark.range(12).selectExpr("id as n", "id % 3 as case_id", "cast(id as int) as pos", "'M2' as analyzer", "concat('s', id) as signal", "'TRIGGERED' as status", "double(id) as confidence",
                                      "cast(null as string) as detail", "if(id % 2 = 0, 'ip', null) as kind", "concat('v', id % 4) as value")
    score = lambda e: e.groupBy("case_id").agg(F.sum("confidence").alias("score"), F.count("*").alias("n")).select("case_id", "score", F.lit("B").alias("band"), F.lit(1.0).alias("confidence"), F.col("n").cast("string").alias("summary"))
    feed.verdict_stream(files(spark, rows, f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 4
    got = {r.case_id: (r.event, r.score, r.summary, [tuple(i) for i in r.indicators]) for r in feed.newest_verdicts(spark, f"{tmp_path}/out").collect()}
    assert got == {c: ("case_scored", s, "4", [("ip", "v0"), ("ip", "v2")]) for c, s in ((0, 18.0), (1, 22.0), (2, 26.0))}


def test_seen_ids_are_state_of_the_stream(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as n", "id % 9 as msg_id", "timestamp_seconds(id) as at", "if(id % 9 = 2, array('INBOX', 'SENT'), array('INBOX')) as labels")
    stream = files(spark, rows, f"{tmp_path}/in")
    feed.inbox_scan(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(r.msg_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0, 1, 3, 4, 5, 6, 7, 8]
    rows.selectExpr("n + 100 as n", "msg_id + 5 as msg_id", "at", "labels").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # a later run goes on from the state
    feed.inbox_scan(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    later = sorted(r.msg_id for r in spark.read.parquet(f"{tmp_path}/out").filter("batch >= 4").collect())
    assert later == [9, 10, 11, 12, 13]


def test_live_feed_gives_each_case_once(spark):
    got = entry.queries()["t01_live_feed"](spark, "/root/testdata/sf0.001").cache()
    assert got.count() == got.select("case_id").distinct().count() > 0
