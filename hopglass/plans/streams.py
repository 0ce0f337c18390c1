"""Queries T01-T08."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators import dims, scoring
from ..session import ensure_checkpoint_dir
from ..streaming import feed, tracking as tr
from . import oracle_parts as o
from .registry import query


def work_dir(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def event_stream(src, max_files: int = 1):
    schema = src.events.schema
    return (src.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", max_files).parquet(src.sf_dir))


def split_stream(src, files: int = 4):
    """The events as a stream of several files, one a micro-batch; each spans all times, so every file but the first holds
    rows that come late."""
    folder = f"{work_dir(src.spark)}/in"
    for k in range(files):  # written one after the other: file k is micro-batch k
        src.events.filter(F.pmod("event_id", F.lit(files)) == k).coalesce(1).write.mode("append").parquet(folder)
    return src.spark.readStream.schema(src.events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


_RULES = [(r[1], r[3]) for r in dims.rule_rows() if r[0] == dims.LATEST][:39]
_EV = f"""ev AS (SELECT e.user_id * 100000 + e.event_id % 7 AS case_id, CAST(e.event_id AS INT) AS pos, s.analyzer, s.signal,
    CASE e.event_type WHEN 'error' THEN 'UNAVAILABLE' WHEN 'signup' THEN 'CLEAR' ELSE 'TRIGGERED' END AS status, CAST(e.event_id % 16 + 1 AS DOUBLE) / 16 AS confidence, CAST(NULL AS STRING) AS detail
    FROM events e JOIN d_signals s ON s.idx = e.event_id % 41)"""


@query("t01_live_feed", f"""WITH {_EV}, {o.verdict_ctes(evidence='ev')}, i AS (SELECT DISTINCT user_id * 100000 + event_id % 7 AS case_id, 'ip:' || CAST(event_id % 50 AS STRING) AS v FROM events WHERE event_id % 3 = 0
      UNION SELECT user_id * 100000 + event_id % 7, 'url:u' || CAST(event_id % 20 AS STRING) FROM events WHERE event_id % 3 = 1),
    il AS (SELECT case_id, string_agg(v, ',' ORDER BY v) AS indicators FROM i GROUP BY 1)
    SELECT v.case_id, 'case_scored' AS event, score, band, CAST(confidence AS DOUBLE) AS confidence, coalesce(indicators, '') AS indicators FROM verdict v LEFT JOIN il ON il.case_id = v.case_id""")
def t01(src):
    """Evidence stream of several files; each micro-batch scores the cases it touches from all their evidence so far."""
    signals = src.d_signals
    kind = F.when(F.col("event_id") % 3 == 0, "ip").when(F.col("event_id") % 3 == 1, "url")
    value = F.when(kind == "ip", (F.col("event_id") % 50).cast("string")).otherwise(F.concat(F.lit("u"), (F.col("event_id") % 20).cast("string")))
    stream = split_stream(src).select(
        (F.col("user_id") * 100000 + F.col("event_id") % 7).alias("case_id"), F.col("event_id").cast("int").alias("pos"), (F.col("event_id") % 41).alias("idx"),
        F.when(F.col("event_type") == "error", "UNAVAILABLE").when(F.col("event_type") == "signup", "CLEAR").otherwise("TRIGGERED").alias("status"),
        ((F.col("event_id") % 16 + 1) / 16).alias("confidence"), F.lit(None).cast("string").alias("detail"), kind.alias("kind"), value.alias("value")).join(signals, "idx")
    d = work_dir(src.spark)
    feed.verdict_stream(stream, scoring.score_cases, f"{d}/out", f"{d}/checkpoint").awaitTermination()
    rows = feed.newest_verdicts(src.spark, f"{d}/out")
    return rows.withColumn("indicators", F.array_join(F.transform("indicators", lambda i: F.concat_ws(":", i["kind"], i["value"])), ",")).drop("summary")


@query("t02_inbox_scan", "SELECT DISTINCT event_id // 3 AS msg_id FROM events WHERE event_type NOT IN ('click', 'error')")
def t02(src):
    labels = F.when(F.col("event_type") == "click", F.array(F.lit("INBOX"), F.lit("SENT"))).when(F.col("event_type") == "error", F.array(F.lit("DRAFT"))).otherwise(F.array(F.lit("INBOX")))
    stream = split_stream(src).select(F.expr("event_id div 3").alias("msg_id"), F.col("ts").cast("timestamp").alias("at"), labels.alias("labels"))
    d = work_dir(src.spark)
    feed.inbox_scan(stream, f"{d}/out", f"{d}/checkpoint").awaitTermination()
    return src.spark.read.parquet(f"{d}/out").select("msg_id")


@query("t03_retry_plan", """WITH p AS (SELECT event_id // 9 AS msg_id, bool_or(event_type = 'view' AND event_id % 4 = 0) AS done, count(*) FILTER (event_type <> 'view' AND value < 30) AS tries,
      bool_or(event_type <> 'view' AND value > 60) AS fatal FROM events GROUP BY 1)
    SELECT msg_id, tries, CASE WHEN done THEN 'done' WHEN fatal OR tries > 4 THEN 'dead_letter' ELSE 'retry' END AS action FROM p""")
def t03(src):
    view = F.col("event_type") == "view"
    outcome = F.when(view & (F.col("event_id") % 4 == 0), "ok").when(~view & (F.col("value") < 30), "transient").when(~view & (F.col("value") > 60), "fatal").otherwise("other")
    return tr.retry_plan(src.events.select(F.expr("event_id div 9").alias("msg_id"), outcome.alias("outcome")))


_OK = f"regexp_matches(id, '{fx.TRACK_ID_PATTERN}')"


@query("t04_open_counts", f"SELECT id, count(*) AS opens, CAST(max(d_track_opens.\"at\") AS STRING) AS last_open FROM d_track_opens WHERE {_OK} GROUP BY id")
def t04(src):
    return tr.open_counts(tr.clean_opens(src.d_track_opens)).withColumn("last_open", F.col("last_open").cast("string"))


@query("t05_tracked_mail", f"""WITH c AS (SELECT id, count(*) AS opens FROM d_track_opens WHERE {_OK} GROUP BY id)
    SELECT coalesce(s.id, c.id) AS id, s.owner, s.subject, coalesce(c.opens, 0) AS opens, coalesce(c.opens, 0) > 0 AS opened FROM d_track_sends s FULL JOIN c ON c.id = s.id""")
def t05(src):
    return tr.tracked_mail(tr.clean_sends(src.d_track_sends), tr.clean_opens(src.d_track_opens)).select("id", "owner", "subject", "opens", "opened")


@query("t05_tracked_mail_stream", """WITH e AS (SELECT 'track-' || lpad(CAST(user_id AS STRING), 6, '0') AS id, event_type, user_id, ts FROM events WHERE event_type IN ('view', 'signup'))
    SELECT id, CASE WHEN bool_or(event_type = 'signup') THEN 'owner' || CAST(max(user_id) % 5 AS STRING) END AS owner, count(*) FILTER (event_type = 'view') AS opens FROM e GROUP BY id""")
def t05_stream(src):
    owner = F.concat(F.lit("owner"), (F.col("user_id") % 5).cast("string"))
    e = split_stream(src).filter(F.col("event_type").isin("view", "signup")).select(
        F.when(F.col("event_type") == "view", "open").otherwise("send").alias("kind"), F.concat(F.lit("track-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("id"),
        owner.alias("owner"), F.lit("s").alias("subject"), F.col("ts").cast("timestamp").alias("at"))
    d = work_dir(src.spark)
    put = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{d}/out/batch={n}")
    tr.track_stream(e).writeStream.outputMode("update").option("checkpointLocation", f"{d}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    rows = src.spark.read.parquet(f"{d}/out")
    return rows.groupBy("id").agg(F.max_by(F.struct("owner", "opens"), "n").alias("r")).select("id", "r.owner", "r.opens")


@query("t06_clean_opens", f"SELECT id, event_id, ua FROM d_track_opens WHERE {_OK}")
def t06(src):
    return tr.clean_opens(src.d_track_opens).select("id", "event_id", "ua")


@query("t07_rate_flags", """WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, k, us + 86400000000 AS reset, 1 AS n FROM h WHERE k = 1
      UNION ALL SELECT h.user_id, h.event_id, h.k, CASE WHEN w.reset <= h.us THEN h.us + 86400000000 ELSE w.reset END, CASE WHEN w.reset <= h.us THEN 1 ELSE w.n + 1 END
      FROM w JOIN h ON h.user_id = w.user_id AND h.k = w.k + 1)
    SELECT user_id, event_id, n AS n_in_window, n <= 2 AS ok FROM w""")
def t07(src):
    return tr.rate_flags(src.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 2, 86400).drop("ts")


@query("t07_aligned_rate", "SELECT user_id, CAST(date_trunc('hour', ts) AS STRING) AS window_start, count(*) AS n, count(*) > 1 AS over_limit FROM events GROUP BY user_id, date_trunc('hour', ts)")
def t07_aligned(src):
    return tr.aligned_rate(src.events, "user_id", "ts", 1, "1 hour").withColumn("window_start", F.col("window_start").cast("string"))


_IND = """ind AS (SELECT 'o' || CAST(user_id % 3 AS STRING) AS owner, event_id AS case_id, ts AS arrival, event_id % 4 AS batch, 'ip' AS kind, 'v' || CAST(user_id * 40 + event_id % 40 AS STRING) AS value FROM events
      UNION ALL SELECT 'o' || CAST(user_id % 3 AS STRING), event_id, ts, event_id % 4, 'url', 'u' || CAST(user_id * 7 + event_id // 4 % 9 AS STRING) FROM events)"""


@query("t08_stream_correlation", f"""WITH {_IND},
    p AS (SELECT a.owner, a.case_id, b.case_id AS other, count(*) AS n FROM ind a JOIN ind b ON a.owner = b.owner AND a.kind = b.kind AND a.value = b.value AND a.case_id <> b.case_id
      AND (b.batch < a.batch OR b.batch = a.batch AND (b.arrival, b.case_id) < (a.arrival, a.case_id)) GROUP BY 1, 2, 3),
    g AS (SELECT owner, case_id, count(*) AS related_cases, max(n) AS shared FROM p GROUP BY 1, 2)
    SELECT c.owner, c.case_id, coalesce(related_cases, 0) AS related_cases, coalesce(shared, 0) AS shared_indicator_count FROM (SELECT DISTINCT owner, case_id FROM ind) c LEFT JOIN g ON g.owner = c.owner AND g.case_id = c.case_id""")
def t08(src):
    """Four files, each spanning all times: a case that comes late still meets the stored ones, and each pair is reported once."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    found = F.array(pair("ip", F.concat(F.lit("v"), F.col("user_id") * 40 + F.col("event_id") % 40)), pair("url", F.concat(F.lit("u"), F.col("user_id") * 7 + F.expr("event_id div 4") % 9)))
    stream = split_stream(src).select(F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string")).alias("owner"), F.col("event_id").alias("case_id"),
                                      F.col("ts").alias("arrival"), F.explode(found).alias("i")).select("owner", "case_id", "arrival", "i.kind", "i.value")
    d = work_dir(src.spark)
    feed.correlation_stream(stream, f"{d}/store", f"{d}/out", f"{d}/checkpoint", 20).awaitTermination()
    return src.spark.read.parquet(f"{d}/out").select("owner", "case_id", "related_cases", "shared_indicator_count")
