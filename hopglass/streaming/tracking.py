"""Open tracking, rate windows and retries (T03-T07), batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fx
from ..operators.skew import HOT_ROWS, hot_keys, join_on_hot_key, running
from ..session import cut

MAX_TRIES = 4


def clean_opens(opens: DataFrame) -> DataFrame:
    """Ids must be well formed; every field is kept whole."""
    tidy = F.regexp_replace("id", r"(?i)\.gif$", "")
    return opens.withColumn("id", tidy).filter(F.col("id").rlike(fx.TRACK_ID_PATTERN))


def clean_sends(sends: DataFrame) -> DataFrame:
    return (sends.withColumn("id", F.trim("id")).filter(F.col("id").rlike(fx.TRACK_ID_PATTERN))
            .withColumn("subject", F.coalesce("subject", F.lit("(no subject)"))))


def open_counts(opens: DataFrame) -> DataFrame:
    """Opens per tracked mail; a streaming input gives a running aggregate."""
    return opens.groupBy("id").agg(F.count("*").alias("opens"), F.max("at").alias("last_open"))


def tracked_mail(sends: DataFrame, opens: DataFrame) -> DataFrame:
    """Registrations and opens in any order; unregistered opens are kept.
    The latest registration of an id wins, its first creation time stays."""
    s = sends.groupBy("id").agg(F.max_by(F.struct("owner", "subject", "rcpt"), "created_at").alias("s"), F.min("created_at").alias("created_at")).select("id", "s.*", "created_at")
    return (s.join(open_counts(opens), "id", "full_outer").withColumn("opens", F.coalesce("opens", F.lit(0)))
            .withColumn("opened", F.col("opens") > 0))


TRACK_STATE = "owner string, subject string, sent_at timestamp, opens long, last_open timestamp"
TRACK_ROW = "id string, owner string, subject string, opens long, last_open timestamp"


def track_updates(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """T05 as a stream: constant state per id, whichever half arrives first; the newest
    registration holds, also when an older one comes late."""
    owner, subject, sent, opens, last = state.get if state.exists else (None, None, None, 0, None)
    for pdf in batches:
        sends = pdf[pdf["kind"] == "send"]
        if len(sends):
            row = sends.sort_values("at").iloc[-1]
            if sent is None or row["at"] >= pd.Timestamp(sent):
                owner, subject, sent = row["owner"], row["subject"], row["at"]
        seen = pdf[pdf["kind"] == "open"]
        opens += len(seen)
        if len(seen):
            newest = seen["at"].max()
            last = newest if last is None or newest > pd.Timestamp(last) else last
    plain = lambda t: None if t is None else pd.Timestamp(t).to_pydatetime()
    state.update((owner, subject, plain(sent), opens, plain(last)))
    yield pd.DataFrame({"id": [key[0]], "owner": [owner], "subject": [subject], "opens": [opens], "last_open": [pd.Timestamp(last) if last is not None else pd.NaT]})


def track_stream(events: DataFrame) -> DataFrame:
    """``events``: kind (send/open), id, owner, subject, at (timestamp)."""
    return events.groupBy("id").applyInPandasWithState(track_updates, TRACK_ROW, TRACK_STATE, "update", GroupStateTimeout.NoTimeout)


def rate_flags(hits: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fixed windows that start at the first hit of a key; hits beyond the limit are flagged.  ``order`` is unique.

    Each hit points at the first hit outside the window that would start with it: the number of hits before the window's end in the
    order of (key, time).  Windows start at the first hit of each key and wherever a pointer of a start leads; starts are found by
    doubling the pointers, in a logarithmic number of rounds.  (The pointer out of a key's last window leads to the first hit of the next
    key, a start anyhow.)  All steps work on positions, so a key that holds most hits is spread over all tasks."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    row = hits.withColumns({"_us": us, "_hit": F.lit(1)})
    ends = row.select(key, order, (F.col("_us") + window_seconds * 1_000_000).alias("_us"), F.lit(0).alias("_hit"))
    # a window's end comes before a hit of the same moment, which lies outside
    merged = running(row.unionByName(ends, allowMissingColumns=True), [key, "_us", "_hit", order], {"_count": F.col("_hit")})
    after = merged.filter("_hit = 0").select(key, order, F.col("_count").alias("_next"))
    placed = cut(merged.filter("_hit = 1").withColumn("_pos", F.col("_count") - 1).drop("_count", "_hit", "_us").join(after, [key, order]))

    starts = cut(placed.groupBy(key).agg(F.min("_pos").alias("_pos")).select("_pos"))
    jump = placed.select("_pos", "_next")
    while True:
        reached = jump.join(starts, "_pos").select(F.col("_next").alias("_pos")).join(placed.select("_pos"), "_pos", "left_semi")
        new = cut(reached.distinct().join(starts, "_pos", "left_anti"))
        if new.isEmpty():
            break
        starts = cut(starts.unionByName(new))
        far = jump.select(F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jump = cut(join_on_hot_key(jump, far, ["_next"], hot_keys(jump, ["_next"], hot_rows)).select("_pos", F.col("_far").alias("_next")))

    marked = placed.join(starts.withColumn("_start", F.col("_pos")), "_pos", "left")
    counted = running(marked, ["_pos"], maxes={"_from": F.col("_start")}).withColumn("n_in_window", F.col("_pos") - F.col("_from") + 1)
    return counted.select(*hits.columns, "n_in_window", (F.col("n_in_window") <= limit).alias("ok"))


def aligned_rate(hits: DataFrame, key: str, ts: str, limit: int, window: str = "60 seconds") -> DataFrame:
    """T07, clock-aligned variant: a plain windowed aggregate, also for streams."""
    return (hits.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
            .select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit")))


def retry_plan(attempts: DataFrame) -> DataFrame:
    """Failed messages to try again, and those out of tries as dead letters.
    A transient failure is retried up to four times; any other ends at once."""
    per = attempts.groupBy("msg_id").agg(
        F.max(F.col("outcome") == "ok").alias("done"), F.count(F.when(F.col("outcome") == "transient", 1)).alias("tries"),
        F.max(F.col("outcome") == "fatal").alias("fatal"))
    action = F.when(F.col("done"), "done").when(F.col("fatal") | (F.col("tries") > MAX_TRIES), "dead_letter").otherwise("retry")
    return per.select("msg_id", "tries", action.alias("action"))
