"""Live feed, inbox scan and streaming correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..operators.graph import correlate_batch


def write_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame, int], DataFrame] | None = None,
                  available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch to its own folder.  A replayed batch overwrites the
    same folder, so the sink holds each batch exactly once."""
    def put(batch: DataFrame, batch_id: int) -> None:
        out = batch if make is None else make(batch, batch_id)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def inbox_scan(messages: DataFrame, path: str, checkpoint: str, forget_after: str | None = None) -> StreamingQuery:
    """New inbox messages only: no sent mail or drafts, each id once, however late it comes.

    The seen ids are keyed state of the stream, so a batch reads its own rows and the state of their ids, not what was written
    before.  With ``forget_after`` (an interval over the time column ``at``) ids are dropped from the state after that time."""
    inbox = messages.filter(~F.array_contains("labels", "SENT") & ~F.array_contains("labels", "DRAFT"))
    if forget_after is None:
        once = inbox.dropDuplicates(["msg_id"])
    else:
        once = inbox.withWatermark("at", forget_after).dropDuplicatesWithinWatermark(["msg_id"])
    return write_batches(once, path, checkpoint)


#: What the stream keeps of one evidence row.
KEPT = ["pos", "analyzer", "signal", "status", "confidence", "detail"]


def verdict_stream(evidence: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A ``case_scored`` row for every case that a micro-batch touches, from all its evidence so far, with its indicators.

    ``evidence`` has case_id, the columns KEPT, and kind and value of an indicator (both null where there is none).  The evidence of a case, bounded by
    one message, is keyed state of the stream: a batch reads the state of the cases it touches and nothing that was written before.
    A replayed batch overwrites its own folder; ``newest_verdicts`` reads the result."""
    indicator = F.when(F.col("kind").isNotNull() & F.col("value").isNotNull(), F.struct("kind", "value"))
    state = evidence.groupBy("case_id").agg(F.collect_list(F.struct(*KEPT)).alias("evidence"), F.collect_set(indicator).alias("indicators"))

    def make(batch: DataFrame, batch_id: int) -> DataFrame:
        batch = batch.persist()
        verdicts = score(batch.select("case_id", F.inline("evidence")))
        return scored_feed(verdicts, batch.select("case_id", F.inline("indicators")))

    return write_batches(state, path, checkpoint, make, mode="update")


def newest_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The verdict of the last batch that touched each case."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("case_id", "batch")]
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*names), "batch").alias("_last")).select("case_id", *(f"_last.{c}" for c in names))


def scored_feed(verdicts: DataFrame, indicators: DataFrame) -> DataFrame:
    """``case_scored`` rows with the indicators of the case."""
    # a message is one row, so its indicators are bounded by one message
    ind = indicators.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("indicators"))
    v = verdicts.join(ind, "case_id", "left").withColumn("indicators", F.coalesce("indicators", F.array().cast("array<struct<kind:string,value:string>>")))
    return v.select("case_id", F.lit("case_scored").alias("event"), "score", "band", "confidence", "summary", "indicators")


def correlation_stream(indicators: DataFrame, store: str, out: str, checkpoint: str, hub_degree: int = graph.HUB_DEGREE) -> StreamingQuery:
    """Every micro-batch is compared with all earlier batches, then stored."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        stored = spark.read.parquet(store).filter(F.col("batch") < batch_id) if batch_id > 0 else None
        correlate_batch(batch, stored, hub_degree).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        batch.unpersist()

    return indicators.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
