"""Intel lists, idempotent case store and append-only sinks."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.net import network_parts


def parse_ip_lines(lines: DataFrame, kind: Column) -> DataFrame:
    """List lines (column ``line``) as networks of either family: kind, cidr and its prefix (family, bits, p1, p2).  Comments and
    blanks are no lines; a bare address is a network of one.  Lines that cannot be read stay, with a NULL prefix."""
    v = F.trim("line")
    df = lines.select(kind.alias("kind"), F.when(v.contains("/"), v).otherwise(F.concat(v, F.when(v.contains(":"), "/128").otherwise("/32"))).alias("cidr"), v.alias("line"))
    df = df.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("_n", network_parts("cidr", "cidr"))
    return df.select("kind", "cidr", F.get("_n.parts", F.lit(0)).alias("_p")).select("kind", "cidr", "_p.family", "_p.bits", "_p.p1", "_p.p2")


def read_ip_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse_ip_lines(spark.read.text(path).withColumnRenamed("value", "line"), F.lit(kind))


def plan_upsert(incoming: DataFrame, stored: DataFrame, current_version: str) -> DataFrame:
    """What to do with each distinct (owner, sha256): ``skip`` when stored under
    the current rules, ``rescore`` in place under the same id when stale, else ``insert``."""
    batch = incoming.groupBy("owner", "sha256").agg(F.min("case_id").alias("new_id"))
    known = stored.groupBy("owner", "sha256").agg(F.max_by(F.struct("case_id", "scorer_version"), "case_id").alias("s"))
    action = F.when(F.col("s").isNull(), "insert").when(F.col("s.scorer_version") == current_version, "skip").otherwise("rescore")
    return batch.join(known, ["owner", "sha256"], "left").select("owner", "sha256", F.coalesce("s.case_id", "new_id").alias("case_id"), action.alias("action"))


#: Hash buckets of the case store: the unit that an upsert rewrites.
BUCKETS = 64


def upsert_cases(incoming: DataFrame, path: str, batch: str, current_version: str, score: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a batch of cases into the store at ``path``, copy-on-write by hash bucket of (owner, sha256).

    ``incoming`` has owner, sha256, case_id and whatever ``score(cases) -> cases with scorer_version, ...`` needs; a mail that is
    stored keeps its case_id, is skipped under the current rules and scored again under older ones.  Only buckets that change are rewritten,
    each into a folder of the batch; the list of folders that make up the store is written last, as one small file per batch, so a
    run that is cut off changes nothing and a batch that is given again finds its marker and stops."""
    spark = incoming.sparkSession
    manifest = _manifest(spark, path)
    if any(m["batch"] == batch for m in manifest):
        return
    live = _live(manifest)
    bucket = F.pmod(F.xxhash64("owner", "sha256"), F.lit(buckets)).cast("int")
    new = incoming.withColumn("bucket", bucket)
    stored = spark.read.parquet(*live.values()).withColumn("bucket", bucket) if live else None
    if stored is None:
        todo = new.join(plan_upsert(new, new.limit(0).withColumn("scorer_version", F.lit("")), current_version).select("owner", "sha256", F.col("case_id").alias("_id")), ["owner", "sha256"])
    else:
        near = stored.join(new.select("bucket").distinct(), "bucket", "left_semi")
        plan = plan_upsert(new, near, current_version).filter("action <> 'skip'").select("owner", "sha256", F.col("case_id").alias("_id"))
        todo = new.join(plan, ["owner", "sha256"])
    first = todo.groupBy("owner", "sha256", "bucket").agg(F.min_by(F.struct(*[c for c in todo.columns if c not in ("owner", "sha256", "bucket")]), "case_id").alias("_r"))
    rows = score(first.select("owner", "sha256", "bucket", "_r.*").withColumn("case_id", F.col("_id")).drop("_id")).withColumn("batch", F.lit(batch))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched and stored is not None:
        keep = stored.filter(F.col("bucket").isin(touched)).join(rows.select("owner", "sha256"), ["owner", "sha256"], "left_anti")
        rows = rows.unionByName(keep, allowMissingColumns=True)
    folder = f"{path}/data/{uuid4().hex}"
    if touched:
        rows.repartition(len(touched), "bucket").withColumn("_b", F.col("bucket")).write.partitionBy("_b").parquet(folder)
    marker = spark.createDataFrame([(batch, b, f"{folder}/_b={b}") for b in touched] or [(batch, -1, "")], "batch string, bucket int, folder string")
    marker.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/n={len(manifest):08d}")


def _manifest(spark: SparkSession, path: str) -> list[dict]:
    """Batches of the store in order, with the folders they wrote; a few rows per batch."""
    try:
        rows = spark.read.schema("batch string, bucket int, folder string, n int").parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    out: dict[int, dict] = {}
    for r in rows:
        out.setdefault(r.n, {"batch": r.batch, "folders": {}})["folders"].update({r.bucket: r.folder} if r.bucket >= 0 else {})
    return [out[n] for n in sorted(out)]


def _live(manifest: list[dict]) -> dict[int, str]:
    """The newest folder of each bucket."""
    out: dict[int, str] = {}
    for m in manifest:
        out.update(m["folders"])
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of the store, each mail once."""
    return spark.read.parquet(*_live(_manifest(spark, path)).values()).drop("bucket")


#: What is kept, with the column whose day parts the table (None: none).
SINKS = {"evidence": "observed_at", "cases": "arrival", "messages": "received_at", "hops": "ts", "indicators": "arrival", "audit": "at"}


def append(rows: DataFrame, sink: str, path: str, batch: str) -> None:
    """Append-only sink, parted by batch and day.  Each batch has a folder of its own, so one that is given again after a failure
    replaces its own rows and no others."""
    day = F.coalesce(F.to_date(F.col(SINKS[sink]).cast("timestamp")), F.lit("1970-01-01").cast("date"))
    rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{path}/{sink}/batch={batch}")


def read_sink(spark: SparkSession, sink: str, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{sink}").parquet(f"{path}/{sink}")


def evidence_export(evidence: DataFrame) -> DataFrame:
    """The evidence log as ordered JSON lines."""
    cols = [c for c in evidence.columns if c != "case_id"]
    return evidence.select("case_id", "observed_at", "pos", F.to_json(F.struct(*cols)).alias("line")).orderBy("case_id", "observed_at", "pos")
