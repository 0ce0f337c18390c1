"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "hopglass", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the library relies on (UTC, AQE, skew joins)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def set_method_limit(spark: SparkSession) -> None:
    """Long chains of expressions are compiled step by step where one method for all of them would pass 8,000 bytes: the JVM
    leaves larger methods to its interpreter, which takes several times as long a row."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so its functions run from any working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_hopglass_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="hopglass-ship-"), "hopglass.zip")  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._hopglass_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a folder of our own
    only when none is configured (tests, single machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="hopglass-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and truncates the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
