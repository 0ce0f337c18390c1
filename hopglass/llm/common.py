"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopglass.session import ensure_checkpoint_dir

#: Characters of text that one step inside a task works on; a longer text is a step of its own.
STEP_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty); further columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def steps(batches: Iterable[pa.RecordBatch], limit: int = STEP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of Arrow batches (columns: id, text) in steps of bounded size, so a task holds a few MB at a time."""
    for batch in batches:
        ids, size, start = batch.column(0).to_pylist(), 0, 0
        texts = batch.column(1)
        lengths = pc.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield ids[start:i], texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < len(ids):
            yield ids[start:], texts.slice(start).to_pylist()


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; ``bytes.split`` cuts at exactly these six characters."""
    return text.encode().split()


def lower_words_of(text: str) -> list[bytes]:
    """The same with A-Z lower-cased (``bytes.lower`` touches ASCII letters only)."""
    return text.encode().lower().split()


def table_cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared checkpoint folder.  In loops this is better than ``checkpoint()``, which
    hands on the optimizer's size estimates: joins multiply them, and their digits double with every round."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
