"""Raw mail to typed tables."""

from __future__ import annotations

import email
import os
import uuid
from email import policy
from email.errors import MessageError
from email.header import decode_header, make_header
from email.utils import getaddresses, parsedate_to_datetime
from datetime import timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as fx
from ..functions.text import rx, strip_tags

_S = T.StringType()
HEADER = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("name", _S), T.StructField("value", _S)])
PART = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("filename", _S), T.StructField("content_type", _S), T.StructField("content", T.BinaryType())])
DECODED = T.StructType([
    T.StructField("headers", T.ArrayType(HEADER)), T.StructField("message_id", _S), T.StructField("subject", _S), T.StructField("sent_at", T.TimestampType()),
    T.StructField("from_name", _S), T.StructField("from_raw", _S), T.StructField("reply_raw", _S), T.StructField("return_raw", _S),
    T.StructField("to_raw", T.ArrayType(_S)), T.StructField("text", _S), T.StructField("html", _S), T.StructField("parts", T.ArrayType(PART)),
    T.StructField("parse_error", _S)])

#: What is decoded at a time: a task holds so much mail as Python objects, however many rows a batch has.
STEP_BYTES, STEP_ROWS = 4 << 20, 512

#: Files are read in pieces of this size where they may be larger than a row, by at most so many tasks.
PIECE_BYTES, MOST_TASKS = 32 << 20, 4096


def read_mail(spark: SparkSession, path: str, owner: str, stream: bool = False, max_files: int = 1000, tasks: int | None = None, piece: int | None = None) -> DataFrame:
    """One row per file with its bytes; as a stream with bounded batches.  ``tasks``: at most so many read them, where many
    files are small; Spark counts 4 MB for opening one and gives a task 32 of them.

    A row holds 2 GB at most.  With ``piece`` (no stream), files of any size come in rows of at most so many bytes, each with its
    place ``start``, dealt over the tasks.  Only a mounted folder (``file:``) is read from the middle; elsewhere a file is one row."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    else:
        raw = spark.read.format("binaryFile").load(path)
        raw = raw.coalesce(tasks) if tasks else raw
        raw = _in_pieces(raw, piece) if piece else raw
    return raw.select(F.lit(owner).alias("owner"), "path", F.col("modificationTime").alias("received_at"), F.col("content").alias("raw"), *(["start"] if piece else []))


def _in_pieces(files: DataFrame, piece: int) -> DataFrame:
    """Rows of ``binaryFile`` with ``start``: small files whole, larger ones cut.  Filters on ``length`` are pushed down to the source,
    which leaves the bytes of other files alone."""
    whole, large = files.withColumn("start", F.lit(0).cast("long")), files.filter(F.col("length") > piece).drop("content")
    found = large.agg(F.min("path").alias("path"), F.sum(F.ceil(F.col("length") / piece)).alias("pieces")).first()
    if not (found["path"] or "").startswith("file:"):
        return whole
    starts = large.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece).cast("long"))))

    def read(batches):
        for batch in batches:
            for i, (path, length, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start")), strict=True)):
                with open(local_path(path), "rb") as f:
                    f.seek(start)
                    content = f.read(min(piece, length - start))
                if len(content) < min(piece, length - start):
                    raise OSError(f"{path} has become shorter than {length} bytes")
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*batch.schema.names, "content"])

    parts = starts.repartition(min(found["pieces"], MOST_TASKS)).mapInArrow(read, T.StructType([*starts.schema.fields, T.StructField("content", T.BinaryType())]))
    return whole.filter(F.col("length") <= piece).unionByName(parts)


def write_mail(messages: DataFrame, folder: str) -> int | None:
    """One file per ``path``, all below one folder, so that one listing finds them; each task puts its own files into place.
    Rows of the same path run together in its file, a line break after each.  Returns the number of tasks that suffice to read
    them, where it is known."""
    value = F.coalesce(F.col("raw").cast("string"), F.lit(""))
    files = messages.groupBy("path").agg(F.array_join(F.collect_list(value), "\n").alias("value"))
    if not folder.startswith("file:"):
        files.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
        return None
    # on a mounted folder Hadoop starts several processes a file to set permissions, which takes far longer than the file itself
    top = local_path(folder)
    os.makedirs(top)
    named = files.select(F.coalesce(F.sha2("path", 256), F.lit("none")).alias("name"), F.concat("value", F.lit("\n")).cast("binary").alias("raw"))

    def write(batches):
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw"), strict=True):
                _put(f"{top}/{name}.eml", raw.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([pc.sum(pc.binary_length(batch.column("raw"))).as_py() or 0], pa.int64())})

    n = named.mapInArrow(write, "files long, bytes long").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).first()
    return 1 + max((n["files"] or 0) // STEP_ROWS, (n["bytes"] or 0) // STEP_BYTES)


def local_path(uri: str) -> str:
    """The path of a ``file:`` address."""
    return uri.removeprefix("file:").replace("///", "/", 1)


def _put(path: str, raw) -> None:
    """A file is there as a whole or not at all; a task that runs again replaces it.  Spark's listings pass names with a dot by."""
    folder, name = os.path.split(path)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(raw)
    os.replace(part, path)


def _header_text(value) -> str | None:
    if value is None:
        return None
    try:
        return str(make_header(decode_header(str(value))))
    except (UnicodeError, LookupError, ValueError, MessageError):
        return str(value)


def _raw_text(value) -> str | None:
    """A header as given; raw 8-bit bytes come as a Header object."""
    return None if value is None else str(value)


def _decode(raw: bytes) -> dict:
    """MIME-decode one message; one that can't be decoded stays as a row with ``parse_error`` set and nothing else."""
    try:
        return _decode_message(raw) | {"parse_error": None}
    except Exception as e:  # whatever a hostile message provokes: it must not end the job
        empty = {"headers": [], "to_raw": [], "parts": [], "text": ""}
        return dict.fromkeys(DECODED.names) | empty | {"parse_error": f"{type(e).__name__}: {e}"}


def _decode_message(raw: bytes) -> dict:
    """Everything that isn't MIME decoding is done with column expressions."""
    msg = email.message_from_bytes(bytes(raw), policy=policy.compat32)
    text, html, parts = [], [], []
    for part in msg.walk():
        if part.get_content_maintype() == "multipart":
            continue
        name, kind = part.get_filename(), part.get_content_type()
        body = part.get_payload(decode=True) or b""
        if name or "attachment" in (part.get("Content-Disposition") or "").lower():
            parts.append({"pos": len(parts), "filename": _header_text(name), "content_type": kind, "content": body})
        elif kind in ("text/plain", "text/html"):
            try:
                decoded = body.decode(part.get_content_charset() or "utf-8", "replace")
            except (LookupError, UnicodeError, ValueError):
                decoded = body.decode("utf-8", "replace")
            (text if kind == "text/plain" else html).append(decoded)
    people = lambda h: getaddresses([_header_text(msg.get(h)) or ""]) if msg.get(h) else []
    sender, reply = people("From"), people("Reply-To")
    try:
        sent = parsedate_to_datetime(msg["Date"]) if msg["Date"] else None
        sent = (sent.replace(tzinfo=timezone.utc) if sent.tzinfo is None else sent.astimezone(timezone.utc)) if sent is not None else None
    except (TypeError, ValueError, OverflowError):
        sent = None
    return {"headers": [{"pos": i, "name": k, "value": str(v)} for i, (k, v) in enumerate(msg.items())],
            "message_id": _raw_text(msg.get("Message-ID")), "subject": _header_text(msg.get("Subject")), "sent_at": sent,
            "from_name": sender[0][0] if sender else None, "from_raw": sender[0][1] if sender else None,
            "reply_raw": reply[0][1] if reply else None, "return_raw": _raw_text(msg.get("Return-Path")),
            "to_raw": [a for _, a in people("To")], "text": "\n".join(text), "html": "\n".join(html) if html else None, "parts": parts}


def bounded(batch: pa.RecordBatch, size_of: str):
    """Slices of a batch: one row, or at most STEP_ROWS rows with STEP_BYTES in the column ``size_of``."""
    sizes = pc.binary_length(batch.column(size_of)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > STEP_BYTES or i - start >= STEP_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if sizes:
        yield batch.slice(start)


def _blank_to_null(c: Column, lower: bool = True) -> Column:
    v = F.trim(F.lower(c) if lower else c)
    return F.nullif(v, F.lit(""))


def case_id_of(owner: Column, sha256: Column) -> Column:
    """Stable id: the same bytes of the same owner are always the same case."""
    return F.substring(F.sha2(F.concat_ws(":", owner, sha256), 256), 1, 32)


def parse_messages(raw_mail: DataFrame) -> DataFrame:
    """Typed message rows; no shuffle.  Also runs on a stream."""
    schema = T.StructType([*raw_mail.schema.fields, *DECODED.fields])
    kinds = to_arrow_schema(DECODED)

    def decode(batches):
        for batch in batches:
            for some in bounded(batch, "raw"):
                rows = [_decode(r) for r in some.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array([r[k.name] for r in rows], k.type) for k in kinds)], [*some.schema.names, *kinds.names])

    df = raw_mail.mapInArrow(decode, schema).withColumn("sha256", F.sha2("raw", 256))
    text = F.nullif(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit(""))
    return df.select(
        case_id_of(F.col("owner"), F.col("sha256")).alias("case_id"), "owner", F.col("received_at").alias("arrival"), "sha256",
        F.length("raw").alias("size_bytes"), _blank_to_null(F.col("message_id"), False).alias("message_id"), "subject", "sent_at",
        _blank_to_null(F.col("from_name"), False).alias("from_display_name"), _blank_to_null(F.col("from_raw")).alias("from_addr"),
        _blank_to_null(F.col("reply_raw")).alias("reply_to"), _blank_to_null(F.regexp_replace(F.trim("return_raw"), "^<|>$", "")).alias("return_path"),
        F.transform("to_raw", lambda a: F.lower(F.trim(a))).alias("to_addrs"), body_text(text, F.col("html")).alias("body_text"),
        F.col("html").alias("body_html"), "headers", "parts", "parse_error")


def parse_failures(messages: DataFrame) -> DataFrame:
    """Evidence rows of the messages that could not be decoded."""
    bad = messages.filter(F.col("parse_error").isNotNull())
    return bad.select("case_id", F.lit("PARSE").alias("analyzer"), F.lit("lane_error").alias("signal"), F.lit("ERROR").alias("status"), F.lit(0.0).alias("confidence"), F.col("parse_error").alias("detail"))


def body_text(text: Column, html: Column) -> Column:
    """The text parts, else the HTML without its tags."""
    return F.coalesce(text, F.when(html.isNotNull(), strip_tags(html)), F.lit(""))


def header_table(messages: DataFrame) -> DataFrame:
    """Headers in order, duplicates kept."""
    return messages.select("case_id", F.inline("headers"))


def header_values(headers: DataFrame, name: str) -> DataFrame:
    return headers.filter(F.lower("name") == name.lower()).orderBy("case_id", "pos").select("case_id", "pos", "value")


def svg_active_content(filename: Column, content_type: Column, content: Column) -> Column:
    """Scripts, handlers and script links of an SVG, all of them and whole; reports cut what they show."""
    kind, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    is_svg = kind.contains("svg") | name.endswith(".svg") | name.endswith(".svgz")
    text = F.when(is_svg, F.decode(content, "UTF-8"))
    find = lambda p: F.regexp_extract_all(text, F.lit(rx(p)), F.lit(0))
    hits = F.concat(find(fx.SVG_SCRIPT_PATTERN), find(fx.SVG_HANDLER_PATTERN), find(fx.SVG_JSHREF_PATTERN))
    tidy = F.transform(hits, lambda h: F.trim(F.regexp_replace(h, r"\s+", " ")))
    return F.when(F.coalesce(text.rlike(r"(?i)<svg[\s>]"), F.lit(False)), tidy).otherwise(F.array().cast("array<string>"))


def attachment_table(messages: DataFrame) -> DataFrame:
    """Name, type, size, digest and active content of every attachment."""
    a = messages.select("case_id", F.inline("parts"))
    return a.select("case_id", "pos", "filename", "content_type", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
                    svg_active_content(F.col("filename"), F.col("content_type"), F.col("content")).alias("active_content"))
