"""Operator 10: best-fit packing by minimum bin slack.

Documents become token pieces of at most ``size``; only longer documents are cut, into pieces of ``size`` of which the
first may be shorter.  The pieces are counted by length.  For the largest length left, bitset subset-sum over the
lengths still available finds the combination that leaves the least slack; it is removed as many times as the counts
allow, since the same search would find it again until a length runs out.  So the plan depends on the histogram alone
(at most ``size`` lengths, and each step uses one of them up), not on the number of documents, and it fits the driver at
any scale.  Pieces of a length are numbered (per hash block, plus the blocks' offsets) and the number looks up its place
in the plan.

A null or empty text is one piece holding just the end id.  Repeated rows are packed each; rows that tie are numbered in
any order.  An empty table gives no rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopglass.session import cut

from .common import id_and_text, steps
from .tokens import coder

#: Pieces of one length that are numbered in one task.
BLOCK_ROWS = 16_384


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, encode_special_tokens: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``encode_special_tokens`` as in ``tokens``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        chunks = coder(path, encode_special_tokens)
        for keys, texts in steps(batches):
            rows: list[tuple] = []
            for key, ids in zip(keys, chunks.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                rows += [(key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            doc, piece, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(largest: int, counts: dict[int, int], size: int) -> dict[int, int]:
    """The largest length and, of the others, the combination that fills a bin best; among equals, larger lengths first."""
    room = size - largest
    reach, trail, full = 1, [], 1 << room
    mask = 2 * full - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length] - (length == largest), room // length), 1
        while left > 0:
            take = min(step, left)
            trail.append((reach, length, take))
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach & full:
            break
    chosen, target = {largest: 1}, reach.bit_length() - 1
    for before, length, take in reversed(trail):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= take * length
    return chosen


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first number, pieces per bin, first sequence, offset of the first) that place every numbered piece."""
    counts, used, rows, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while counts:
        chosen = fullest(max(counts), counts, size)
        times, offset = min(counts[x] // k for x, k in chosen.items()), 0
        for length, k in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], k, sequence, offset))
            used[length] += k * times
            offset += k * length
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(parts: DataFrame, size: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset."""
    parts = cut(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    places = plan(counts, size)
    blocks = F.array(*[F.lit(-(-counts.get(k, 0) // BLOCK_ROWS) or 1) for k in range(size + 1)])
    parts = parts.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(blocks, (F.col("length") + 1).cast("int"))))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("length", "_block").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece"))
    numbered = parts.withColumn("_number", number).join(offsets, ["length", "_block"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_number") - 1).alias("_number"))
    keys = places[:, 0] << 48 | places[:, 1]

    def place(batches):
        for b in batches:
            length, number = (b.column(i).to_numpy() for i in (3, 5))
            row = places[np.searchsorted(keys, length << 48 | number, side="right") - 1] if len(places) else np.zeros((0, 5), np.int64)
            nth = number - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + nth // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + nth % np.maximum(row[:, 2], 1) * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, encode_special_tokens: bool = True) -> DataFrame:
    return packed(pieces(docs, path, size, end_id, encode_special_tokens), size)
