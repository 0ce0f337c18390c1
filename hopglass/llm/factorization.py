"""Operator 5: quality classifier by a factorisation machine.

Features of a text: its words hashed to 2**BITS places (lower-cased, counts scaled to unit length) and structure and size
statistics, each cut into LEVELS one-hot levels.  The score is logistic of
``w0 + sum w x + 1/2 sum_f [(sum v_f x)^2 - sum v_f^2 x^2]``: all pairwise interactions at rank RANK in time linear in the
features.  The model is fitted on the driver by Adagrad on a bounded sample of labelled rows: about ``sample`` of them,
taken by the hash of doc_id; every document is scored, whole.  Labels, language, source and id are no inputs.

A null text is an empty one and gets a score; rows with a null id or label are not learned from; repeated rows are scored
each.  Without labels every score is 0.5.  An empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, steps
from .text_stats import SHARES, Numbers, counts, shares

BITS, RANK, LEVELS = 16, 8, 16
WORDS = 1 << BITS
#: Places for the levels of the shares, and of the logarithms of words, lines and mean line length.
SIZES = 3
PLACES = WORDS + (len(SHARES) + SIZES) * LEVELS
SAMPLE = 8_000


class _Hashed(Numbers):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = zlib.crc32(word) & WORDS - 1
        return n


def features(texts: list[str], hashed: _Hashed | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and value of each feature, by text."""
    hashed = _Hashed() if hashed is None else hashed
    if len(hashed) > 500_000:
        hashed.clear()
    words = [t.encode().lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    place = np.concatenate([np.fromiter(map(hashed.__getitem__, w), np.int64, len(w)) for w in words]) if words else np.zeros(0, np.int64)
    key, times = np.unique(np.repeat(np.arange(len(words)), n) << BITS | place, return_counts=True)
    row, place, value = key >> BITS, key & WORDS - 1, times.astype(float)
    norm = np.sqrt(np.bincount(row, value**2, len(words)))
    value /= norm[row]
    c = np.array([counts(t) for t in texts], np.int64)
    size = np.array([np.log2(c[:, 0] + 1) / 20, np.log2(c[:, 5] + 1) / 16, np.log2(c[:, 1] / np.maximum(c[:, 5], 1) + 1) / 20]).T
    dense = np.minimum(np.concatenate([np.sqrt(shares(c)), size], 1) * LEVELS, LEVELS - 1).astype(np.int64)
    dense += WORDS + np.arange(dense.shape[1]) * LEVELS
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), dense.shape[1])])
    place, value = np.concatenate([place, dense.ravel()]), np.concatenate([value, np.full(dense.size, 0.3)])
    order = np.argsort(row, kind="stable")
    return row[order], place[order], value[order].astype(np.float32)


class Machine:
    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(PLACES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (PLACES, RANK)).astype(np.float32)

    def margins(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the sums of v x that the gradient needs."""
        vx = self.v[place] * value[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, (vx**2).sum(1), n)
        return self.w0 + np.bincount(row, self.w[place] * value, n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> Machine:
        """texts: places and values of each; mini-batches with Adagrad steps."""
        g0, gw, gv, rng = 1e-6, np.full(PLACES, 1e-6, np.float32), np.full((PLACES, RANK), 1e-6, np.float32), np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for some in (order[k : k + batch] for k in range(0, len(order), batch)):
                n = [len(texts[i][0]) for i in some]
                row, place, value = np.repeat(np.arange(len(some)), n), np.concatenate([texts[i][0] for i in some]), np.concatenate([texts[i][1] for i in some])
                margin, sums = self.margins(row, place, value, len(some))
                wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
                own, at = np.unique(place, return_inverse=True)
                by = (wrong[row] * value).astype(np.float32)
                dw = np.bincount(at, by, len(own)) + decay * self.w[own]
                each = by[:, None] * (sums[row] - self.v[place] * value[:, None])
                dv = np.stack([np.bincount(at, each[:, f], len(own)) for f in range(RANK)], 1) + decay * self.v[own]
                g0 += wrong.sum() ** 2
                gw[own] += dw**2
                gv[own] += dv**2
                self.w0 -= rate * wrong.sum() / np.sqrt(g0)
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= 0.3 * rate * dv / np.sqrt(gv[own])
        return self

    def scores(self, texts: list[str], hashed: _Hashed | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin, _ = self.margins(*features(texts, hashed), len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("long")).alias("quality"))
    n = known.count()
    if not n:
        return Machine()
    share = 1 << 20
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < int(share * min(1.0, sample / n))).limit(2 * sample)

    def run(batches):
        for b in batches:
            label = b.column(2).to_pylist()
            for k in range(0, b.num_rows, 200):
                row, place, value = features(b.column(1).slice(k, 200).to_pylist())
                cuts = np.flatnonzero(np.diff(row)) + 1
                rows = zip(np.split(place.astype("<u4"), cuts), np.split(value.astype("<f4"), cuts), label[k : k + 200], b.column(0).slice(k, 200).to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([{"doc_id": i, "places": p.tobytes(), "values": v.tobytes(), "quality": q} for p, v, q, i in rows])

    rows = id_and_text(docs).join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, places binary, values binary, quality long").toArrow().to_pylist()  # about ``sample`` rows
    rows.sort(key=lambda r: (r["doc_id"], r["places"]))
    return Machine().fit([(np.frombuffer(r["places"], "<u4").astype(np.int64), np.frombuffer(r["values"], "<f4")) for r in rows], np.array([r["quality"] > 0 for r in rows], float)) if rows else Machine()


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches):
        hashed = _Hashed()
        for keys, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(machine.scores(texts, hashed))], ["doc_id", "score"])

    rows = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns of ``docs``."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = _Hashed()
        for texts in arrays:
            texts = texts.to_pylist()
            yield pa.array(np.concatenate([machine.scores([t or "" for t in texts[k : k + 1000]], hashed) for k in range(0, max(1, len(texts)), 1000)]))

    score = F.arrow_udf(run, "double").asNondeterministic()
    rows = docs.select(F.struct("*").alias("__row"), score(F.coalesce(F.col("text"), F.lit(""))).alias("__score"))
    return rows.filter(F.col("__score") >= threshold).select("__row.*")
