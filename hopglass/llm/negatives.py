"""Operator 13: hard negatives by L2AP-style threshold joins.

Components become integers, so scores (inner products) are exact.  Rows are dealt, in the order of their label, to tiles of TILE rows, anchors to blocks of
as many; a tile meets the blocks it can serve, so what moves grows with tiles x blocks and nothing is held whole by
one task or the driver.  Two joins follow: anchors with rows of their own label for the positives, then with rows of other
labels for the windows below the positives' scores.

Inside a task the tile is an inverted index over blocks of dimensions (DIMS each, those of most energy first).  A row's posting in a block is
omitted where the norm of the row's remaining components times the anchor's norm stays below the threshold.  Partial scores
are accumulated block by block; a row whose partial score plus the product of the remaining norms (of row and anchor)
stays below the threshold is set aside, and rows that outlive the index are completed from their omitted dimensions.  An anchor's
threshold starts high and is lowered, taking up the rows set aside, until every window of the anchor is filled from this tile or is wholly
searched; so each tile gives its exact first rows per window, and these are merged.

Rows with a null vec_id, label or vector or a null or (times SCALE) non-finite component take no part.  Zero and empty vectors do; vectors
are compared with those of their own length only.  An anchor's own row is left out, rows that repeat its vec_id are not.  Ties go to the smaller
vec_id.  Integers whose products pass 2**53 are handled as Python integers; a score that passes 64 bits is given as the
largest or smallest of them.  A positive below zero has an empty window.  An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopglass.operators.skew import global_positions

from .common import table_cut

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's, at least and at most.
LEAST, MOST = 50, 95
SCALE, TILE, DIMS = 256, 8192, 8
#: Anchors whose first partial scores are computed together; factors by which thresholds go down.
GROUP, LOWER = 64, 0.85
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """row, vec_id, label, dim and vector (integers as doubles) of the rows that take part; ``relabel`` replaces the label."""
    label = (F.col("label") if relabel is None else relabel).cast("long")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(SCALE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null").filter(~F.coalesce(bad, F.lit(True)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("vector").alias("dim"), "vector")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat).reshape(len(column), dim)


class Tile:
    """Inverted index of some rows over blocks of dimensions."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-(rows**2).sum(0), kind="stable") if len(rows) else np.arange(rows.shape[1])
        self.rows = np.ascontiguousarray(rows[:, self.order])
        self.starts = [*range(0, rows.shape[1], DIMS), rows.shape[1]] if rows.shape[1] else [0]
        self.left = norms_left(self.rows, self.starts)
        self.largest = float(self.left[:, 0].max()) if len(rows) else 0.0

    def scan(self, anchor: np.ndarray, anchor_left: np.ndarray, state: Scan, low: float) -> None:
        """Bring every row that can reach ``low`` to its exact score."""
        last = len(self.starts) - 1
        for k in range(last):
            part = slice(self.starts[k], self.starts[k + 1])
            reach = np.flatnonzero((state.most >= low) & (state.depth == k))
            if not len(reach):
                continue
            # the posting is omitted where the row's remaining norm alone cannot reach the threshold
            posted = self.left[reach, k] * anchor_left[0] >= low
            at = reach[posted]
            state.sums[at] += self.rows[at, part] @ anchor[part]
            state.depth[at] = k + 1
            state.most[at] = state.sums[at] + anchor_left[k + 1] * self.left[at, k + 1]
            rest = reach[~posted]
            if len(rest):
                state.sums[rest] += self.rows[rest, part.start :] @ anchor[part.start :]
                state.depth[rest] = last
                state.most[rest] = state.sums[rest]


class Scan:
    """Partial scores of one anchor with the rows of a tile, how many blocks they cover (-1: not to be taken), and the most each can become."""

    def __init__(self, sums: np.ndarray, depth: np.ndarray, most: np.ndarray):
        self.sums, self.depth, self.most = sums, depth, most


def norms_left(rows: np.ndarray, starts: list[int]) -> np.ndarray:
    """Norm of each row from the start of each block on, rounded up; 0 after the last."""
    out = np.zeros((len(rows), len(starts)))
    for k in range(len(starts) - 2, -1, -1):
        out[:, k] = out[:, k + 1] + (rows[:, starts[k] : starts[k + 1]] ** 2).sum(1)
    return np.sqrt(out) * (1 + 1e-9)


def exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Scores in Python integers."""
    own = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(row, own, strict=True)) for row in rows], object)


def first_rows(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of the rows ``at``, the n of highest score, ties by id."""
    if len(at) > n:
        cut = np.sort(scores[at])[len(at) - n]
        at = at[scores[at] >= cut]
    return at[sorted(range(len(at)), key=lambda i: (-scores[at[i]], ids[at[i]]))[:n]]


def searched(tile: Tile, anchors: np.ndarray, fits, windows):
    """For each anchor (its number, scores, the rows found per window).

    ``fits(i)`` is a mask of the rows that anchor i may take, ``windows(i)`` a list of (least or None, most or None, how many);
    a window's rows are found by lowering the anchor's threshold until it is filled or searched down to its least score."""
    anchors = anchors[:, tile.order]
    left = norms_left(anchors, tile.starts)
    last = len(tile.starts) - 1
    safe = tile.largest * float(left[:, 0].max(initial=0)) < 2.0**53
    for start in range(0, len(anchors), GROUP):
        some = slice(start, start + GROUP)
        if safe and last:
            head = anchors[some, : tile.starts[1]] @ tile.rows[:, : tile.starts[1]].T
        for i in range(start, min(start + GROUP, len(anchors))):
            wanted, open_rows = windows(i), fits(i)
            if not wanted or not open_rows.any():
                continue
            if not safe:
                scores = exact(tile.rows, anchors[i])
                yield i, scores, [np.flatnonzero(open_rows & inside(scores, low, high)) for low, high, _ in wanted]
                continue
            sums = head[i - start] if last else np.zeros(len(tile.rows))
            most = sums + left[i, 1] * tile.left[:, 1] if last else sums
            state = Scan(sums, np.where(open_rows, min(1, last), -1), most)
            floor = -np.inf if any(low is None for low, _, _ in wanted) else min(low for low, _, _ in wanted)
            top = left[i, 0] * tile.largest
            low = min(top, max((high for _, high, _ in wanted if high is not None), default=top))
            while True:
                low = low * LOWER if low * LOWER > max(floor, top / 50) else floor
                tile.scan(anchors[i], left[i], state, low - 0.5)
                known = (state.depth == last) & (state.most >= low)
                found = [np.flatnonzero(known & inside(state.sums, least, most_)) for least, most_, _ in wanted]
                if low == floor or all(len(f) >= n or (least is not None and low <= least) for f, (least, _, n) in zip(found, wanted, strict=True)):
                    break
            yield i, state.sums, found


def inside(scores: np.ndarray, low, high) -> np.ndarray:
    out = np.ones(len(scores), bool)
    if low is not None:
        out &= (scores >= low).astype(bool)
    if high is not None:
        out &= (scores <= high).astype(bool)
    return out


def as_long(score) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def by_dim(left: pa.Table, right: pa.Table):
    """Rows and anchors of one length at a time, as (tile, rows' columns, anchors, anchors' columns)."""
    for dim in sorted(set(left["dim"].unique().to_pylist()) & set(right["dim"].unique().to_pylist())):
        a, b = (t.filter(pa.compute.equal(t["dim"], dim)) for t in (left, right))
        yield Tile(matrix(a["vector"], dim)), a, matrix(b["vector"], dim), b


def column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


POSITIVE = "anchor_row long, anchor_id long, other_row long, other_id long, score long"
NEGATIVE = "anchor_row long, anchor_id long, place int, other_row long, other_id long, score long"


def _positives(count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for tile, a, anchors, b in by_dim(left, right):
            rows, ids, labels = column(a, "row"), column(a, "vec_id"), column(a, "label")
            own_rows, own_ids, own_labels = column(b, "row"), column(b, "vec_id"), column(b, "label")
            fits = lambda i: (labels == own_labels[i]) & (rows != own_rows[i])  # noqa: B023, E731
            for i, scores, (found,) in searched(tile, anchors, fits, lambda i: [(None, None, count)]):
                out += [(own_rows[i], own_ids[i], rows[j], ids[j], as_long(scores[j])) for j in first_rows(scores, found, ids, count).tolist()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["anchor_row", "anchor_id", "other_row", "other_id", "score"])

    return run


def window_of(score: int) -> tuple[int, int]:
    """Least and largest score of a negative for a positive of this score."""
    return -(-LEAST * score // 100), MOST * score // 100


def _negatives(count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for tile, a, anchors, b in by_dim(left, right):
            rows, ids, labels = column(a, "row"), column(a, "vec_id"), column(a, "label")
            own_rows, own_ids, own_labels, scores_of = column(b, "row"), column(b, "vec_id"), column(b, "label"), b["positives"].to_pylist()
            places = [[(k, *window_of(s)) for k, s in enumerate(p) if s >= 0] for p in scores_of]
            for i, scores, found in searched(tile, anchors, lambda i: labels != own_labels[i], lambda i: [(low, high, count) for _, low, high in places[i]]):  # noqa: B023
                for (k, _, _), at in zip(places[i], found, strict=True):
                    out += [(own_rows[i], own_ids[i], k, rows[j], ids[j], as_long(scores[j])) for j in first_rows(scores, at, ids, count).tolist()]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, pa.int32() if n == "place" else pa.int64()) for c, n in zip(cols, ["anchor_row", "anchor_id", "place", "other_row", "other_id", "score"], strict=True)],
                                    ["anchor_row", "anchor_id", "place", "other_row", "other_id", "score"])

    return run


def met(tiles: DataFrame, blocks: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the rows and anchors of each pair (tile, block)."""
    pairs, same = table_cut(pairs), [F.col(c).alias(c) for c in ("tile", "block")]  # columns of their own on each side
    left = tiles.join(pairs.select(same), "tile").groupBy("tile", "block")
    return left.cogroup(blocks.join(pairs.select(same), "block").groupBy("tile", "block")).applyInArrow(run, schema)


def mined(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on vec_id and label."""
    rows = table_cut(usable(vectors, relabel))
    tiles = table_cut(global_positions(rows, ["dim", "label", "row"]).withColumn("tile", F.expr(f"position div {tile}")).drop("position"))
    anchors = tiles.filter(is_anchor).drop("tile")
    blocks = table_cut(global_positions(anchors, ["dim", "label", "row"]).withColumn("block", F.expr(f"position div {tile}")).drop("position"))

    spans = tiles.groupBy("dim", "label").agg(F.min("tile").alias("t0"), F.max("tile").alias("t1"))
    own = blocks.select("block", "dim", "label").distinct().join(spans, ["dim", "label"])
    pairs = own.select("block", F.explode(F.sequence("t0", "t1")).alias("tile")).distinct()
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "other_id", "other_row")
    found = met(tiles, blocks, pairs, _positives(positives), POSITIVE).withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives)
    found = table_cut(found)

    scores = found.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("positives"))  # a few at most
    asking = table_cut(blocks.join(scores, blocks["row"] == scores["anchor_row"]).drop("anchor_row"))
    spans = tiles.groupBy("dim").agg(F.min("tile").alias("t0"), F.max("tile").alias("t1"))
    other = asking.groupBy("block", "dim").agg(F.min("label").alias("b0"), F.max("label").alias("b1")).join(spans, "dim")
    labels = tiles.groupBy("dim", "tile").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    pairs = other.withColumn("tile", F.explode(F.sequence("t0", "t1"))).join(labels, ["dim", "tile"])
    pairs = pairs.filter("l0 <> l1 or b0 <> b1 or l0 <> b0").select("tile", "block").distinct()
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "other_id", "other_row")
    low = met(tiles, asking, pairs, _negatives(negatives), NEGATIVE).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    low = low.select("anchor_row", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    high = found.select("anchor_row", "anchor_id", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return high.join(low, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted() -> Column:
    """Every seventh row gets the next label, as the task sets it."""
    return F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")



ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INT) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""
