"""Operator 13 against all pairs."""

import math
import random

import numpy as np
import pytest

from hopglass.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, tile string"


def brute_force(rows):
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows
         if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(256 * x) for x in e)]
    out = []
    for k, (a, la, qa) in enumerate(v):
        if a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q, strict=True)), i, lab) for n, (i, lab, q) in enumerate(v) if n != k and len(q) == len(qa))
        for ps, p in [(-x, i) for x, i, lab in s if lab == la][:5]:
            low = [(-x, i) for x, i, lab in s if lab != la and 50 * ps <= -100 * x <= 95 * ps][:3]
            out += [(a, p, r, n, ps, ns) for r, (ns, n) in enumerate(low, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "r", "t") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mined(df, negatives.F.col("vec_id") % 50 == 0, negatives.shifted(), **how).collect()))


def made(n, dim, seed, hot=0.0):
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    centres = rng.normal(0, 0.2, (6, dim))
    rows = []
    for i in range(n):
        lab = 0 if rnd.random() < hot else rnd.randrange(6)
        rows.append((i, (centres[lab] + rng.normal(0, 0.12, dim)).tolist(), lab))
    return rows


@pytest.mark.parametrize(("n", "dim", "hot", "tile"), [(700, 24, 0.0, 90), (500, 9, 0.5, 8192), (400, 1, 0.2, 64)])
def test_all_pairs(spark, n, dim, hot, tile):
    rows = made(n, dim, n, hot)
    rows[30:90] = [(i, rows[30][1], rows[i][2]) for i in range(30, 90)]  # one popular vector: ties
    got = mined(spark, rows, tile=tile)
    assert got == brute_force(rows) and got


def test_odd_rows(spark):
    rows = made(160, 5, 8)
    rows += [(200, None, 1), (250, [0.1] * 5, None), (300, [0.1, None, 0.2, 0.1, 0.0], 2), (350, [0.1, float("nan"), 0.2, 0.1, 0.0], 2), (400, [float("inf")] * 5, 2), (None, [0.1] * 5, 2)]
    rows += [(450, [0.0] * 5, 1), (451, [], 1), (500, [], 1), (550, [0.5, 0.25], 2), (551, [0.5, 0.125], 2), (552, [0.25, 0.25], 3), (553, [1e307] * 2, 2), (554, [1.7e308] * 2, 2)]
    rows += [(100, [0.3] * 5, 3)]  # a vec_id that repeats
    got = mined(spark, rows, tile=50)
    wanted = sorted((a, p, r, n, negatives.as_long(ps), negatives.as_long(ns)) for a, p, r, n, ps, ns in brute_force(rows))
    assert got == wanted
    assert mined(spark, []) == []


def test_few_rows_are_completed():
    """Tight windows leave most rows set aside: fewer components are read than by brute force."""
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 1, (3000, 64)) * np.linspace(60, 2, 64))
    tile, read = negatives.Tile(rows), []
    plain = tile.scan
    tile.scan = lambda a, b, state, low: (plain(a, b, state, low), read.append(state.depth.copy()))
    ids = np.arange(3000)
    for i, scores, (found,) in negatives.searched(tile, rows[:20], lambda i: ids != i, lambda i: [(None, None, 5)]):
        own = rows @ rows[i]
        best = negatives.first_rows(scores, found, ids, 5)
        assert best.tolist() == [j for j in np.lexsort((ids, -own)) if j != i][:5] and (scores[best] == own[best]).all()
    assert sum((d == len(tile.starts) - 1).sum() for d in read) < 0.5 * 3000 * len(read)
