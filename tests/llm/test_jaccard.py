"""Operator 12 against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from hopglass.llm import jaccard

SCHEMA = "doc_id long, text string, node string, token string, digest string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_force(rows, percent=85):
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = 0
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items()), links


def result(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "n", "t", "d") for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, jaccard.joined(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def made(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = ["", " \n", None, "one two", "one  TWO", "one two three four", "One two three four", "x " * 40, "x " * 400]
    for size in (8, 14, 40, 160, 700):  # copies with few edits, on both sides of the limit, and chains of them
        base = rnd.choices(words, k=size)
        for _ in range(30):
            copy = list(base)
            for _ in range(rnd.randrange(0, 2 + size // 40)):
                copy[rnd.randrange(size)] = rnd.choice(words)
            rows.append(" ".join(copy[: rnd.choice([size, size, size - size // 20])]))
            if rnd.random() < 0.3:
                base = copy
    passage = rnd.choices(words, k=60)
    rows += [" ".join(passage + rnd.choices(words, k=rnd.randrange(2, 90))) for _ in range(60)]
    rows += [" ".join(rnd.choices(words, k=rnd.randrange(3, 200))) for _ in range(40)]
    order = list(range(1, len(rows) + 1))
    rnd.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"block": 7, "share": 1.0, "filter_bits": 64})])
def test_all_pairs(spark, seed, how):
    rows = made(seed)
    wanted, links = brute_force(rows)
    assert links > 100 and result(spark, rows, **how) == sorted(wanted, key=str)


def test_group_below_the_limit(spark):
    """Copies that are all a little too different are compared, never linked, and cost no quadratic number of pairs."""
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    base = rnd.choices(words, k=200)
    rows = []
    for i in range(300):
        copy = list(base)
        for p in rnd.sample(range(200), 6):
            copy[p] = rnd.choice(words)
        rows.append((i, " ".join(copy)))
    wanted, links = brute_force(rows)
    assert result(spark, rows) == sorted(wanted, key=str)


def test_repeated_and_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text.upper()), (5, "other words here now"), (None, text), (None, None), (7, None), (7, "")]
    got = result(spark, rows)
    assert got == sorted([(5, 47, 3), (5, 47, 3), (3, 47, 3), (5, 1, 5), (None, 47, None), (None, 0, None), (7, 0, 7), (7, 0, 7)], key=str)
    assert result(spark, []) == []


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n, m, words in ((40, 3, 16), (500, 60, 16), (900, 200, 64)):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[m:], rng.integers(0, 1 << 63, m, np.uint64)])
        x, y = (jaccard.parity(s, words) for s in (a, b))
        far = int(np.bitwise_count(x ^ y).sum())
        assert far <= 2 * m and far > 1.2 * m
        if words == 64:
            wide = np.array([x, y])
            assert (jaccard.narrowed(wide, 16) == np.array([jaccard.parity(s, 16) for s in (a, b)])).all()
