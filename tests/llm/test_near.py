"""Operator 4 against all pairs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopglass.llm import near

SCHEMA = "doc_id long, text string, label string, rep string, band string, digest string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """(doc_id, set size, component, kept) by comparing every pair that shares a shingle."""
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def result(df):
    return sorted(map(tuple, near.components(df).select("doc_id", "n_shingles", "component_id", "kept").collect()))


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.choices(words, k=120)
    rows = ["", " \n", None, "one two", "one  TWO", "one two three four five", "One two three four five", "x " * 40, "x " * 400, " ".join(base), " ".join(base).upper()]
    for _ in range(70):  # a chain of ever further copies, and copies near the limit of similarity
        copy = list(base)
        for _ in range(rnd.randrange(1, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append(" ".join(copy))
        if rnd.random() < 0.3:
            base = copy
    passage = rnd.choices(words, k=60)
    rows += [" ".join(passage + rnd.choices(words, k=rnd.randrange(10, 90))) for _ in range(60)]
    rows += [" ".join(rnd.choices(words, k=rnd.randrange(3, 200))) for _ in range(40)]
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark, made):
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in made], SCHEMA).repartition(4)
    assert result(df) == brute_force(made)


def test_given_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert result(df) == brute_force([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", *"wxyz"), (5, "a b c d e f g", *"wxyz"), (3, "a b c d e f g", *"wxyz"), (None, "a b c d e f g", *"wxyz"), (9, "p q r s t", *"wxyz")], SCHEMA)
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near.components(df).collect())
    assert got == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert near.components(df.limit(0)).count() == 0
    kept = near.without_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 9]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.9, 1.0):
        errors = []
        for _ in range(40):
            own = rng.integers(0, 1 << 63, 800).astype(np.uint64)
            same = int(800 * 2 * share / (1 + share))
            other = np.concatenate([own[:same], rng.integers(0, 1 << 63, 800 - same).astype(np.uint64)])
            sketch = near.odd_sketches(np.array([near.samples(own), near.samples(other)])).view(np.uint64)
            ones = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
            assert ones <= near.XOR_LIMIT
            errors.append(near.estimate(ones) - share)
        assert abs(np.mean(errors)) < 0.02


def test_leaders_connect_a_large_group_of_different_near_copies(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(4):
            copy[rnd.randrange(200)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(4)
    assert result(df) == brute_force(rows)


def test_bands_and_sketch_together_miss_less_than_one_pair_in_a_million():
    odd, missed = np.zeros(near.SKETCH_BITS + 1), 0.0  # distribution of the number of odd bits, one differing sample after the other
    odd[0], k = 1.0, np.arange(near.SKETCH_BITS + 1) / near.SKETCH_BITS
    for differ in range(near.PERMUTATIONS + 1):
        missed += math.comb(near.PERMUTATIONS, differ) * 0.25**differ * 0.75 ** (near.PERMUTATIONS - differ) * odd[near.XOR_LIMIT + 1 :].sum()
        for _ in range(2):
            odd = np.append((odd * k)[1:], 0) + np.append(0, (odd * (1 - k))[:-1])
    assert missed + (1 - 0.75**near.ROWS) ** near.BANDS < 1e-6


def test_one_row_a_group_and_one_verdict_a_text(spark):
    words = [f"w{i}" for i in range(80)]
    a, near_a, b = " ".join(words), " ".join([*words[:-1], "other"]), "quite another text of seven words"
    rows = [(3, "a b c d e f g")] * 4 + [(5, "a b c d e f g")] * 3 + [(7, a), (7, b), (2, near_a), (7, b), (20, a), (20, near_a.upper()), (30, "p q r s t u"), (30, "P q r s t u"), (40, ""), (40, None), (None, a), (None, a)]
    rows += [(50, "m " + a[::-1]), (50, "n " + a[::-1]), (60, "u v w x y z"), (60, "h i j k l m")]
    df = spark.createDataFrame([(i, t, *"wxyz") for i, t in rows], SCHEMA).repartition(4)
    kept = near.without_copies(df)
    got = sorted(((r["doc_id"] or 0), (r["text"] or "").lower()) for r in kept.collect())
    reversed_a = next(t for i, t in got if i == 50)[2:]
    assert reversed_a == a[::-1]
    assert [(i, t) for i, t in got if i != 50] == [(0, a), (0, a), (2, near_a), (3, "a b c d e f g"), (7, b), (30, "p q r s t u"), (40, ""), (60, "h i j k l m"), (60, "u v w x y z")]
    assert kept.columns == df.columns and len(got) == 10
    found = near.components(df).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(got)
    assert sorted(r["component_id"] for r in found if r["doc_id"] == 7) == [2, 7, 7]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 7, 150, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.append(a[: n * 3 // 4], rng.integers(0, 1 << 63, n // 4 + 1).astype(np.uint64)))
        x, y = near.parities([a, b]).view(np.uint64)
        ones = int(np.bitwise_count(x ^ y).sum())
        assert ones <= len(np.setxor1d(a, b)) and (ones - len(np.setxor1d(a, b))) % 2 == 0


def test_copies_below_the_limit_move_few_sets(spark, monkeypatch):
    rnd = random.Random(8)
    passage, rows, tested = [f"p{i}" for i in range(200)], [], []
    for k in range(60):  # any two share 200 of about 290 shingles
        rows.append((k, " ".join(passage + [f"own{k}.{i}" for i in range(rnd.randrange(40, 48))])))
    plain = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda pairs, *rest: tested.append(pairs.count()) or plain(pairs, *rest))
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_force(rows) and sum(tested) < 100


def test_only_texts_that_may_be_wanted_are_moved(spark):
    texts = spark.range(-2000, 18000).selectExpr("id as doc_id", "concat('text ', id) as text").withColumn("text_key", near.text_key())
    wanted = texts.filter("doc_id % 50 = 0").select("doc_id", "text_key")
    got = {r.doc_id for r in near.likely(texts, wanted).select("doc_id").collect()}
    assert {*range(-2000, 18000, 50)} <= got and len(got) < 420
    assert near.likely(texts, wanted.limit(0)).count() == 0


def test_texts_that_stay_are_not_moved(spark):
    words = "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', greatest(id, 20) * 100 + i))) as text"
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size, where no table is small
    try:
        df = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", words).withColumn("place", F.spark_partition_id())
        kept = near.without_copies(df).withColumn("now", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.doc_id for r in kept) == [0, *range(21, 400)]
    assert sum(r.place != r.now for r in kept) < 5


def test_rows_in_both_maps_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(near, "SLOTS", 8)  # nearly every key shares a bit with another
    rows = [(i, f"a b c d e f g {i // 3}") for i in range(60)] + [(0, "a b c d e f g 0"), (None, "a b c d e f g 1"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["kept"]) for r in near.components(df).collect()}
    got = [r["doc_id"] for r in near.without_copies(df).collect()]
    assert sorted(i for i in got if i is not None) == sorted({i for i, kept in found if kept and i is not None}) and got.count(None) == 2
