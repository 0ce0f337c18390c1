"""Operators 5 and 7: identities, brute force and held-out quality."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from hopglass.llm import factorization, hmm


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, word string, places string").repartition(3)


# ---------------------------------------------------------------- factorisation machine

def test_sum_of_squares_identity_equals_all_pairs():
    m = factorization.Machine()
    rng = np.random.default_rng(1)
    m.w0, m.w, m.v = 0.3, rng.normal(size=factorization.PLACES), rng.normal(size=(factorization.PLACES, factorization.RANK))
    texts = ["alpha beta beta gamma", "", "x", "A a\na b!"]
    row, place, value = factorization.features(texts)
    got, _ = m.margins(row, place, value, len(texts))
    for t in range(len(texts)):
        p, x = place[row == t], value[row == t].astype(float)
        pairs = sum(m.v[p[i]] @ m.v[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert got[t] == pytest.approx(m.w0 + (m.w[p] * x).sum() + pairs, rel=1e-5)


def test_quality_is_learned_on_other_rows_than_it_is_held_against(spark, small):
    docs, labels = spark.read.parquet(f"{small[:-3]}1/documents.parquet"), spark.read.parquet(f"{small[:-3]}1/labels.parquet")
    machine = factorization.trained(docs, labels)
    got = {r["doc_id"]: r for r in factorization.scored(docs, machine).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.9
    kept = factorization.accepted(docs, machine)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r["predicted"]}


def test_scores_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", "long " * 50_000, "same", "same"], [1, 2, 3, 4, None])
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = factorization.scored(docs, factorization.trained(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] is None)["held_out"] is False
    untrained = factorization.trained(docs, labels.limit(0))
    assert all(abs(r["score"] - 0.5) < 0.1 for r in factorization.scored(docs, untrained).collect())
    assert factorization.scored(docs.limit(0), untrained).count() == 0


# ---------------------------------------------------------------- hidden Markov model

def tiny_model(rng):
    m = hmm.Model.first()
    m.emit = rng.dirichlet(np.ones(hmm.CLASSES + 1), hmm.STATES)
    m.move, m.start = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.STATES))
    return m


def test_forward_and_expected_counts_equal_sums_over_all_paths():
    m = tiny_model(np.random.default_rng(3))
    sequences = [np.array([5, 9, 5, hmm.END]), np.array([hmm.END]), np.array([7, 7, hmm.END])]
    want, counts = [], np.zeros((1 + hmm.STATES + hmm.CLASSES + 1, hmm.STATES))
    for seq in sequences:
        weights = {}
        for path in product(range(hmm.STATES), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[path[0], seq[0]]
            for a, b, x in zip(path, path[1:], seq[1:], strict=False):
                p *= m.move[a, b] * m.emit[b, x]
            weights[path] = p
        total = sum(weights.values())
        want.append(math.log10(total))
        for path, p in weights.items():
            counts[0, path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                counts[1 + a, b] += p / total
            for s, x in zip(path, seq, strict=True):
                counts[1 + hmm.STATES + x, s] += p / total
    assert hmm.forward(m, sequences) == pytest.approx(want)
    assert np.allclose(hmm.expected(m, sequences, np.ones(3, bool)), counts)


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    sequences = [np.append(rng.integers(0, 40, rng.integers(1, 60)) + 100 * (k % 2), hmm.END) for k in range(60)]
    m, last = hmm.Model.first(), -np.inf
    for _ in range(6):
        now = hmm.forward(m, sequences).sum()
        assert now > last - 1
        last, m = now, hmm.Model.of(hmm.expected(m, sequences, np.ones(60, bool)))


def base(texts, train):
    counts = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    return n, [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for t in texts for w in [[*(t or "").encode().lower().split(), None]]]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("known_words", [3, 1 << 17])
def test_scores_against_plain_counts(spark, small, known_words):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [*map(tuple, docs.collect()), (10_001, None), (10_002, ""), (None, "the end"), (10_003, "the end"), (10_003, "the end"), (10_004, "a b ÀB " * 3000)]
    texts = [t for _, t in rows]
    got = sorted(hmm.scores(docs_of(spark, texts, [i for i, _ in rows]), known_words=known_words).collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]))
    n, want = base(texts, [t for i, t in rows if not held(i)])
    want = sorted(zip([i for i, _ in rows], want, strict=True), key=lambda x: (-1 if x[0] is None else x[0], x[1][0]))
    assert len(got) == len(rows)
    for r, (i, (tokens, known, score)) in zip(got, want, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (i, tokens, known, n, held(i))
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)  # better than single words on held-out texts


def test_start_values_come_from_every_training_text(spark):
    texts = [f"alone{i} the of" for i in range(1300)] + ["long the of " * 8000 + "alone1300"]
    docs = docs_of(spark, texts, list(range(1301)))
    model, never = hmm.trained(docs, rounds=0), set(range(hmm.CLASSES)) - {int(c) for i in hmm.class_ids(texts, hmm._Classes()) for c in i}
    floor = model.emit[:, min(never)]
    assert all((model.emit[:, zlib.crc32(f"alone{i}".encode()) & hmm.CLASSES - 1] > 2 * floor).any() for i in range(1301))
    assert hmm.follower_counts(docs).sum() == sum(len(t.split()) + 1 for t in texts)
    for m in (model, hmm.trained(docs.limit(0), rounds=1)):
        assert np.allclose([m.start.sum(), *m.move.sum(1), *m.emit.sum(1)], 1) and min(m.start.min(), m.move.min(), m.emit.min()) > 0


def test_probabilities_of_next_words_sum_to_one(spark):
    docs = docs_of(spark, ["a b a c", "b", "c c a"], [0, 1, 3])
    rows = hmm.scores(docs.union(docs_of(spark, [""], [4])))
    alone = 10 ** next(r["score"] for r in rows.collect() if r["doc_id"] == 4)
    assert 0 < alone < 1


def test_no_rows(spark):
    assert hmm.scores(docs_of(spark, ["a"]).limit(0)).count() == 0
