"""Operator 3: counts by plain loops, cutoffs by exact tails."""

import math
import random
import re
from collections import Counter

import numpy as np

from hopglass.llm import rules, text_stats

TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a b c d\n\na b c d\nx", "#*$%&|<> #", "x y z", "aa\x0bbb\x0ccc\rdd", "ÉA éa Ab!? 12", "la la la la la", "w " * 30_000, "same", "same"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def random_texts(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice("ab #|\n\té ") for _ in range(rnd.randrange(200))) for _ in range(n)]


def test_counts_equal_plain_loops():
    for text in TEXTS + random_texts(300):
        assert text_stats.counts(text or "")[:5] == plain(text), text


def test_repeat_words_with_very_many_distinct_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 9])
    assert text_stats.repeat_words(ids, 4) == text_stats.repeat_words(ids, 1 << 22) == 6


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (40, 0.05)):
        for k in range(n + 1):
            assert abs(rules.tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_choice_of_a_cutoff():
    good, bad = np.zeros(rules.GRID + 1), np.zeros(rules.GRID + 1)
    good[0], bad[40] = 5000, 100
    assert rules.choose(good, bad, 0.01, 0.001) == 40
    good[20], bad[20] = 500, 50  # the next step would reject a tenth of the good ones
    assert rules.choose(good, bad, 0.01, 0.001) == 40
    assert rules.choose(good / 1000, bad, 0.01, 0.001) == rules.GRID + 1  # too few labels
    assert rules.choose(good * 0, bad, 0.01, 0.001) == rules.GRID + 1


def frames(spark, n=2500):
    rnd = random.Random(5)
    clean = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    docs, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        docs.append((i, clean().replace(" ", "### ") if bad else clean(), "en" if i % 3 else None, "s", 1, "x", "y"))
        labels.append((i, 0 if bad else 1))
    docs.append((n, None, "rare", "s", 0, "x", "y"))
    docs.append((None, docs[1][1], "en", "s", 0, "x", "y"))
    labels += [(None, 1), (3, None), (10**9, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, bins string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_verdicts_and_the_filter(spark):
    docs, labels = frames(spark)
    got = {r["doc_id"]: r for r in rules.verdicts(docs, labels).collect()}
    for r in docs.collect():
        assert tuple(got[r["doc_id"]][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(r["text"])
    good = [i for i in range(2500) if i % 10]
    assert all(not got[i]["kept"] for i in range(0, 2500, 10) if i % 3) and sum(not got[i]["kept"] for i in good) <= 0.05 * len(good)
    assert got[2500]["base_failed"] and not got[2500]["kept"] and got[None]["kept"]
    kept = rules.passing(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, r in got.items() if r["kept"])
    none = rules.verdicts(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none) and len(none) == 2502
    assert rules.verdicts(docs.limit(0), labels).count() == 0
