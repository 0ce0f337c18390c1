"""Operator 11 against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hopglass.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, bucket string"


def brute_force(rows, threshold, top=None):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: n for g, n in f.items() if len(g) > 1 and n >= threshold}
        rows = []
        for g, a in cand.items():
            inside = [n for h, n in cand.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * n >= 80 * a for n in inside):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(seed=5, n=120):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "DELTA", "ß", "été", "x\x1cy", "日本", "e-f"]
    fixed = ["north sea oil platform", "beta gamma delta", "x\x1cy ß"]
    rows = [(None, "en"), ("", None), (" \t\n.,", "en"), ("a", None), ("...a b c d...", None), ("w " * 900, "en"), ("same text here\n" * 40, "de")]
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randrange(1, 40))]
        rows.append((rnd.choice([" ", "\t", "  "]).join(p + rnd.choice(["", "", ".", "!\n"]) for p in parts), rnd.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize(("threshold", "how"), [(5, {}), (12, {"filter_bits": 64, "step_words": 50}), (2, {"step_words": 300})])
def test_all_phrases(spark, threshold, how):
    rows = rows_of()
    df = spark.createDataFrame([(i, t, lang, "p", "n", "b") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, threshold, None, **how).collect()))
    assert got == brute_force(rows, threshold) and got
    first = sorted(map(tuple, phrases.collocations(df, threshold, 4, **how).collect()))
    assert first == brute_force(rows, threshold, 4)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", "", "")], SCHEMA)).collect() == []


def test_large_counts_are_exact(spark):
    """Scores whose products pass 64 bits."""
    big = 9_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 3)], "a long, l long, r long")
    score = df.selectExpr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").first()[0]
    assert score == 2000000 * big // (2 * big + 4)


@pytest.mark.parametrize("seed", range(6))
def test_summary_keeps_what_is_frequent(seed):
    rng, threshold = np.random.default_rng(seed), 30
    keys = np.append(rng.zipf(1.3, 60_000) % 5_000, rng.integers(10_000, 10**9, 140_000))
    rng.shuffle(keys)
    summary = phrases.Summary()
    summary.mass = len(keys)
    for part in np.array_split(keys, 9):
        summary.add(*np.unique(part, return_counts=True), threshold)
    own, n = np.unique(keys, return_counts=True)
    kept = summary.survivors(threshold)
    assert summary.taken < threshold and len(kept) <= summary.capacity(threshold)
    assert set(own[n >= threshold].tolist()) <= set(kept.tolist())
    assert summary.taken > 0 and len(kept) < 3 * (n >= threshold).sum()
