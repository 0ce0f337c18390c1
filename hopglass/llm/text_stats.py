"""Counts over one whole text that quality rules and classifiers share."""

from __future__ import annotations

import numpy as np

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LARGE, LETTERS, DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))

#: The counts, in the order of ``counts``.
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_large", "n_letters", "n_digits", "n_marks"]


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if distinct < 1 << 21:
        key = a << 42 | b << 21 | c
    else:
        key = np.unique(a << 32 | b, return_inverse=True)[1] << 32 | c
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(key)] |= again
    return int(hit.sum())


def counts(text: str) -> tuple[int, ...]:
    data = text.encode()
    words, own = data.split(), Numbers()
    ids = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    rid = lambda chars: len(data) - len(data.translate(None, chars))
    large = rid(LARGE)
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids, len(own)), len(lines), len(own),
            large, large + rid(LETTERS), rid(DIGITS), text.count("!") + text.count("?"))


#: Shares between 0 and 1 by name: numerator, denominator, factor.
SHARES = {"symbols": ("n_symbols", "word_chars", 1), "capitals": ("n_large", "n_letters", 1), "digits": ("n_digits", "word_chars", 1), "marks": ("n_marks", "n_words", 1),
          "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 1), "sameness": (None, "n_words", 1), "long_words": ("word_chars", "n_words", 0.05)}


def shares(c: np.ndarray) -> np.ndarray:
    """Rows of ``counts`` to rows of the shares, in the order of SHARES; an empty denominator gives 0."""
    col = dict(zip(NAMES, c.T, strict=True))
    out = []
    for top, bottom, factor in SHARES.values():
        n = col[top] if top else col["n_words"] - col["n_distinct"]
        out.append(np.clip(factor * n / np.maximum(col[bottom], 1), 0, 1) * (col[bottom] > 0))
    return np.array(out).T.reshape(-1, len(SHARES))
