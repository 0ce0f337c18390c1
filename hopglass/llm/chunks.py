"""Encoding of whole texts by chunks between lone spaces.

A space with a non-space character on either side always starts a new match of the tokenizers' split pattern, so a text
may be cut there and each chunk (with its leading space) encoded by itself.  Chunks repeat a lot; their ids are kept in a
table of bounded size.  A text where a space stands beside other white space is encoded whole, and so is one that
``uncut`` finds a mark in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np

from .text_stats import Numbers

#: Chunks whose ids a worker keeps; when there are more, it starts anew (this bounds memory, not results).
KEEP = 700_000


class ChunkCoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.  ``whole`` encodes strings; ``spaced`` encodes the chunks of
    a string in which each chunk follows one space, and gives a string of ids for each.  Texts for which ``uncut`` gives
    something true only go to ``whole``."""

    def __init__(self, whole: Callable[[Sequence[str]], list[bytes]], spaced: Callable[[str], list[bytes]], keep: int = KEEP, uncut: Callable[[str], object] | None = None):
        self.whole, self.spaced, self.keep, self.uncut = whole, spaced, keep, uncut
        self.numbers, self.ids = Numbers(), []

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [[t] if self.uncut and self.uncut(t) else t.split(" ") for t in texts]
        heads = [c.pop(0) for c in cut]
        if len(self.ids) > self.keep:
            self.numbers, self.ids = Numbers(), []
        numbers, old = [list(map(self.numbers.__getitem__, c)) for c in cut], len(self.ids)
        fresh = list(islice(self.numbers, old, None))
        alone = [c for c in fresh if c and not c[0].isspace() and not c[-1].isspace()]
        if len(alone) == len(fresh):
            self.ids += self.spaced(" " + " ".join(alone)) if alone else []
        else:
            found = dict(zip(alone, self.spaced(" " + " ".join(alone)) if alone else [], strict=True))
            self.ids += map(found.get, fresh)  # None marks a chunk that can't stand alone
        parts = [list(map(self.ids.__getitem__, n)) for n in numbers]
        odd = [i for i, p in enumerate(parts) if None in p or p and heads[i][-1:].isspace()]
        for i in odd:
            heads[i], parts[i] = texts[i], []
        return [b"".join([head, *p]) for head, p in zip(self.whole(heads), parts, strict=True)]


def at_starts(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The ids cut before each start."""
    data, at = ids.astype("<u4").tobytes(), (np.flatnonzero(starts) * 4).tolist()
    return [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
