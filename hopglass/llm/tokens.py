"""Ids by a byte-level BPE vocabulary in the ``tokenizers`` JSON format.

The merges run in tiktoken, which is several times faster on short strings; a test holds its ids against ``tokenizers``.

The file's added tokens (such as an end-of-text mark) are found inside texts as ``tokenizers`` finds them by default: the
text is split at them and each gives its own id.  With ``encode_special_tokens`` their letters are encoded instead, as by the
attribute of that name there."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .chunks import ChunkCoder, at_starts


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies, by the usual rule: printable bytes stand for
    themselves, the others are numbered upwards from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def coder(path: str, encode_special_tokens: bool = True) -> ChunkCoder:
    """One per worker process, vocabulary file and treatment of added tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, added = given["model"], given.get("added_tokens") or []
    letter, own = byte_letters(), {a["content"]: a["id"] for a in added}
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if all(c in letter for c in token) and token not in own}
    encoding = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    # encode_special_tokens concerns added tokens that are special; the others are always found
    marks = {a["content"]: a["id"] for a in added if not (encode_special_tokens and a["special"])}
    if any(a[flag] for a in added if a["content"] in marks for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take in or depend on their neighbours are not supported")
    mark = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None  # the longest of those that start at a place

    def plain(text: str) -> bytes:
        return np.array(encoding.encode_ordinary(text), "<u4").tobytes()

    def whole(text: str) -> bytes:
        if mark is None or not mark.search(text):
            return plain(text)
        out, at = [], 0
        for found in mark.finditer(text):
            out += [plain(text[at : found.start()]), marks[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, plain(text[at:])])

    def chunks(text: str) -> list[bytes]:
        ids = encoding.encode_to_numpy(text, disallowed_special=())
        return at_starts(ids, spaced[ids])

    return ChunkCoder(lambda texts: list(map(whole, texts)), chunks, uncut=mark and mark.search)
