"""Operator 8: byte-level BPE encoding and decoding with a segment tree.

A piece is one match of the split pattern.  A segment tree over its byte positions stores, per node, the smallest
(rank of the pair that starts here, position); its root is the leftmost pair of minimum rank.  A merge joins the pair at
the root, unlinks the right neighbour and makes logarithmic point updates for the live neighbours.  Short pieces are
merged side by side, one tree per column of an array; long ones each in a tree of their own, in O(n log n).

Texts: null and empty give no ids.  Any Unicode text is encoded whole; decoding gives back its UTF-8 bytes.  Repeated
rows each give a row.  An empty table gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkCoder
from .common import id_and_text, steps

#: Pieces of more bytes get a tree of their own.
SIDE_BY_SIDE = 64
NONE = 1 << 60
#: In a tree of a short piece: over any rank * SIDE_BY_SIDE.
NEVER = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class SegmentTreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, dict(map(reversed, ranks.items()))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], NONE), np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NEVER)

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """(rank of the pair, place) as one number; NEVER where there is no such pair."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at] * width + place, NEVER).astype(np.int32)

    # ---------------------------------------------------------------- one long piece

    def one(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, pairs, none = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), self.pairs, int(NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for j in range(width - 1, 0, -1):
            tree[j] = min(tree[2 * j], tree[2 * j + 1])

        def put(i: int, rank: int | None) -> None:
            j = width + i
            tree[j] = none if rank is None else rank * width + i
            while j > 1:
                j >>= 1
                low = min(tree[2 * j], tree[2 * j + 1])
                if tree[j] == low:
                    break
                tree[j] = low

        alive = bytearray(b"\1") * n
        while (root := tree[1]) != none:
            i = root % width
            right = after[i]
            ids[i], alive[right] = root // width, 0
            after[i] = nxt = after[right]
            put(right, None)
            put(i, pairs.get(ids[i] << 32 | ids[nxt]) if nxt < n else None)
            if nxt < n:
                before[nxt] = i
            if (p := before[i]) >= 0:
                put(p, pairs.get(ids[p] << 32 | ids[i]))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    # ---------------------------------------------------------------- many short pieces

    def many(self, pieces: Sequence[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to ``width`` bytes (a power of two), merged in step; column c of every array belongs to piece c."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        col, row = np.repeat(np.arange(n), lengths), _within(lengths)
        ids = np.zeros((width + 1, n), np.int64)  # row ``width`` of ids, after and before stands for "no neighbour"
        ids[row, col] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        live = np.zeros((width, n), bool)
        live[row, col] = True
        place = np.arange(width + 1, dtype=np.int16)[:, None]
        after = np.where(place + 1 < lengths, place + 1, width).astype(np.int16)
        before = np.where(place > 0, place - 1, width).astype(np.int16).repeat(n, 1)
        tree = np.full((2 * width, n), NEVER)
        paired = row < lengths[col] - 1
        r, c = row[paired], col[paired]
        tree[width + r, c] = self.leaf(ids[r, c], ids[r + 1, c], r, width)
        for j in range(width - 1, 0, -1):
            np.minimum(tree[2 * j], tree[2 * j + 1], out=tree[j])
        c = np.arange(n)
        while True:
            root = tree[1, c]
            going = root < NEVER
            c, root = c[going], root[going]
            if not len(c):
                break
            i, own = root % width, (root // width).astype(np.int64)
            right = after[i, c]
            nxt, p = after[right, c], before[i, c]
            ids[i, c], live[right, c] = own, False
            after[i, c], before[nxt, c] = nxt, i
            tree[width + right, c] = NEVER
            tree[width + i, c] = np.where(nxt < width, self.leaf(own, ids[nxt, c], i, width), NEVER)
            held = np.flatnonzero(p < width)
            at, ch = p[held], c[held]
            tree[width + at, ch] = self.leaf(ids[at, ch], own[held], at, width)
            a, b, d = (width + right) >> 1, (width + i) >> 1, (width + at) >> 1
            while True:
                for j, k in ((a, c), (b, c), (d, ch)):
                    tree[j, k] = np.minimum(tree[2 * j, k], tree[2 * j + 1, k])
                if a[0] == 1:
                    break
                a, b, d = a >> 1, b >> 1, d >> 1
        flat = ids[:width].T[live.T].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(0)) * 4
        return [flat[s:e] for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def pieces(self, pieces: Sequence[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, as little-endian unsigned 32-bit bytes."""
        out, by_width = {}, {}
        for piece in pieces:
            if (rank := self.ranks.get(piece)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) > SIDE_BY_SIDE:
                out[piece] = np.array(self.one(piece), "<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for width, some in by_width.items():
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                out.update(zip(part, self.many(part, width), strict=True))
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[SegmentTreeBpe, ChunkCoder]:
    """One per worker process and rank file."""
    import public_tokenizers
    import regex

    bpe, split = SegmentTreeBpe(load_ranks(path)), regex.compile(public_tokenizers.PATTERN).findall

    def found(texts: Sequence[str]) -> list[tuple[list[str], list[bytes]]]:
        pieces = list(map(split, texts))
        own = list(set().union(*pieces))
        coded = [p.encode() for p in own]
        ids = bpe.pieces(coded)
        of = dict(zip(own, map(ids.__getitem__, coded), strict=True))
        return [(some, list(map(of.__getitem__, some))) for some in pieces]

    def chunks(text: str) -> list[bytes]:
        [(pieces, ids)] = found([text])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        first = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        data, at = b"".join(ids), np.append(0, ends[:-1])[first].tolist()
        return [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]

    return bpe, ChunkCoder(lambda texts: [b"".join(ids) for _, ids in found(texts)], chunks, keep=400_000)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every document."""

    def run(batches):
        bpe, chunks = codec(path)
        for keys, texts in steps(batches):
            ids = [np.frombuffer(x, "<u4") for x in chunks.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                                              pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes, made where the ids are."""

    def run(batches):
        bpe, chunks = codec(path)
        shown = {i: str(i) for i in bpe.tokens}
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for keys, texts in steps(batches):
            n, by_ids, by_bytes = [], [], []
            for x in chunks.encode(texts):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                by_ids.append(sha(" ".join(map(shown.__getitem__, ids)).encode()))
                by_bytes.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
