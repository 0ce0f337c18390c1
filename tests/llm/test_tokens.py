"""Operators 8, 9 and 10 against the public tokenizer libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from hopglass.llm import bpe, packing, token_counts
from hopglass.llm.tokens import coder

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a", " a", "a ", "  x  y", "foo\n bar", "it's we'll I'D x'", "日本語 テキスト　x", "é\xa0café naïve", " x  y", "x" * 5000, "ab" * 700 + " z", "\n\n\n a",
         "tab\t x 12 345", "<|endoftext|> hi", "𝔘𝔫𝔦", "\x1cfoo \x1c bar", "0² ½ ⅷ", "\0 \0\0", "same text", "same text"]
SCHEMA = "doc_id long, text string, ids string, n_tokens string, length string, _block string"


def random_texts(n: int, seed: int = 3) -> list[str]:
    rnd, letters = random.Random(seed), " \n\tabcdefghiATQR'strevl0129.,!?-é日 "
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(120))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, *TEXTS, *random_texts(300)]
    return texts, spark.createDataFrame([(i, t, "x", "y", "z", None) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def reference():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_segment_tree_equals_tiktoken_and_round_trips():
    tree, chunks = bpe.codec(RANKS)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})
    texts = TEXTS + random_texts(2000)
    for text, got in zip(texts, chunks.encode(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == whole.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()
    for piece in (b"aaaaaaa", b"abcabcabc" * 30, b"the" * 21):
        assert tree.one(piece) == np.frombuffer(tree.many([piece[:64]], 64)[0], "<u4").tolist() or len(piece) > 64
    assert bpe.codec.__wrapped__(RANKS)[1].encode([" a b  c"]) == [np.array(whole.encode_ordinary(" a b  c"), "<u4").tobytes()]


def test_kept_chunks_are_bounded_without_changing_ids():
    small = coder.__wrapped__(JSON)
    small.keep = 3
    want = reference()
    for text in random_texts(200, 5):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == want(text)


def test_digests(rows):
    texts, df = rows
    want = reference()
    got = {r["doc_id"]: r for r in bpe.digests(df, RANKS).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = want(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encoded(df.filter("doc_id < 5"), RANKS).filter("decoded = cast('' as binary)").count() == 2


def test_length_histogram(rows, spark):
    texts, df = rows
    want = reference()
    lens = [len(want(t)) for t in texts]
    limits = token_counts.by_limit(token_counts.histogram(token_counts.lengths(df, JSON)))
    got = limits.collect()
    assert {r["context_limit"]: r["n_docs"] for r in got} == dict(Counter(lens))
    for r in got:
        k = r["context_limit"]
        assert r["docs_at_least"] == sum(x >= k for x in lens) and r["docs_over"] == sum(x > k for x in lens)
        assert r["tokens_within"] == sum(x for x in lens if x <= k) and r["truncated_total"] == sum(min(x, k) for x in lens)
    assert token_counts.quantile(limits, 0.5).first()[0] == sorted(lens)[(len(lens) + 1) // 2 - 1]
    assert token_counts.by_limit(token_counts.histogram(token_counts.lengths(df.limit(0), JSON))).count() == 0
    long = spark.range(3).selectExpr("id * 5000 as n_tokens", "id + 1 as n_docs")
    assert {r["context_limit"]: r["truncated_total"] for r in token_counts.by_limit(long).collect()} == {0: 0, 5000: 25000, 10000: 40000}


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(rows, size):
    texts, df = rows
    want = reference()
    got = packing.pack(df, JSON, size).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, text in enumerate(texts):
        ids, parts = [*want(text), 0], sorted(by_doc[i], key=lambda r: r["piece"])
        total += len(ids)
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // size)))
        at = 0
        for k, p in enumerate(parts):
            assert p["start"] == at and (p["length"] == size or k == 0)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for some in bins.values():
        at = 0
        for p in sorted(some, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    assert len(bins) <= -(-total // size) + 1
    assert packing.pack(df.limit(0), JSON, size).count() == 0


def test_fullest_against_brute_force():
    from itertools import product

    rnd = random.Random(2)
    for _ in range(60):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(4)}
        top = max(counts)
        chosen = packing.fullest(top, counts, 40)
        assert chosen[top] >= 1 and all(k <= counts[x] for x, k in chosen.items())
        best = max(s for ks in product(*(range(c + 1) for c in counts.values())) if (s := sum(x * k for x, k in zip(counts, ks, strict=True))) <= 40 and ks[list(counts).index(top)])
        assert sum(x * k for x, k in chosen.items()) == best


MARKED = [*TEXTS, "a<|endoftext|>b c", "<|endoftext|>", " <|endoftext|> hi", "x <|endoftext|><|endoftext|>\n y", "a b <|endoftext|>c d", "<|endoftext|", "one two <|endoftext|>  three  four"]


def test_added_tokens_are_found_as_tokenizers_does_by_default():
    t = Tokenizer.from_file(JSON)
    texts = MARKED + [x.replace("q", "<|endoftext|>") for x in random_texts(300, 9)] + random_texts(300, 10)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(50256 in w for w in want) > 5
    assert [np.frombuffer(x, "<u4").tolist() for x in coder(JSON, False).encode(texts)] == want
    for x, w in zip(texts, want, strict=True):
        assert np.frombuffer(coder(JSON, False).encode([x])[0], "<u4").tolist() == w


def test_queries_find_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from hopglass.llm import queries

    t = Tokenizer.from_file(JSON)
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(MARKED)}
    got = {r["context_limit"]: r["n_docs"] for r in queries.op9_token_counts(spark, str(tmp_path)).collect()}
    assert got == dict(Counter(map(len, want.values())))
    for found in (queries.op10_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        for r in found.collect():
            ids = [*want[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]]
            assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
