"""The pipeline against its stages done plainly."""

import re
import zlib

import numpy as np
import public_tokenizers as P
from test_near import brute_force
from test_pii import PATTERNS, plain
from tokenizers import Tokenizer

import corpus_pipeline
from hopglass.llm import factorization, rules


def covered(text):
    """The text with base spans replaced; overlapping ones become one."""
    spans = sorted((a, b, list(PATTERNS).index(k)) for k, found in plain(text).items() for a, b in found)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{list(PATTERNS)[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_run_equals_plain_stages(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in factorization.scored(docs, factorization.trained(docs, labels)).collect() if r["score"] >= 0.7}
    left = docs.filter(docs["doc_id"].isin(list(good)))
    good = {r["doc_id"] for r in rules.verdicts(left, labels).collect() if r["kept"]}
    good = {i for i, _, _, kept in brute_force([(i, texts[i]) for i in sorted(good)]) if kept}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = set()
    for i in good:
        ids = [*tokenizer.encode(covered(texts[i]), add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = corpus_pipeline.run(spark, small).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_stages_keep_columns_and_run_on_no_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0
    assert re.match(r"\w+", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
