"""Operator 1: base spans against Python's re, the added ones by example."""

import hashlib
import random
import re

from hopglass.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, candidates string, base_email string, start long"
ODD = [None, "", "a@b.com_x@d.com", "..@@a@b.c..d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255", "4111 1111 1111 1111 4111-1111-1111-1112", "0000000000000 00000000000000000000", "+1 (415) 555-0100+44 20 7946 0958 +1()2 +12",
       "é😀 x@y.de ü 10.0.0.1", "9" * 30_000, "a" * 50_000, "1 " * 20_000, "x@y.z " * 400, "1.2.3.4@5.6.7.8", "same 1.2.3.4", "same 1.2.3.4"]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


def random_texts(n):
    rnd = random.Random(6)
    return ["".join(rnd.choice("0123456789 .-+()@ab_é") for _ in range(rnd.randrange(90))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def test_base_spans_equal_plain_search(spark):
    texts = ODD + random_texts(1500)
    for r in pii.detected(frame(spark, texts)).collect():
        want = plain(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS], texts[r["doc_id"]][:80]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(filter(None, told.split(","))) <= set(spans) and len(spans) == sum(map(len, want.values())) + r["n_added"]
        order = [(list(PATTERNS).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_learned_spans_are_added_and_clean_texts_left_alone(spark):
    rnd = random.Random(3)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    texts = [f"please call +1 ({number(3)}) 555-{number(4)} or tel {number(2)}" for _ in range(400)] + [f"host 10.{rnd.randrange(9)}.0.{rnd.randrange(99)} is up" for _ in range(400)]
    texts += ["call 1 (415) 555-0100 today", "host 10[.]0[.]0[.]1 is up", "only words here, and 2024 or 3.5 besides"]
    got = {r["doc_id"]: r for r in pii.detected(frame(spark, texts)).collect()}
    assert got[800]["spans"] == "phone:5:21" and got[801]["spans"] == "ip:5:19" and got[802]["spans"] == ""
    assert all(r["n_added"] == 0 for i, r in got.items() if i < 800)


def test_redaction_keeps_columns(spark):
    docs = frame(spark, ["mail a@b.com, +1 (415) 555-0100 end", None, "clean é", "1.2.3.4@5.6.7.8 x"])
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == "mail [EMAIL], [PHONE] end" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] is None and got[1]["n_chars"] == 7 and got[2]["text"] == "clean é"
    assert "1.2.3.4" not in got[3]["text"] and got[3]["candidates"] == "x"


def test_trees_and_sql_agree_and_no_rows(spark):
    docs = frame(spark, random_texts(400))
    rows = pii.proposed(docs.select("doc_id", "text"), "text")
    chosen = pii.Selector.fitted(rows)
    assert chosen.trees
    names = [f"c.{n}" for n in pii.NAMES]
    from pyspark.sql import functions as F

    margin = sum((F.lit(pii.STEP) * chosen._tree(t, F.col("c")) for t in chosen.trees), F.lit(0.0))
    for r in rows.select(F.explode("candidates").alias("c")).select(*names, margin.alias("m")).limit(300).collect():
        assert abs(r["m"] - pii.margin_of(chosen.trees, tuple(r)[:-1])) < 1e-9
    assert pii.detected(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).count() == 0
