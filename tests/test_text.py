"""The compatibility fold and what it may leave out."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from hopglass.functions import fixed_values as fx, text
from hopglass.plans import derived


def test_stable_characters_are_left_alone_by_the_fold():
    stable = [chr(c) for c in range(0x3000) if re.match(f"[{text.STABLE}]", chr(c))]
    assert len(stable) > 280
    fold = lambda s: unicodedata.normalize("NFKC", s)
    assert all(fold(c) == c for c in stable)
    assert all(fold(a + b) == a + b for a in stable for b in stable)


def test_fold_equals_the_library(spark):
    rows = ["plain", "Größe – «naïve» ¿qué?", "привет", "\uff56\uff45rify", "e\u0301", "\u2460 \u00b2 \u00a0x", "", None, "й\u0306"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.nfkc(F.col("t")).alias("n")).collect()}
    assert got == {i: None if r is None else unicodedata.normalize("NFKC", r) for i, r in enumerate(rows)}


def test_unstable_is_all_that_is_not_stable():
    both = re.compile(f"[{text.STABLE}]"), re.compile("[" + text.UNSTABLE.replace(r"\x{10FFFF}", "\U0010FFFF") + "]")
    assert all(bool(both[0].match(chr(c))) != bool(both[1].match(chr(c))) for c in [*range(0xD800), *range(0xE000, 0x11000), 0x1F600, 0x10FFFF])


def test_patterns_look_for_their_first_letters_before_they_look_behind():
    assert text._first_letters(r"(?:ceo|[1-9]?\d|(?:vp|x?y))\b") == "c1-90-9vxy"
    assert [text._first_letters(p) for p in (r"(?:a|)b", r"a*b", r"(?:a|b)?", r"\sb", r"(?=a)b", r"a{0,2}b")] == [None] * 6
    assert text.rx(r"\bby\b") == r"(?i)(?=[b])(?<![A-Za-z0-9_])by" + text._ASCII_BOUNDARY


def test_patterns_find_the_same_with_their_first_letters_first(spark):
    rnd = random.Random(3)
    words = "by with from account accounts _by by_ 1.2.3.4 11.22.33.44 x11.2.3.4 a 1234 12345678901 update the bank details you are now a OTP o.t.p gift cards buy codes send ceo vp of urgent don't share".split()
    rows = spark.createDataFrame([("".join(rnd.choice(words) + rnd.choice([" ", "", "é", "-", "."]) for _ in range(12)),) for _ in range(3000)], "t string")
    patterns = [fx.BY_PATTERN, fx.WITH_PATTERN, fx.LEGACY_IP_PATTERN, fx.CODE_PATTERN, fx.ACCOUNT_THREAT_PATTERN, *fx.PAYMENT_PATTERNS, fx.GIFT_CARD_PATTERN, fx.EXECUTIVE_PATTERN, fx.EXECUTIVE_ASK_PATTERN,
                fx.LEGIT_FLOW_PATTERN, fx.REASSURE_PATTERN, fx.INJECTION_PATTERN, fx.SIGNIN_PATTERN]
    all_of = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    wrong = [F.sum((all_of(text.rx(p)) != all_of("(?i)" + p.replace(r"\b", text._ASCII_BOUNDARY))).cast("int")) for p in patterns]
    assert set(rows.agg(*wrong).first()) == {0}


def test_messages_of_one_file_are_spread_over_the_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "array_join(transform(sequence(1, 40), x -> sha2(concat(id, x), 512)), '') as text", "'s' as source", "'en' as lang").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = derived.view(spark, str(tmp_path), "d_messages")
    sizes = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("body_text")).collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 3000
