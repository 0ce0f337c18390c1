"""Chains that go on from stored heads, and hash trees over them."""

import hashlib
import random

from pyspark.sql import functions as F

from hopglass.operators import audit

SCHEMA = "id long, case_id long, actor string, action string, payload string, at string"


def entries(n, seed=1):
    rnd = random.Random(seed)
    return [(i, 0 if i % 10 else rnd.randrange(1, 5), rnd.choice(["a", None]), "look", f"p{i}", "2024") for i in range(n)]


def plain(rows):
    heads, out = {}, {}
    for r in sorted(rows):
        text = "".join("~" if v is None else f"{len(str(v))}:{v}" for v in (r[0], *r[1:]))
        prev = heads.get(r[1], audit.GENESIS)
        heads[r[1]] = hashlib.sha256((prev + text).encode()).hexdigest()
        out[r[0]] = (prev, heads[r[1]])
    return out


def test_appends_equal_one_build(spark):
    rows = entries(300)
    got, whole = {}, None
    for lo, hi in ((0, 1), (1, 120), (120, 300)):
        part = audit.chain(spark.createDataFrame(rows[lo:hi], SCHEMA), heads=None if whole is None else audit.chain_heads(whole))
        part = spark.createDataFrame(part.collect(), part.schema)
        whole = part if whole is None else whole.unionByName(part)
        got |= {r.id: (r.prev_hash, r.entry_hash) for r in part.collect()}
    assert got == plain(rows) and audit.breaks(whole).count() == 0
    late = spark.createDataFrame([rows[50], (1000, *rows[50][1:])], SCHEMA)
    assert [r.id for r in audit.late_entries(late, audit.chain_heads(whole)).collect()] == [50]
    assert [r.id for r in audit.chain(late, heads=audit.chain_heads(whole)).collect()] == [1000]


def test_descent_finds_what_was_altered(spark):
    rows = entries(400)
    stored = audit.in_blocks(audit.chain(spark.createDataFrame(rows, SCHEMA)), block=8).cache()
    tree = audit.hash_tree(stored, fan=3)
    assert tree.filter("case_id = 0 and level = 0").count() == 45 and tree.groupBy("case_id").agg(F.max("level").alias("m")).filter("m = 4").count() == 5
    assert audit.altered_blocks(tree, audit.hash_tree(stored, fan=3), fan=3).count() == 0
    bad = stored.withColumn("actor", F.when(F.col("id").isin(17, 301), "someone").otherwise(F.col("actor")))
    blocks = audit.altered_blocks(tree, audit.hash_tree(bad, fan=3), fan=3)
    assert blocks.count() == 2 and {r.id for r in audit.altered_entries(bad, blocks).collect()} == {17, 301}
    short = stored.filter("not (case_id = 0 and place >= 352)")  # the last block of a chain is gone
    assert [(r.case_id, r.block) for r in audit.altered_blocks(tree, audit.hash_tree(short, fan=3), fan=3).collect()] == [(0, 44)]


def test_an_empty_log(spark):
    none = audit.in_blocks(audit.chain(spark.createDataFrame([], SCHEMA)))
    tree = audit.hash_tree(none)
    assert tree.count() == 0 and audit.altered_blocks(tree, tree).count() == 0
