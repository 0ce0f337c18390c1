"""Tamper-evident audit log."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut
from .skew import hot_keys, join_on_hot_key, rank_within

GENESIS = "0" * 64
FIELDS = ["case_id", "actor", "action", "payload", "at"]


def canonical_row() -> Column:
    """Text of a row that is hashed together with the previous hash: every field as its length, a colon and itself, a null as
    a tilde, so no two different rows have the same text."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("~")) for c in ["id", *FIELDS]])


def chain(log: DataFrame, chain_key: str = "case_id", heads: DataFrame | None = None) -> DataFrame:
    """I01 build: entry_hash = sha256(prev_hash + canonical(row)), one chain per case.

    ``heads`` (see ``chain_heads``) are the ends of stored chains: a case that has one goes on from it, and entries that do
    not come after it are left out (``late_entries``).  A hash chain is sequential by definition, so what is new of a
    chain is the unit of parallel work.  Rows stream through sorted partitions and only the last hash is kept, so
    a chain of any length needs constant memory."""
    ready = log.withColumn("_text", canonical_row())
    if heads is None:
        ready = ready.withColumn("_head", F.lit(GENESIS))
    else:
        ready = _at_heads(ready, heads, chain_key).filter("_last is null or id > _last").withColumn("_head", F.coalesce("_head", F.lit(GENESIS))).drop("_last")
    ready = ready.repartition(chain_key).sortWithinPartitions(chain_key, "id")
    schema = T.StructType([*log.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def link(batches):
        key, last, begun = None, None, False
        for pdf in batches:
            before, after = [], []
            for k, text, head in zip(pdf[chain_key], pdf["_text"], pdf["_head"]):
                if not begun or k != key:
                    key, last, begun = k, head, True
                before.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                after.append(last)
            yield pdf.drop(columns=["_text", "_head"]).assign(prev_hash=before, entry_hash=after)[schema.names]

    return ready.mapInPandas(link, schema)


def chain_heads(log: DataFrame, chain_key: str = "case_id") -> DataFrame:
    """Last id and hash of each stored chain: all that an append has to read."""
    return log.groupBy(chain_key).agg(F.max("id").alias("last_id"), F.max_by("entry_hash", "id").alias("head"))


def _at_heads(log: DataFrame, heads: DataFrame, chain_key: str) -> DataFrame:
    one = heads.select(chain_key, F.col("last_id").alias("_last"), F.col("head").alias("_head"))
    return join_on_hot_key(log, one, [chain_key], hot_keys(log, [chain_key]), "left")


def late_entries(log: DataFrame, heads: DataFrame, chain_key: str = "case_id") -> DataFrame:
    """Entries that cannot be appended, since their chain is past them."""
    return _at_heads(log, heads, chain_key).filter("id <= _last").drop("_last", "_head")


#: Entries of a leaf, and children of a node, of the hash tree over a chain.
BLOCK, FAN = 1024, 16


def in_blocks(log: DataFrame, chain_key: str = "case_id", block: int = BLOCK) -> DataFrame:
    """The log with the place of each entry in its chain and its block; a table parted by block lets a check read a few blocks."""
    return rank_within(log, [chain_key], ["id"], "place").withColumn("block", F.expr(f"place div {block}"))


def hash_tree(placed: DataFrame, chain_key: str = "case_id", fan: int = FAN) -> DataFrame:
    """Hash tree over each chain (``placed`` as from ``in_blocks``): chain, level, node, hash; level 0 has a node per block.

    Blocks are hashed side by side, so a chain that holds most of the log is still many tasks; a level has a fan-th of the nodes of the
    one below, and there are as many levels for all chains as the longest one needs."""
    entry = F.sha2(F.concat_ws("|", "prev_hash", "entry_hash", canonical_row()), 256)
    together = lambda c, order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x["_h"]), ""), 256).alias("hash")
    nodes = placed.select(chain_key, F.col("block").alias("node"), "place", entry.alias("_h")).groupBy(chain_key, "node").agg(together("_h", "place"))
    level = cut(nodes.withColumn("level", F.lit(0)))
    out, last = level, level.agg(F.max("node")).first()[0] or 0
    while last > 0:
        n = level.agg(F.max("level")).first()[0] + 1
        above = level.select(chain_key, F.expr(f"node div {fan}").alias("up"), "node", F.col("hash").alias("_h"))
        level = cut(above.groupBy(chain_key, "up").agg(together("_h", "node")).withColumnRenamed("up", "node").withColumn("level", F.lit(n)))
        out, last = out.unionByName(level), last // fan
    return out.select(chain_key, "level", "node", "hash")


def altered_blocks(stored: DataFrame, tree: DataFrame, chain_key: str = "case_id", fan: int = FAN) -> DataFrame:
    """Blocks in which two trees of the same log differ, found from the top: only children of nodes that differ are looked at."""
    top = stored.agg(F.max("level")).first()[0]
    top = max(-1 if top is None else top, -1 if (other := tree.agg(F.max("level")).first()[0]) is None else other)
    at = lambda t, n: t.filter(F.col("level") == n).drop("level")
    open_nodes = None
    for n in range(top, -1, -1):
        a, b = at(stored, n), at(tree, n).withColumnRenamed("hash", "_other")
        if open_nodes is not None:
            below = open_nodes.select(chain_key, F.explode(F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)).alias("node"))
            a, b = a.join(below, [chain_key, "node"], "left_semi"), b.join(below, [chain_key, "node"], "left_semi")
        open_nodes = cut(a.join(b, [chain_key, "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("_other"))).select(chain_key, "node"))
    return placed_none(stored, chain_key) if open_nodes is None else open_nodes.withColumnRenamed("node", "block")


def placed_none(tree: DataFrame, chain_key: str) -> DataFrame:
    return tree.select(chain_key, F.col("node").alias("block")).limit(0)


def altered_entries(placed: DataFrame, blocks: DataFrame, chain_key: str = "case_id") -> DataFrame:
    """Entries of the given blocks whose hash is not that of their content; no other block is read."""
    rows = placed.join(blocks, [chain_key, "block"], "left_semi")
    return rows.filter(F.sha2(F.concat("prev_hash", canonical_row()), 256) != F.col("entry_hash"))


def breaks(log: DataFrame, chain_key: str = "case_id") -> DataFrame:
    """I01 verify: entries whose own hash or link to the previous entry is wrong.
    Each entry is paired with the one before it by position, so a chain that holds
    most of the log is still checked by many tasks."""
    placed = cut(rank_within(log, [chain_key], ["id"], "_rank"))
    before = placed.select(chain_key, (F.col("_rank") + 1).alias("_rank"), F.col("entry_hash").alias("_before"))
    v = placed.join(before, [chain_key, "_rank"], "left").withColumn("_before", F.coalesce("_before", F.lit(GENESIS)))
    own = F.sha2(F.concat("prev_hash", canonical_row()), 256)
    problem = F.when(F.col("prev_hash") != F.col("_before"), "broken link").when(F.col("entry_hash") != own, "altered entry")
    return v.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_before", "_rank")


def first_breaks(log: DataFrame, chain_key: str = "case_id") -> DataFrame:
    b = breaks(log, chain_key)
    return b.groupBy(chain_key).agg(F.min("id").alias("first_break"), F.min_by("problem", "id").alias("problem"), F.count("*").alias("n_breaks"))


def with_overrides(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """The latest analyst override wins in the read view; nothing is edited."""
    last = overrides.groupBy("case_id").agg(F.max_by(F.struct("band", "actor"), F.struct("at", "id")).alias("o"))
    return (verdicts.join(last, "case_id", "left")
            .withColumn("shown_band", F.coalesce("o.band", "band")).withColumn("overridden_by", F.col("o.actor")).drop("o"))
