"""Queries I01-I02."""

from pyspark.sql import functions as F

from ..operators import audit as op, scoring
from ..session import cut
from . import oracle_parts as o
from .registry import query

_CAN = " || ".join(f"coalesce(CAST(length(CAST({c} AS STRING)) AS STRING) || ':' || CAST({c} AS STRING), '~')" for c in ("id", "case_id", "actor", "action", "payload", 'd_audit."at"'))
_CHAIN = f"""n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) AS k, {_CAN} AS txt FROM d_audit),
    ch AS (SELECT id, case_id, k, '{op.GENESIS}' AS prev_hash, sha256('{op.GENESIS}' || txt) AS entry_hash FROM n WHERE k = 1
      UNION ALL SELECT n.id, n.case_id, n.k, ch.entry_hash, sha256(ch.entry_hash || n.txt) FROM ch JOIN n ON n.case_id = ch.case_id AND n.k = ch.k + 1)"""


@query("i01_build_chain", f"WITH RECURSIVE {_CHAIN} SELECT id, case_id, prev_hash, entry_hash FROM ch")
def i01(src):
    return op.chain(src.d_audit).select("id", "case_id", "prev_hash", "entry_hash")


@query("i01_verify_chain", f"""WITH RECURSIVE {_CHAIN}, t AS (SELECT id, case_id, k, CASE id % 97 WHEN 5 THEN repeat('f', 64) ELSE entry_hash END AS entry_hash FROM ch),
    v AS (SELECT ch.id, ch.case_id, CASE WHEN ch.prev_hash <> coalesce(p.entry_hash, '{op.GENESIS}') THEN 'broken link' WHEN t.entry_hash <> ch.entry_hash THEN 'altered entry' END AS problem
      FROM ch JOIN t ON t.id = ch.id LEFT JOIN t p ON p.case_id = ch.case_id AND p.k = ch.k - 1)
    SELECT case_id, min(id) AS first_break, arg_min(problem, id) AS problem, count(*) AS n_breaks FROM v WHERE problem IS NOT NULL GROUP BY case_id""")
def i01_verify(src):
    """Chains with some entries altered on purpose."""
    log = op.chain(src.d_audit)
    bad = log.withColumn("entry_hash", F.when(F.col("id") % 97 == 5, F.lit("f" * 64)).otherwise(F.col("entry_hash")))
    return op.first_breaks(bad)


@query("i01_continued_chain", f"WITH RECURSIVE {_CHAIN} SELECT id, case_id, prev_hash, entry_hash FROM ch")
def i01_continued(src):
    """Three appends, each from the stored heads alone, give the chain of one build."""
    log, whole = src.d_audit, None
    for k in range(3):
        part = log.filter(F.col("id").between(*_share(src, k)))
        part = cut(op.chain(part, heads=None if whole is None else op.chain_heads(whole)))
        whole = part if whole is None else whole.unionByName(part)
    return whole.select("id", "case_id", "prev_hash", "entry_hash")


def _share(src, k, parts=3):
    """Bounds of the k-th part of the ids."""
    top = src.events.agg(F.max("event_id")).first()[0] + 1
    return k * top // parts, (k + 1) * top // parts - 1


_ALTERED = "id % 211 = 5"


@query("i01_hash_tree", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS k FROM d_audit)
    SELECT case_id, id, CAST(k // 4 AS BIGINT) AS block FROM n WHERE {_ALTERED}""")
def i01_tree(src):
    """Altered entries of a copy, found by descent through its hash tree and that of the stored log."""
    stored = cut(op.in_blocks(op.chain(src.d_audit), block=4))
    copy = stored.withColumn("payload", F.when(F.expr(_ALTERED), F.concat(F.coalesce("payload", F.lit("")), F.lit("!"))).otherwise(F.col("payload")))
    blocks = op.altered_blocks(op.hash_tree(stored, fan=2), op.hash_tree(copy, fan=2), fan=2)
    return op.altered_entries(copy, blocks).select("case_id", "id", F.col("block").cast("bigint").alias("block"))


@query("i02_overrides", f"""WITH {o.verdict_ctes()}, ov AS (SELECT user_id AS case_id, arg_max(CASE event_id % 2 WHEN 0 THEN 'BENIGN' ELSE 'CRITICAL' END, (ts, event_id)) AS band,
      arg_max('analyst' || CAST(event_id % 4 AS STRING), (ts, event_id)) AS actor FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT v.case_id, v.score, coalesce(ov.band, v.band) AS shown_band, ov.actor AS overridden_by FROM verdict v LEFT JOIN ov ON ov.case_id = v.case_id""")
def i02(src):
    e = src.events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
        F.when(F.col("event_id") % 2 == 0, "BENIGN").otherwise("CRITICAL").alias("band"), F.concat(F.lit("analyst"), (F.col("event_id") % 4).cast("string")).alias("actor"))
    return op.with_overrides(scoring.score_cases(src.d_evidence), e).select("case_id", "score", "shown_band", "overridden_by")
