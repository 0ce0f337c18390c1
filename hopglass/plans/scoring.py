"""Queries V01-V14."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators import dims, rulebook, scoring as op
from . import oracle_parts as o
from .registry import query

_FLAT = F.array_join
_V = f"WITH {o.verdict_ctes()} "
_VALL = f"WITH {o.verdict_ctes(all_cases=True)} "


@query("v01_rule_points", _V + "SELECT case_id, pos, signal, points FROM t")
def v01(src):
    return op.rule_points(src.d_evidence).select("case_id", "pos", "signal", "points")


@query("v01_unknown_signals", f"""WITH {o.verdict_ctes()} SELECT signal, count(*) AS n FROM d_evidence
    WHERE status = 'TRIGGERED' AND signal NOT IN (SELECT signal FROM r) GROUP BY signal""")
def v01_unknown(src):
    return op.unknown_signals(src.d_evidence)


@query("v02_suppressed_credits", _V + "SELECT case_id, withheld, suppressed_by FROM verdict WHERE withheld <> ''")
def v02(src):
    return (op.score_cases(src.d_evidence).filter(F.size("suppressed_negatives") > 0)
            .select("case_id", _FLAT("suppressed_negatives", ",").alias("withheld"),
                    _FLAT("suppressed_by", ",").alias("suppressed_by")))


@query("v03_identity_credits", _V + f"""SELECT case_id, signal, NOT blocked AS granted FROM flag
    WHERE signal IN ({o.words(fx.IDENTITY_CREDITS[dims.LATEST])})""")
def v03(src):
    credits = fx.IDENTITY_CREDITS[dims.LATEST]
    v = op.score_cases(src.d_evidence)
    granted = v.select("case_id", F.explode(F.filter(F.transform("contributions", lambda c: c["signal"]),
                       lambda s: s.isin(credits))).alias("signal"), F.lit(True).alias("granted"))
    held = v.select("case_id", F.explode(F.filter("suppressed_negatives", lambda s: s.isin(credits))).alias("signal"),
                    F.lit(False).alias("granted"))
    return granted.unionByName(held)


@query("v04_strongest_instance", _V + "SELECT case_id, signal, pos, points FROM best")
def v04(src):
    return (op.strongest_instances(src.d_evidence).filter(F.col("best").isNotNull())
            .select("case_id", "signal", "best.pos", "best.points"))


@query("v05_score", _V + "SELECT case_id, score FROM verdict")
def v05(src):
    return op.score_cases(src.d_evidence).select("case_id", "score")


def _bands(version):
    def run(src):
        return (op.score_cases(src.d_evidence, version=version).groupBy("band").agg(F.count("*").alias("n_cases"),
                F.min("score").alias("lo"), F.max("score").alias("hi")))
    return run


for _v, _name in ((dims.LATEST, "v06_bands"), (dims.EARLIER, "v06_bands_1_3_0")):
    query(_name, f"WITH {o.verdict_ctes(_v)} SELECT band, count(*) AS n_cases, min(score) AS lo, max(score) AS hi FROM verdict GROUP BY band")(_bands(_v))


@query("v07_confidence", _V + "SELECT case_id, CAST(confidence AS DOUBLE) AS confidence, lanes FROM verdict")
def v07(src):
    return op.score_cases(src.d_evidence).select("case_id", "confidence", _FLAT("lanes_unavailable", ", ").alias("lanes"))


@query("v08_contributions", _V + """SELECT case_id, rank, signal, analyzer, weight, confidence,
    floor(points * 100 + 0.5) / 100 AS points, label, rationale, detail FROM keep""")
def v08(src):
    return op.contributions(op.score_cases(src.d_evidence)).drop("pos")


@query("v09_suppression_lists", _V + """SELECT s.name AS signal, count(*) AS n_cases FROM
    (SELECT unnest(string_split(withheld, ',')) AS name FROM verdict WHERE withheld <> '') s GROUP BY s.name""")
def v09(src):
    return (op.score_cases(src.d_evidence).select(F.explode("suppressed_negatives").alias("signal"))
            .groupBy("signal").agg(F.count("*").alias("n_cases")))


_SUMMARY = f"""CASE WHEN n_kept = 0 AND n_lanes > 0 THEN {o.lit(fx.SUMMARY_BLIND)} WHEN n_kept = 0 THEN {o.lit(fx.SUMMARY_NOTHING)}
  WHEN top IS NULL THEN {o.lit(fx.SUMMARY_CREDIT_ONLY)}
  ELSE 'Assessed ' || lower(replace(band, '_', ' ')) || ', driven by: ' || top || '.' ||
    CASE WHEN n_lanes > 0 THEN ' Confidence reduced: ' || n_lanes || ' analyzer lane(s) unavailable (' || lanes || ').' ELSE '' END ||
    CASE WHEN withheld <> '' THEN {o.lit(fx.SUMMARY_WITHHELD)} ELSE '' END END"""


@query("v10_summary", _V + f"SELECT case_id, {_SUMMARY} AS summary FROM verdict")
def v10(src):
    return op.score_cases(src.d_evidence).select("case_id", "summary")


@query("v11_all_cases", _VALL + f"SELECT case_id, score, band, {_SUMMARY} AS summary FROM verdict")
def v11(src):
    return op.score_cases(src.d_evidence, src.d_cases).select("case_id", "score", "band", "summary")


_OUTCOMES = """ev AS (SELECT case_id, pos, analyzer, signal, status, confidence, detail FROM d_evidence
  UNION ALL SELECT case_id, 10000, lane, CASE state WHEN 'timeout' THEN 'lane_timeout' ELSE 'lane_error' END,
    CASE state WHEN 'timeout' THEN 'UNAVAILABLE' ELSE 'ERROR' END, 0.0, NULL FROM d_lane_runs WHERE state <> 'ok')"""


@query("v12_lane_outcomes", f"WITH {_OUTCOMES}, {o.verdict_ctes(evidence='ev')} SELECT case_id, score, CAST(confidence AS DOUBLE) AS confidence, lanes FROM verdict")
def v12(src):
    ev = op.with_lane_outcomes(src.d_evidence, src.d_lane_runs)
    return op.score_cases(ev).select("case_id", "score", "confidence", _FLAT("lanes_unavailable", ", ").alias("lanes"))


@query("v13_rescore_diff", f"""WITH {o.verdict_ctes(dims.EARLIER, 'a_')}, {o.verdict_ctes(dims.LATEST, 'b_')}
    SELECT a.case_id, a.score AS old_score, a.band AS old_band, b.score AS new_score, b.band AS new_band,
      a.score <> b.score OR a.band <> b.band AS changed FROM a_verdict a JOIN b_verdict b ON a.case_id = b.case_id""")
def v13(src):
    return op.rescore_diff(src.d_evidence)


#: A third version from the orders: every rule of the newest one, weighted anew.
_DRAFT = f"SELECT signal, CAST(CASE weight % 3 WHEN 0 THEN weight - 5 WHEN 1 THEN weight + 7 ELSE weight END AS INT) AS weight, 'Draft: ' || label AS label, rationale FROM (SELECT * FROM {o.values_sql([(s, w, lab, rulebook.rationale_of()[s]) for v, s, w, _, lab in dims.rule_rows() if v == dims.LATEST], 't(signal, weight, label, rationale)')}) x"


def draft_book(src):
    """Both built-in versions and a user's table as one rule book."""
    lanes = dims.rules(src.spark, [dims.LATEST]).select("signal", F.col("rule_analyzer").alias("analyzer"))
    draft = src.spark.sql(_DRAFT).join(lanes, "signal").withColumn("version", F.lit("draft"))
    both = dims.suppressors(src.spark).filter(F.col("version") == dims.LATEST).select("signal", F.col("scope").alias("role"))
    roles = both.unionByName(dims.identity_credits(src.spark).select("signal", F.lit("credit").alias("role"))).select(F.lit("draft").alias("version"), "signal", "role")
    own = rulebook.from_tables(draft, roles, {"draft": dims.LATEST})
    old = rulebook.built_in(src.spark, dims.VERSIONS)
    return rulebook.RuleBook(old.flags.unionByName(own.flags.select(old.flags.columns)), old.profiles | own.profiles)


@query("v13_three_versions", f"""WITH {o.verdict_ctes(dims.EARLIER, 'a_')}, {o.verdict_ctes(dims.LATEST, 'b_')}, {o.verdict_ctes(dims.LATEST, 'c_', rules=_DRAFT)}
    SELECT case_id, '{dims.EARLIER}' AS scorer_version, score, band FROM a_verdict UNION ALL SELECT case_id, '{dims.LATEST}', score, band FROM b_verdict
    UNION ALL SELECT case_id, 'draft', score, band FROM c_verdict""")
def v13_three(src):
    return op.score_versions(src.d_evidence, draft_book(src)).select("case_id", "scorer_version", "score", "band")


@query("v14_legacy_score", """WITH x AS (SELECT o_orderkey AS case_id, o_custkey % 4 AS a, o_custkey % 3 AS b, o_custkey % 5 AS c,
      CAST(o_orderkey % 3 AS INT) AS mm, CAST(o_orderkey % 11 AS INT) AS u, CAST(o_custkey % 11 AS INT) AS i, CAST(o_orderkey % 2 AS INT) AS l, CAST(o_custkey % 4 AS INT) AS d FROM orders),
    s AS (SELECT case_id, least(100, CASE WHEN a = 1 THEN 20 ELSE 0 END + CASE WHEN b = 1 THEN 20 ELSE 0 END + CASE WHEN c = 2 THEN 15 ELSE 0 END
      + CASE WHEN mm > 0 THEN 15 ELSE 0 END + u * 2 + i * 2 + CASE WHEN l > 0 THEN 10 ELSE 0 END) + 15 * d AS fraud_score FROM x)
    SELECT case_id, CAST(fraud_score AS INT) AS fraud_score, CASE WHEN fraud_score >= 60 THEN 'High-Risk' WHEN fraud_score >= 30 THEN 'Suspicious' ELSE 'Safe' END AS verdict FROM s""")
def v14(src):
    word = lambda cond, bad: F.when(cond, bad).otherwise("pass")
    x = src.orders.select(
        F.col("o_orderkey").alias("case_id"), word(F.col("o_custkey") % 4 == 1, "fail").alias("spf"),
        word(F.col("o_custkey") % 3 == 1, "fail").alias("dkim"),
        F.when(F.col("o_custkey") % 5 == 2, "fail").otherwise("not found").alias("dmarc"),
        (F.col("o_orderkey") % 3).alias("mismatch_flags"), (F.col("o_orderkey") % 11).alias("urgency"),
        (F.col("o_custkey") % 11).alias("impersonation"), (F.col("o_orderkey") % 2).alias("link_flags"),
        (F.col("o_custkey") % 4).alias("domain_flags"))
    return op.legacy_fraud_score(x).select("case_id", "fraud_score", "verdict")
