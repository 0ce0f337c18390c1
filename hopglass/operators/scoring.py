"""Evidence rows -> explainable verdicts.

The work is one broadcast join to the rule table, one aggregation by
(case, signal) that keeps only the strongest instance, and one aggregation by
case.  Both aggregations combine on the map side, so a case or a signal that
owns a large share of the evidence costs no more than any other: after the first
step a case holds at most one row per signal of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from . import dims
from .rulebook import RuleBook, built_in, by_profile, role_of, weight_of

def rule_points(evidence: DataFrame, version: str = dims.LATEST) -> DataFrame:
    """TRIGGERED evidence with its rule; points = weight x confidence."""
    rules = dims.rules(evidence.sparkSession, [version])
    return (evidence.filter(F.col("status") == "TRIGGERED")
            .join(rules.drop("version", "rule_analyzer"), "signal")
            .withColumn("points", F.col("weight") * F.col("confidence")))


def unknown_signals(evidence: DataFrame, version: str = dims.LATEST) -> DataFrame:
    """Signals that fired but have no rule, with their counts."""
    rules = dims.rules(evidence.sparkSession, [version])
    return (evidence.filter(F.col("status") == "TRIGGERED")
            .join(rules.select("signal"), "signal", "left_anti")
            .groupBy("signal").agg(F.count("*").alias("n")))


def signals_of_cases(evidence: DataFrame) -> DataFrame:
    """One row per (case, signal), whatever the rules: whether it fired, place and confidence of its most confident instance (the
    earliest on ties) and of its earliest one, the lane and detail of each, and the lanes that were unavailable.

    Points are weight x confidence, so under any weight but 0 the instance of most absolute points is the most confident one;
    under weight 0 all are equal and the earliest counts.  Columns apart, so that a caller who only scores moves no texts."""
    fired, text = F.col("status") == "TRIGGERED", F.struct("analyzer", "detail")
    most = F.when(fired, F.struct("confidence", (-F.col("pos")).alias("back")))
    first = F.when(fired & F.col("pos").isNotNull(), F.struct("pos", "confidence"))
    return evidence.groupBy("case_id", "signal").agg(
        F.max(fired).alias("fired"), F.max(most).alias("most"), F.max_by(text, most).alias("most_text"), F.min(first).alias("first"), F.min_by(text, first).alias("first_text"),
        F.collect_set(F.when(F.col("status") == "UNAVAILABLE", F.col("analyzer"))).alias("lanes"))


def strongest_instances(evidence: DataFrame, version: str = dims.LATEST, book: RuleBook | None = None) -> DataFrame:
    """One row per (version, case, signal): the instance with the largest absolute points, the earliest on ties, and the
    lanes that were unavailable.  Rules are attached after the aggregation, so they are not shuffled."""
    book = book or built_in(evidence.sparkSession, [version])
    rules = F.broadcast(book.flags)  # size checked by the book
    each = signals_of_cases(evidence).withColumn("version", F.explode(F.array(*[F.lit(v) for v in book.versions])))
    each = each.join(rules, ["version", "signal"], "left")
    instance = lambda at, pos, text: F.when(F.col(at).isNotNull(), F.struct(pos.alias("pos"), F.col(text)["analyzer"].alias("analyzer"), F.col(at)["confidence"].alias("confidence"), F.col(text)["detail"].alias("detail")))
    pick = F.when(F.col("weight") == 0, instance("first", F.col("first")["pos"], "first_text")).otherwise(instance("most", -F.col("most")["back"], "most_text"))
    each = each.withColumn("_best", F.when(F.col("fired") & F.col("weight").isNotNull(), pick)).drop("most", "first", "most_text", "first_text")
    b = F.col("_best")
    best = F.struct(b["pos"].alias("pos"), b["analyzer"].alias("analyzer"), F.col("weight"), b["confidence"].alias("confidence"),
                    (F.col("weight") * b["confidence"]).alias("points"), b["detail"].alias("detail"))
    return each.withColumn("best", F.when(b.isNotNull(), best)).drop("_best")


def _round_display(points: Column, version: str) -> Column:
    return (F.bround(points, 2) if version == dims.EARLIER else F.floor(points * 100 + F.lit(0.5)) / 100).cast("double")


def band_of(score: Column, version: str = dims.LATEST) -> Column:
    """Band of a score under a rule version."""
    out = None
    for band, lo, _ in reversed(fx.BANDS[version]):
        out = F.when(score >= lo, band) if out is None else out.when(score >= lo, band)
    return out


def summary_text(band: Column, contributions: Column, lanes: Column, suppressed: Column) -> Column:
    """One-sentence explanation."""
    top = F.slice(F.transform(F.filter(contributions, lambda c: c["points"] > 0), lambda c: c["label"]), 1, 3)
    blind = F.when(F.size(lanes) > 0, F.concat(
        F.lit(" Confidence reduced: "), F.size(lanes).cast("string"),
        F.lit(" analyzer lane(s) unavailable ("), F.array_join(lanes, ", "), F.lit(")."))).otherwise("")
    withheld = F.when(F.size(suppressed) > 0, fx.SUMMARY_WITHHELD).otherwise("")
    lead = F.concat(F.lit("Assessed "), F.lower(F.regexp_replace(band, "_", " ")), F.lit(", driven by: "),
                    F.array_join(top, "; "), F.lit("."), blind, withheld)
    return (F.when((F.size(contributions) == 0) & (F.size(lanes) > 0), fx.SUMMARY_BLIND)
            .when(F.size(contributions) == 0, fx.SUMMARY_NOTHING)
            .when(F.size(top) == 0, fx.SUMMARY_CREDIT_ONLY).otherwise(lead))


def score_cases(evidence: DataFrame, cases: DataFrame | None = None, version: str = dims.LATEST) -> DataFrame:
    """One verdict row per case under one version.  Cases without evidence score 0 when
    the ``cases`` table is given."""
    return score_versions(evidence, built_in(evidence.sparkSession, [version]), cases)


def _signals_by_case(evidence: DataFrame, book: RuleBook) -> DataFrame:
    """One row per case: ``signals`` that fired with what their rules count under every version of the book, ``labels`` and ``texts`` of
    them in the same order, and the unavailable lanes.  Lists apart, so that what a caller does not show is not read.

    Rows meet by case once for all versions, at most one per signal; rules are attached where they have met, so neither rules
    nor their texts are shuffled, however many versions there are."""
    each = signals_of_cases(evidence).repartition("case_id").join(F.broadcast(book.by_signal()), "signal", "left")  # size checked by the book
    zero, fired = F.exists("rules", lambda r: weight_of(r) == 0), F.col("fired")
    each = each.withColumns({c: F.when(fired & zero, F.col(c)) for c in ("first", "first_text")} | {c: F.when(fired, F.col(c)) for c in ("rules", "labels", "rationales")})
    every = lambda *columns: F.sort_array(F.collect_list(F.when(fired, F.struct("signal", *columns))))  # a case has a signal once
    return each.groupBy("case_id").agg(every("most", "first", "rules").alias("signals"), every("labels").alias("labels"), every("most_text", "first_text", "rationales").alias("texts"),
                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list("lanes")))).alias("lanes_unavailable"))


def score_versions(evidence: DataFrame, book: RuleBook, cases: DataFrame | None = None) -> DataFrame:
    """One verdict row per (case, version) of the rule book; the evidence is read and aggregated once."""
    per_case = _signals_by_case(evidence, book)
    if cases is not None:
        kinds = {f.name: f.dataType for f in per_case.schema.fields if f.name != "case_id"}
        per_case = cases.select("case_id").join(per_case, "case_id", "left").withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in kinds.items()})
    per_case = per_case.select("*", F.posexplode(F.array(*[F.lit(x) for x in book.versions])).alias("_v", "version"))
    v, k = F.col("version"), F.col("_v")
    rated = F.transform("signals", lambda s, i: F.struct(i.alias("i"), s["signal"].alias("signal"), s["most"].alias("most"), s["first"].alias("first"), F.get(s["rules"], k).alias("rule")))

    def entry(s: Column) -> Column:
        weight = weight_of(s["rule"])
        zero = weight == 0
        confidence = F.when(zero, s["first"]["confidence"]).otherwise(s["most"]["confidence"])
        return F.struct(F.when(zero, s["first"]["pos"]).otherwise(-s["most"]["back"]).alias("pos"), s["signal"].alias("signal"), F.when(~zero | s["first"].isNotNull(), weight).alias("weight"),
                        confidence.alias("confidence"), (weight * confidence).alias("points"), role_of(s["rule"], "is_credit").alias("is_credit"), s["i"].alias("i"))

    label = lambda c: F.get(F.get("labels", c["i"])["labels"], k).alias("label")

    def shown(c: Column) -> Column:
        text = F.get("texts", c["i"])
        said = lambda name: F.when(c["weight"] == 0, text["first_text"][name]).when(c["weight"] != 0, text["most_text"][name]).alias(name)
        return F.struct(c["pos"].alias("pos"), c["signal"].alias("signal"), said("analyzer"), c["weight"].alias("weight"), c["confidence"].alias("confidence"), c["points"].alias("points"),
                        label(c), F.get(text["rationales"], k).alias("rationale"), said("detail"))

    names = lambda c: F.sort_array(F.filter(F.transform(c, lambda s: s["signal"]), lambda x: x.isNotNull()))
    general = F.size("suppressed_by") > 0
    blocked = lambda c: (c["weight"] < 0) & F.when(c["is_credit"], F.col("identity_blocked")).otherwise(general)
    total = F.aggregate("kept", F.lit(0.0), lambda acc, c: acc + c["points"])
    penalty = F.lit(100) - fx.UNAVAILABLE_PENALTY_PERCENT * F.size("lanes_unavailable")
    rounded = F.transform("kept", lambda c: c.withField("points", by_profile(book, v, lambda p: _round_display(c["points"], p))))
    # cast the order key first: sorting a struct is by field order
    ranked = F.transform(F.array_sort(F.transform(rounded, lambda c: F.struct((-F.abs(c["points"])).alias("k"), c["pos"].alias("p"), c.alias("c")))), lambda s: s["c"])
    return (per_case
            .withColumn("rated", rated)
            .withColumns({"found": F.sort_array(F.transform(F.filter("rated", lambda s: s["rule"].isNotNull()), entry)),
                          "unknown_signals": names(F.filter("rated", lambda s: s["rule"].isNull())),
                          "suppressed_by": names(F.filter("rated", lambda s: role_of(s["rule"], "general"))),
                          "identity_blocked": F.coalesce(F.exists("rated", lambda s: role_of(s["rule"], "identity")), F.lit(False))})
            .withColumn("kept", F.filter("found", lambda c: ~blocked(c)))
            .withColumn("suppressed_negatives", F.transform(F.filter("found", blocked), lambda c: c["signal"]))
            .withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total).cast("int"))))
            .withColumn("band", by_profile(book, v, lambda p: band_of(F.col("score"), p)))
            .withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), penalty)) / 100)
            .withColumn("ranked", ranked)
            .withColumn("contributions", F.transform("ranked", shown))
            .withColumn("summary", summary_text(F.col("band"), F.transform("ranked", lambda c: F.struct(c["points"], label(c))),
                                                F.col("lanes_unavailable"), F.col("suppressed_negatives")))
            .select("case_id", "score", "band", "confidence", v.alias("scorer_version"), "contributions",
                    "lanes_unavailable", "suppressed_negatives", "suppressed_by", "unknown_signals", "summary"))


def contributions(verdicts: DataFrame) -> DataFrame:
    """Flat contribution table, ranked within its case."""
    return verdicts.select("case_id", F.posexplode("contributions").alias("i", "c")).select(
        "case_id", (F.col("i") + 1).alias("rank"), "c.*")


def with_lane_outcomes(evidence: DataFrame, lane_runs: DataFrame) -> DataFrame:
    """Timed-out and crashed lanes as evidence rows."""
    outcome = (lane_runs.filter(F.col("state").isin("timeout", "crash"))
               .select("case_id", F.lit(10_000).alias("pos"), F.col("lane").alias("analyzer"),
                       F.when(F.col("state") == "timeout", "lane_timeout").otherwise("lane_error").alias("signal"),
                       F.when(F.col("state") == "timeout", "UNAVAILABLE").otherwise("ERROR").alias("status"),
                       F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("detail")))
    return evidence.select("case_id", "pos", "analyzer", "signal", "status", "confidence", "detail").unionByName(outcome)


def rescore_diff(evidence: DataFrame, old: str = dims.EARLIER, new: str = dims.LATEST, book: RuleBook | None = None) -> DataFrame:
    """Verdict of every case under two rule versions, side by side, from one pass over the evidence."""
    book = book or built_in(evidence.sparkSession, [old, new])
    at = lambda v, c: F.max(F.when(F.col("scorer_version") == v, F.col(c)))
    rows = score_versions(evidence, book).groupBy("case_id").agg(at(old, "score").alias("old_score"), at(old, "band").alias("old_band"),
                                                                 at(new, "score").alias("new_score"), at(new, "band").alias("new_band"))
    return rows.withColumn("changed", ~(F.col("old_score").eqNullSafe(F.col("new_score")) & F.col("old_band").eqNullSafe(F.col("new_band"))))


def legacy_fraud_score(df: DataFrame) -> DataFrame:
    """First-generation score.  Domain flags are added after the cap, so the
    result can pass 100."""
    failed = lambda c: ~F.col(c).isin("pass", "not found")
    base = (F.when(failed("spf"), 20).otherwise(0) + F.when(failed("dkim"), 20).otherwise(0)
            + F.when(failed("dmarc"), 15).otherwise(0) + F.when(F.col("mismatch_flags") > 0, 15).otherwise(0)
            + F.col("urgency") * 2 + F.col("impersonation") * 2 + F.when(F.col("link_flags") > 0, 10).otherwise(0))
    score = F.least(base, F.lit(100)) + 15 * F.col("domain_flags")
    return (df.withColumn("fraud_score", score.cast("int"))
            .withColumn("verdict", F.when(F.col("fraud_score") >= 60, "High-Risk")
                        .when(F.col("fraud_score") >= 30, "Suspicious").otherwise("Safe")))
