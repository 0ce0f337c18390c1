from hopglass.operators import dims, rulebook, scoring

COLS = "case_id long, pos int, analyzer string, signal string, status string, confidence double, detail string"


def verdict(spark, *rows, version=dims.LATEST):
    ev = spark.createDataFrame([(1, i, lane, sig, status, conf, None) for i, (lane, sig, status, conf) in enumerate(rows)], COLS)
    return scoring.score_cases(ev, version=version).first()


def test_points_add_up_and_cap(spark):
    v = verdict(spark, ("M2", "forged_received_hop", "TRIGGERED", 1.0), ("M3", "dmarc_fail_strict", "TRIGGERED", 1.0),
                ("M6", "brand_lookalike_domain", "TRIGGERED", 1.0), ("M7", "campaign_infrastructure_reuse", "TRIGGERED", 1.0))
    assert v.score == 100 and v.band == "CRITICAL"


def test_clear_and_error_never_score(spark):
    v = verdict(spark, ("M2", "forged_received_hop", "CLEAR", 1.0), ("M3", "spf_fail_hard", "ERROR", 1.0))
    assert v.score == 0 and v.confidence == 1.0 and v.summary.startswith("No fraud indicators detected across")


def test_unavailable_lowers_confidence_only(spark):
    v = verdict(spark, ("M3", "spf_unavailable", "UNAVAILABLE", 0.0), ("M3", "dkim_unavailable", "UNAVAILABLE", 0.0), ("M5", "origin_anonymized", "UNAVAILABLE", 0.0))
    assert v.score == 0 and v.confidence == 0.7 and v.lanes_unavailable == ["M3", "M5"]


def test_duplicates_count_once_strongest_wins(spark):
    v = verdict(spark, ("M5", "origin_anonymized", "TRIGGERED", 0.5), ("M5", "origin_anonymized", "TRIGGERED", 1.0), ("M5", "origin_anonymized", "TRIGGERED", 1.0))
    assert v.score == 12 and len(v.contributions) == 1 and v.contributions[0].pos == 1


def test_credit_cannot_mask_forgery(spark):
    v = verdict(spark, ("M3", "dkim_valid_aligned", "TRIGGERED", 1.0), ("M2", "forged_received_hop", "TRIGGERED", 0.1))
    assert v.score == 3 and v.suppressed_negatives == ["dkim_valid_aligned"] and v.suppressed_by == ["forged_received_hop"]


def test_identity_credit_survives_content_flags_not_spoofing(spark):
    kept = verdict(spark, ("M8", "established_sender_identity", "TRIGGERED", 1.0), ("M4", "credential_harvest_intent", "TRIGGERED", 1.0))
    assert kept.score == 0 and kept.suppressed_negatives == []
    lost = verdict(spark, ("M8", "established_sender_identity", "TRIGGERED", 1.0), ("M3", "spf_fail_hard", "TRIGGERED", 1.0))
    assert lost.score == 14 and lost.suppressed_negatives == ["established_sender_identity"]


def test_half_points_round_to_even_and_bands_differ_by_version(spark):
    assert verdict(spark, ("M6", "domain_no_mx", "TRIGGERED", 0.5)).score == 4
    ev = [("M4", "payment_diversion_intent", "TRIGGERED", 1.0), ("M4", "dkim_missing", "TRIGGERED", 1.0)]
    assert verdict(spark, *ev).band == "BENIGN"
    assert verdict(spark, *ev, version=dims.EARLIER).band == "SUSPICIOUS"


def test_rule_table_is_sound(spark):
    assert dims.rule_problems(dims.rules(spark), dims.suppressors(spark)).count() == 0
    assert dims.rules(spark).groupBy("version").count().collect() and dims.rules(spark, [dims.LATEST]).count() == 39
    assert dims.rules(spark, [dims.EARLIER]).count() == 30


def test_unknown_signals_are_reported(spark):
    v = verdict(spark, ("M4", "never_heard_of", "TRIGGERED", 1.0))
    assert v.score == 0 and v.unknown_signals == ["never_heard_of"]


def test_versions_add_no_shuffle(spark):
    signals = ["forged_received_hop", "dkim_valid_aligned", "sender_no_footprint", "made_up", "domain_no_mx", None]
    rows = [(c, p, f"M{2 + p % 7}", signals[(c + p) % 6], ["TRIGGERED", "TRIGGERED", "CLEAR", "UNAVAILABLE", None][(c * p) % 5], (c * p % 16 + 1) / 16, f"{c}/{p}") for c in range(40) for p in range(9)]
    ev = spark.createDataFrame(rows, COLS)
    book = rulebook.built_in(spark, dims.VERSIONS)
    plan = scoring.score_versions(ev, book).select("case_id", "scorer_version", "score")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(case_id" in line]
    assert len(moved) == 2 and not any("version" in line for line in moved)  # by case and signal, then by case
    both = scoring.score_versions(ev, book).collect()
    alone = [r for v in dims.VERSIONS for r in scoring.score_cases(ev, version=v).collect()]
    by = lambda found: sorted(map(str, found))
    assert len(both) == 80 and by(both) == by(alone)


def test_contributions_show_the_instance_that_counts(spark):
    flags = [("a", "x", 0, "la", "why a", False, False, False), ("a", "y", -5, "lya", "yes", False, False, False), ("b", "x", 7, "lb", "why b", False, False, False)]
    book = rulebook.RuleBook(spark.createDataFrame(flags, rulebook._FLAGS), {"a": dims.LATEST, "b": dims.EARLIER})
    ev = spark.createDataFrame([(1, 3, "M4", "x", "TRIGGERED", 0.5, "late"), (1, 1, "M2", "x", "TRIGGERED", 0.25, "early"), (1, 2, "M3", "x", "TRIGGERED", 0.5, "most"),
                                (1, 0, "M5", "x", "CLEAR", 1.0, "clear"), (1, 4, "M6", "y", "TRIGGERED", 1.0, "credit"), (1, 5, "M7", "z", "TRIGGERED", 1.0, "no rule")], COLS)
    got = {r.scorer_version: r for r in scoring.score_versions(ev, book).collect()}
    flat = lambda r: [(c.pos, c.signal, c.analyzer, c.weight, c.confidence, c.points, c.label, c.rationale, c.detail) for c in r.contributions]
    assert flat(got["a"]) == [(4, "y", "M6", -5, 1.0, -5.0, "lya", "yes", "credit"), (1, "x", "M2", 0, 0.25, 0.0, "la", "why a", "early")]
    assert flat(got["b"]) == [(2, "x", "M3", 7, 0.5, 3.5, "lb", "why b", "most")]
    assert got["a"].unknown_signals == ["z"] and got["b"].unknown_signals == ["y", "z"]
