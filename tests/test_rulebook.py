"""Rule tables of a user, several versions in one pass."""

import pytest
from pyspark.sql import functions as F

from hopglass.operators import dims, rulebook, scoring

COLS = "case_id long, pos int, analyzer string, signal string, status string, confidence double, detail string"
RULES = "version string, signal string, weight string, analyzer string, label string, rationale string"


def test_every_built_in_rule_has_its_reason():
    why = rulebook.rationale_of()
    assert {r[1] for r in dims.rule_rows()} == set(why) and all(why.values())


def test_faults_become_rows(spark):
    rows = [("a", "fine", " 7 ", "M2", "L", "R"), (None, "s", "1", "M2", "L", "R"), ("a", " ", "1", "M2", "L", "R"), ("a", "w", "1.5", "M2", "L", "R"), ("a", "x", "1000", "M2", "L", "R"),
            ("a", "y", "1", "M1", "L", "R"), ("a", "z", "1", "M2", None, ""), ("a", "twice", "1", "M2", "L", "R"), ("a", "twice", "2", "M2", "L", "R"), ("b", "twice", "2", "M2", "L", "R")]
    good, bad = rulebook.check_rules(spark.createDataFrame(rows, RULES))
    assert sorted((r.version, r.signal, r.weight) for r in good.collect()) == [("a", "fine", 7), ("b", "twice", 2)]
    assert sorted((r.version or "", r.signal or "", r.problem) for r in bad.collect()) == sorted([
        ("", "s", "missing version"), ("a", "", "missing signal"), ("a", "w", "weight is not a whole number of -100 to 100"), ("a", "x", "weight is not a whole number of -100 to 100"),
        ("a", "y", "unknown analyzer"), ("a", "z", "missing label"), ("a", "z", "missing rationale"), ("a", "twice", "rule given more than once"), ("a", "twice", "rule given more than once")])
    known = spark.createDataFrame([("fine",)], "signal string")
    assert {r.signal for r in rulebook.check_rules(spark.createDataFrame(rows[:1] + rows[-1:], RULES), known)[1].collect()} == {"twice"}


def test_a_table_without_a_column_has_faults_only(spark):
    good, bad = rulebook.check_rules(spark.createDataFrame([("a", "s", "1", "M2", "L")], RULES.rsplit(",", 1)[0]))
    assert good.count() == 0 and [r.problem for r in bad.collect()] == ["missing rationale"]


def test_versions_of_a_user_beside_the_built_in_ones(spark):
    rules = spark.createDataFrame([("mine", "forged_received_hop", "0", "M2", "F", "R"), ("mine", "house_rule", "60", "M4", "H", "R"), ("mine", "dkim_valid_aligned", "-30", "M3", "D", "R")], RULES)
    roles = spark.createDataFrame([("mine", "house_rule", "general"), ("mine", "dkim_valid_aligned", "general"), ("mine", "no_rule", "identity"), ("mine", "house_rule", "odd")], "version string, signal string, role string")
    assert sorted((r.signal, r.problem) for r in rulebook.role_problems(rules, roles).collect()) == [
        ("dkim_valid_aligned", "suppressor is not a positive signal"), ("house_rule", "unknown role"), ("no_rule", "identity is not a rule")]
    own = rulebook.from_tables(rules, roles, {"mine": dims.LATEST})
    old = rulebook.built_in(spark, dims.VERSIONS)
    book = rulebook.RuleBook(old.flags.unionByName(own.flags.select(old.flags.columns)), old.profiles | own.profiles)
    ev = spark.createDataFrame([(1, 0, "M2", "forged_received_hop", "TRIGGERED", 0.2, None), (1, 1, "M2", "forged_received_hop", "TRIGGERED", 1.0, None), (1, 2, "M4", "house_rule", "TRIGGERED", 0.5, None),
                                (1, 3, "M3", "dkim_valid_aligned", "TRIGGERED", 1.0, None), (2, 0, "M3", "dkim_valid_aligned", "CLEAR", 1.0, None)], COLS)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    got = {(r.case_id, r.scorer_version): r for r in scoring.score_versions(ev, book, cases).collect()}
    assert len(got) == 9 and {k: v.score for k, v in got.items() if k[0] == 1} == {(1, "1.10.0"): 30, (1, "1.3.0"): 30, (1, "mine"): 30}
    mine = got[1, "mine"]
    assert mine.suppressed_negatives == ["dkim_valid_aligned"] and mine.suppressed_by == ["house_rule"]
    # of a rule of weight 0 the earliest instance counts, of any other the strongest
    assert {c.signal: c.pos for c in mine.contributions} == {"forged_received_hop": 0, "house_rule": 2}
    assert {c.signal: c.pos for c in got[1, "1.10.0"].contributions} == {"forged_received_hop": 1} and got[1, "1.10.0"].unknown_signals == ["house_rule"]
    assert got[1, "1.10.0"].contributions[0].rationale == rulebook.rationale_of()["forged_received_hop"]
    assert got[3, "mine"].score == 0 and got[2, "1.3.0"].band == "BENIGN"


def test_a_rule_table_that_is_too_large_is_refused(spark):
    rules = spark.range(30).select(F.lit("v").alias("version"), F.concat(F.lit("s"), "id").alias("signal"), F.lit("1").alias("weight"), F.lit("M2").alias("analyzer"), F.lit("l").alias("label"), F.lit("r").alias("rationale"))
    with pytest.raises(ValueError):
        rulebook.from_tables(rules, spark.createDataFrame([], "version string, signal string, role string"), {"v": dims.LATEST}, most=20)
