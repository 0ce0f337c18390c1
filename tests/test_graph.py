"""Pair counting, components and depth-limited clusters against brute force."""

import itertools
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from hopglass.functions import fixed_values as fx
from hopglass.functions.net import with_routability
from hopglass.operators import graph
from hopglass.operators.skew import join_on_hot_key as join
from hopglass.operators.skew import global_positions, rank_within

SCHEMA = "owner string, case_id long, arrival timestamp, kind string, value string"


def make(seed, n_cases=60, hubs=2):
    rnd = random.Random(seed)
    rows = set()
    start = datetime(2024, 1, 1)
    for c in range(n_cases):
        at = start + timedelta(hours=rnd.randrange(200))
        for _ in range(rnd.randrange(1, 4)):
            rows.add(("o1", c, at, rnd.choice(["ip", "url", "urlreg", "hash"]), f"v{rnd.randrange(90)}"))
        for h in range(hubs):
            if rnd.random() < 0.3:
                rows.add(("o1", c, at, "url", f"hub{h}"))
    return sorted(rows)


def sets_of(rows):
    ind, arr = defaultdict(set), {}
    for _, c, at, k, v in rows:
        ind[c].add((k, v))
        arr[c] = at
    return ind, arr


def weight(shared):
    return min(1.0, sum(fx.INDICATOR_WEIGHTS[k] for k, _ in shared) / 2)


@pytest.mark.parametrize("hub_degree", [2, 5, 1000])
def test_pairs_are_exact_for_any_hub_degree(spark, hub_degree):
    rows = make(1)
    ind, arr = sets_of(rows)
    linked = graph.split_hubs(spark.createDataFrame(rows, SCHEMA), hub_degree)
    want = defaultdict(int)
    for a, b in itertools.combinations(sorted(ind), 2):
        shared = ind[a] & ind[b]
        if shared:
            want[tuple(sorted(shared))] += 1
    got = defaultdict(int)
    for r in graph.pair_strengths(linked).collect():
        got[tuple(sorted((s.kind, s.value) for s in r.shared))] += 1
    for r in graph.hub_pair_classes(linked).collect():
        got[tuple(sorted((s.kind, s.value) for s in r.shared))] += r.n_pairs
    assert dict(got) == dict(want)


@pytest.mark.parametrize("hub_degree", [3, 1000])
def test_related_prior_cases(spark, hub_degree):
    rows = make(2)
    ind, arr = sets_of(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: (r.related_cases, r.shared_indicator_count) for r in graph.related_prior(graph.split_hubs(df, hub_degree), df).collect()}
    for c in ind:
        prior = [len(ind[c] & ind[o]) for o in ind if (arr[o], o) < (arr[c], c) and ind[c] & ind[o]]
        assert got[c] == (len(prior), max(prior, default=0))


def neighbours(ind):
    adj = defaultdict(set)
    for a, b in itertools.combinations(sorted(ind), 2):
        if ind[a] & ind[b]:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def test_components_and_a_long_chain(spark):
    chain = [("o1", c, datetime(2024, 1, 1), "ip", f"c{c + d}") for c in range(100, 140) for d in (0, 1)]
    rows = make(3, hubs=0) + chain
    ind, _ = sets_of(rows)
    adj = neighbours(ind)
    want, seen = {}, set()
    for s in sorted(adj):
        if s in seen:
            continue
        comp, queue = {s}, deque([s])
        while queue:
            for n in adj[queue.popleft()] - comp:
                comp.add(n)
                queue.append(n)
        seen |= comp
        want.update({c: min(comp) for c in comp})
    # a threshold of one row makes every key hot, so the salted path is exercised too
    got = {r.case_id: r.component for r in graph.components(spark.createDataFrame(rows, SCHEMA), hot_rows=1).collect()}
    assert got == want


def test_depth_limited_clusters(spark):
    chain = [("o1", c, datetime(2024, 1, 1), "ip", f"c{c + d}") for c in range(100, 112) for d in (0, 1)]
    rows = make(4, n_cases=30, hubs=0) + chain
    ind, _ = sets_of(rows)
    adj = neighbours(ind)
    want, visited = {}, set()
    for s in sorted(ind):
        if s in visited:
            continue
        members, queue = set(), deque([(s, 0)])
        while queue:
            c, d = queue.popleft()
            if c in visited or d > 3:
                continue
            visited.add(c)
            members.add(c)
            queue.extend((n, d + 1) for n in sorted(adj[c]) if n not in visited)
        if len(members) > 1:
            want.update({m: s for m in members})
    got = {r.case_id: r.cluster for r in graph.depth_limited_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_owners_never_join(spark):
    rows = [("a", 1, datetime(2024, 1, 1), "ip", "x"), ("b", 2, datetime(2024, 1, 2), "ip", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert graph.components(df).count() == 0
    assert graph.related_prior(graph.split_hubs(df), df).filter("related_cases > 0").count() == 0


def test_first_case_clean_second_flagged(spark):
    rows = [("a", 1, datetime(2024, 1, 1), "ip", "x"), ("a", 2, datetime(2024, 1, 2), "ip", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.case_id: r.status for r in graph.campaign_reuse(graph.related_prior(graph.split_hubs(df), df)).collect()}
    assert out == {1: "CLEAR", 2: "TRIGGERED"}


def test_positions_without_one_sorting_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("k").alias("k"))
    got = {r.v: r.position for r in global_positions(df, ["k", "v"]).collect()}
    assert got == {i: i for i in range(1000)}
    ranks = {r.v: r["rank"] for r in rank_within(df, ["k"], ["v"]).collect()}
    assert ranks == got


def test_many_hubs_per_case_stay_linear(spark):
    """Thirty popular indicators in each of 20,000 cases: two classes of cases, whatever their number."""
    kinds = F.expr("transform(sequence(0, 29), h -> named_struct('kind', 'url', 'value', concat('hub', cast(h + (id % 2) * 10 as string))))")
    df = (spark.range(20_000).select(F.lit("o").alias("owner"), F.col("id").alias("case_id"), F.timestamp_seconds("id").alias("arrival"), F.inline(kinds)))
    linked = graph.split_hubs(df, 1000)
    got = {r["case_id"]: (r["related_cases"], r["shared_indicator_count"]) for r in graph.related_prior(linked, df).filter("case_id in (0, 1, 2, 19999)").collect()}
    assert got == {0: (0, 0), 1: (1, 20), 2: (2, 30), 19_999: (19_999, 30)}
    classes = sorted((len(r["shared"]), r["n_pairs"]) for r in graph.hub_pair_classes(linked).collect())
    assert classes == [(20, 10_000 * 10_000), (30, 10_000 * 9_999 // 2), (30, 10_000 * 9_999 // 2)]


def test_stored_cases_count_as_earlier_for_late_ones(spark):
    from hopglass.streaming.feed import correlate_batch

    row = lambda case, day: ("o", case, datetime(2024, 1, day), "url", "bad.example.net")
    stored, late = spark.createDataFrame([row(1, 2)], SCHEMA), spark.createDataFrame([row(2, 1)], SCHEMA)
    assert [(r["case_id"], r["related_cases"]) for r in correlate_batch(late, stored).collect()] == [(2, 1)]


def test_many_clusters_of_one_component_start_together(spark, monkeypatch):
    """A path of 240 cases with ids at random: dozens of clusters in a few rounds."""
    import random

    ids = list(range(240))
    random.Random(2).shuffle(ids)
    rows = [("o1", c, datetime(2024, 1, 1), "ip", f"e{i + d}") for i, c in enumerate(ids) for d in (0, 1)]
    place = {c: i for i, c in enumerate(ids)}
    want, free = {}, set(ids)
    for s in sorted(ids):
        if s not in free:
            continue
        got = [s]
        for step in (-1, 1):
            for k in range(1, 4):
                i = place[s] + step * k
                if not 0 <= i < len(ids) or ids[i] not in free:
                    break
                got.append(ids[i])
        free -= set(got)
        if len(got) > 1:
            want.update({c: s for c in got})
    rounds = []
    monkeypatch.setattr(graph, "join_on_hot_key", lambda *a, **b: (rounds.append(1), join(*a, **b))[1])
    found = graph.depth_limited_clusters(spark.createDataFrame(rows, SCHEMA))
    assert {r.case_id: r.cluster for r in found.collect()} == want and len(set(want.values())) > 30
    assert len(rounds) <= 2 + 9 * 8  # joins of at most eight rounds, not of one round per cluster
    parts = graph.cluster_indicators(spark.createDataFrame(rows, SCHEMA), found)
    assert parts.filter("n_cases = 2").count() == sum(1 for a, b in zip(ids, ids[1:]) if a in want and want.get(b) == want[a])


@pytest.mark.parametrize("part_of, hot_rows", [(8, 10**6), (2, 3), (0, 2)])
def test_earlier_cases_of_small_wide_and_crowded_sets(spark, monkeypatch, part_of, hot_rows):
    monkeypatch.setattr(graph, "PART_OF", part_of)
    rows = make(5, n_cases=70, hubs=4)
    ind, arr = sets_of(rows)
    found = graph.earlier_by_sets(graph.split_hubs(spark.createDataFrame(rows, SCHEMA)), None, hot_rows)
    got = {r.case_id: (r.related or 0, r.best or 0) for r in found.collect()}
    for c in ind:
        prior = [len(ind[c] & ind[o]) for o in ind if (arr[o], o) < (arr[c], c) and ind[c] & ind[o]]
        assert got.get(c, (0, 0)) == (len(prior), max(prior, default=0))


def test_time_lines_grow_with_the_cases_not_with_the_sets_that_meet(spark, monkeypatch):
    """60 sets of 10 cases each that all meet at one hub: pairs of sets have 36,000 cases in all."""
    seen = []

    def counted(df, keys, order, out="rank"):
        seen.append(df.count())
        return rank_within(df, keys, order, out)

    monkeypatch.setattr(graph, "rank_within", counted)
    rows = [("o", 10 * s + k, datetime(2024, 1, 1), "url", v) for s in range(60) for k in range(10) for v in ("hub", f"own{s}")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: (r.related_cases, r.shared_indicator_count) for r in graph.related_prior(graph.split_hubs(df, 5), df).collect()}
    assert got == {c: (c, 0 if c == 0 else 2 if c % 10 else 1) for c in range(600)}
    assert sum(seen) <= 3 * 600


def test_indicators_parse_a_host_once_and_meet_their_case_by_one_exchange(spark):
    t = datetime(2024, 1, 1)
    cases = spark.createDataFrame([("o", 1, t), ("o", 2, t)], "owner string, case_id long, arrival timestamp")
    origins = spark.createDataFrame([(1, "8.8.8.8", True), (2, None, False)], "case_id long, origin_ip string, defensible boolean")
    urls = spark.createDataFrame([(1, "A.evil.co.in"), (1, "a.evil.co.in"), (2, "bit.ly"), (None, "x.org"), (2, None)], "case_id long, domain string")
    files = spark.createDataFrame([(2, "d1"), (2, "d1"), (2, None), (9, "d2")], "case_id long, sha256 string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.extract_indicators(cases, origins, urls, files)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.case_id, r.kind, r.value) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [(1, "ip", "8.8.8.8"), (1, "url", "a.evil.co.in"), (1, "urlreg", "evil.co.in"), (2, "hash", "d1")]
    assert plan.count("Exchange hashpartitioning") == 2  # indicators and cases
    assert not any("rlike" in line.lower() for line in plan.splitlines() if "Filter" in line)


def test_long_chains_of_expressions_stay_in_methods_that_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    hops = spark.createDataFrame([(1, "10.0.0.1"), (2, "8.8.8.8"), (3, "::ffff:10.0.0.1"), (4, "2a02::1"), (5, None)], "case_id long, from_ip string")
    found = with_routability(hops, "from_ip")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert {r.case_id: (r.unroutable, r.public) for r in found.collect()} == {1: (True, False), 2: (False, True), 3: (True, False), 4: (False, True), 5: (False, False)}
    queries()["g01_extract_indicators"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
