"""Indicators, correlation and campaigns.

The graph is the bipartite table case -- indicator.  Nothing here lists every
pair of cases that share a popular indicator:

* components run on the bipartite edges;
* pair measures list the pairs of *narrow* indicators (at most ``hub_degree``
  cases each) and count the pairs that share only *hub* indicators between classes
  of cases with the same set of hubs; a class is one row however many cases it has,
  and a case may have any number of hubs;
* earlier cases are counted on time lines of indicators and of their combinations.

The two parts of the pair measures together are exact for any ``hub_degree``; the parameter only moves
work from one part to the other and is never changed by the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import SuffixRules, domain_of, registrable
from ..functions.text import settled
from ..session import cut
from . import dims
from .skew import HOT_ROWS, hot_keys, join_on_hot_key, rank_within

HUB_DEGREE = 1000
#: A set with more indicators in common with others is compared with the sets that it meets, not taken apart.
PART_OF = 8
EDGE = ["owner", "kind", "value"]
CASE = ["owner", "case_id"]


# ---------------------------------------------------------------- extraction

def extract_indicators(cases: DataFrame, origins: DataFrame, urls: DataFrame, attachments: DataFrame,
                       version: str = dims.LATEST, hops: DataFrame | None = None, suffixes: SuffixRules | None = None) -> DataFrame:
    """Indicator rows of every case.

    ``origins`` carries (case_id, boundary_ip public or NULL, origin_ip).  Under the
    earlier rules a case without a defensible origin contributes every public hop
    (``hops`` with a ``public`` flag)."""
    ip = origins.filter(F.col("origin_ip").isNotNull()).select("case_id", F.lit("ip").alias("kind"), F.col("origin_ip").alias("value"))
    host = F.lower("domain")
    skip = fx.PUBLIC_PROVIDERS + fx.COMMON_LINK_HOSTS
    u = settled(urls.filter(F.col("domain").isNotNull()).select("case_id", "domain"), host=host, reg=registrable(F.col("domain"), suffixes, version == dims.LATEST)).drop("domain")
    if version == dims.LATEST:
        u = u.filter(F.col("reg").isNull() | ~F.col("reg").isin(skip))
        reg = F.col("reg")
    else:
        reg = F.when(~F.col("reg").isin(fx.PUBLIC_PROVIDERS), F.col("reg"))
        no_boundary = origins.filter(~F.col("defensible")).select("case_id")
        every = hops.filter(F.col("public")).join(no_boundary, "case_id", "left_semi").select("case_id", F.lit("ip").alias("kind"), F.col("from_ip").alias("value"))
        ip = ip.join(no_boundary, "case_id", "left_anti").unionByName(every)
    pairs = F.array(F.struct(F.lit("url").alias("kind"), F.col("host").alias("value")), F.struct(F.lit("urlreg").alias("kind"), reg.alias("value")))
    link = u.select("case_id", F.explode(pairs).alias("p")).select("case_id", "p.kind", "p.value").filter(F.col("value").isNotNull())
    digest = attachments.filter(F.coalesce(F.col("sha256"), F.lit("")) != "").select("case_id", F.lit("hash").alias("kind"), F.col("sha256").alias("value"))
    found = ip.unionByName(link).unionByName(digest).repartition("case_id").distinct()  # one exchange serves the join too
    return found.join(cases.select("owner", "case_id", "arrival"), "case_id").select("owner", "case_id", "arrival", "kind", "value")


def new_indicators(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that the store does not have, each once."""
    key = ["owner", "case_id", "kind", "value"]
    return batch.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


# ------------------------------------------------------------- pair measures

def weight_of(kind: Column) -> Column:
    w = F.lit(fx.OTHER_INDICATOR_WEIGHT)
    for k, v in fx.INDICATOR_WEIGHTS.items():
        w = F.when(kind == k, F.lit(v)).otherwise(w)
    return w


def strength_of(total_weight: Column) -> Column:
    return F.least(F.lit(1.0), total_weight / 2)


@dataclass
class Linked:
    """Shared part of an indicator table, split into narrow and hub indicators."""
    narrow: DataFrame     # owner, case_id, arrival, kind, value
    hubs: DataFrame       # owner, case_id, arrival, hubs array<struct<kind,value>>
    hub_degree: int
    shared: DataFrame     # both: owner, case_id, arrival, kind, value, number of the indicator
    pairs: DataFrame | None = None  # narrow pairs, where they are used more than once


def split_hubs(indicators: DataFrame, hub_degree: int = HUB_DEGREE) -> Linked:
    """Drop unshared indicators and separate hubs, those of more than ``hub_degree`` cases."""
    edges = indicators.select("owner", "case_id", "arrival", "kind", "value").dropDuplicates(["owner", "case_id", "kind", "value"])
    degree = cut(edges.groupBy(*EDGE).agg(F.count("*").alias("degree")).filter(F.col("degree") >= 2).withColumn("number", F.monotonically_increasing_id()))
    shared = cut(join_on_hot_key(edges, degree, EDGE, degree.filter(F.col("degree") > HOT_ROWS).select(*EDGE)))
    hubs = (shared.filter(F.col("degree") > hub_degree).groupBy(*CASE, "arrival")
            .agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("hubs")))
    return Linked(shared.filter(F.col("degree") <= hub_degree).drop("degree", "number"), hubs, hub_degree, shared.drop("degree"))


def hub_classes(linked: Linked) -> DataFrame:
    """Cases by their exact set of hubs: size and first case of each class."""
    return linked.hubs.groupBy("owner", "hubs").agg(F.count("*").alias("n"), F.min(F.struct("arrival", "case_id")).alias("first"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Ordered pairs of classes (a class with itself too) that share a hub, each once: at the first hub they share."""
    at = classes.select("owner", "hubs", "n", "first", F.explode("hubs").alias("hub"))
    a = at.select("owner", "hub", F.col("hubs").alias("ha"), F.col("n").alias("na"))
    b = at.select("owner", "hub", F.col("hubs").alias("hb"), F.col("n").alias("nb"), F.col("first").alias("first_b"))
    shared = F.array_intersect("ha", "hb")
    return a.join(b, ["owner", "hub"]).filter(F.col("hub") == F.element_at(shared, 1)).select("owner", "ha", "hb", "na", "nb", "first_b", shared.alias("s"))


def narrow_pairs(linked: Linked) -> DataFrame:
    """Pairs of cases (``a`` earlier than ``b``) that share a narrow indicator, with
    everything they share, hubs included."""
    if linked.pairs is not None:
        return linked.pairs
    n = linked.narrow
    order = F.struct("arrival", "case_id")
    a = n.select(*EDGE, F.col("case_id").alias("a"), order.alias("oa"))
    b = n.select(*EDGE, F.col("case_id").alias("b"), order.alias("ob"))
    own = (a.join(b, EDGE).filter(F.col("oa") < F.col("ob"))
           .groupBy("owner", "a", "b").agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("shared")))
    h = linked.hubs.select("owner", "case_id", "hubs")
    both = (own.join(h.withColumnsRenamed({"case_id": "a", "hubs": "ha"}), ["owner", "a"], "left")
            .join(h.withColumnsRenamed({"case_id": "b", "hubs": "hb"}), ["owner", "b"], "left"))
    none = F.filter("shared", lambda x: F.lit(False))
    return both.select("owner", "a", "b", "shared", F.coalesce(F.array_intersect("ha", "hb"), none).alias("shared_hubs"))


def _weight(array: str) -> Column:
    return F.aggregate(F.transform(array, lambda s: weight_of(s["kind"])), F.lit(0.0), lambda x, y: x + y)


def pair_strengths(linked: Linked) -> DataFrame:
    """Linked pairs through narrow indicators: shared count and strength."""
    p = narrow_pairs(linked).withColumn("shared", F.concat("shared", "shared_hubs")).drop("shared_hubs")
    return p.select("owner", F.least("a", "b").alias("case_a"), F.greatest("a", "b").alias("case_b"), "shared",
                    F.size("shared").alias("n_shared"), F.round(strength_of(_weight("shared")), 6).alias("strength"))


def hub_pair_classes(linked: Linked) -> DataFrame:
    """The remaining pairs, those that share hubs only, counted by the exact
    set of hubs they share.  One row stands for ``n_pairs`` pairs."""
    both = class_pairs(hub_classes(linked)).filter(F.col("ha") <= F.col("hb"))
    n_pairs = F.when(F.col("ha") == F.col("hb"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    exact = both.groupBy("owner", "s").agg(F.sum(n_pairs).alias("n_pairs"))
    listed = (narrow_pairs(linked).filter(F.size("shared_hubs") > 0).groupBy("owner", F.col("shared_hubs").alias("s"))
              .agg((-F.count("*")).alias("n_pairs")))
    left = exact.unionByName(listed).groupBy("owner", "s").agg(F.sum("n_pairs").alias("n_pairs")).filter(F.col("n_pairs") > 0)
    return left.select("owner", F.col("s").alias("shared"), "n_pairs", F.round(strength_of(_weight("s")), 6).alias("strength"))


# ------------------------------------------------------- related prior cases

def parts_of(common: DataFrame) -> DataFrame:
    """(own, part, n, n_old): for every set ``own`` the parts that are counted.  A set of at most PART_OF indicators ``common``
    with other sets gives all their subsets; a larger one those of these subsets that it holds."""
    every = "transform(sequence(1, shiftleft(1, size(common)) - 1), m -> filter(common, (x, i) -> (shiftright(m, i) & 1) = 1))"
    parts = common.filter(F.size("common") <= PART_OF).select("own", F.explode(F.expr(every)).alias("part"), "n", "n_old")
    wide = common.filter(F.size("common") > PART_OF)
    if wide.isEmpty():
        return parts
    asked = parts.select("part", F.col("part")[0].alias("number")).distinct()
    at = wide.withColumn("number", F.explode("common"))
    return parts.unionByName(at.join(asked, "number").filter(F.size(F.array_except("part", "common")) == 0).select("own", "part", "n", "n_old"))


def earlier_of_wide(cases: DataFrame, wide: DataFrame) -> DataFrame:
    """``earlier_by_sets`` for the cases of the sets in ``wide``, each compared with every set that it meets.

    Such a set gets one time line of the cases of all sets that share an indicator with it; the rank of its own cases on that
    line is their number of earlier cases.  An earlier case of another set exists if that set's first case is earlier."""
    first = cases.groupBy("own").agg(F.min(F.struct("arrival", "case_id")).alias("first_b"))
    a = wide.select(F.col("own").alias("line"), F.explode("own").alias("number"))
    both = a.join(first.withColumn("number", F.explode("own")), "number")
    meet = F.array_intersect("line", "own")
    pairs = cut(both.filter(F.col("number") == F.array_min(meet)).select("line", "own", "first_b", F.size(meet).alias("shared")))
    times = cases.select("owner", "arrival", "case_id", "own")
    line = pairs.select("line", "own").join(times, "own").select("owner", "line", "arrival", "case_id", (F.col("line") == F.col("own")).alias("mine"))
    ranked = rank_within(line, ["line"], ["arrival", "case_id"], "related").filter("mine").select(*CASE, "related")
    best = (times.withColumnRenamed("own", "line").join(pairs.drop("own"), "line").filter(F.col("first_b") < F.struct("arrival", "case_id"))
            .groupBy(*CASE).agg(F.max("shared").alias("best")))
    return ranked.join(best, CASE, "left")


def earlier_by_sets(linked: Linked, before_all: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per case with shared indicators: how many earlier cases share one (related), and the most shared with one of them (best).

    Cases with the same set of indicators are alike, so the work is done on sets.  Of a set only the indicators that it has in
    common with other sets are taken apart.  An earlier case meets this case in some of the parts (subsets) of its set: the
    parts of odd size count it, those of even size take it off again, and what remains is one.  So the number of earlier cases is
    a signed sum of ranks on time lines, one line per part that several sets hold and one of the set itself, which stands for
    all parts that no other set holds.  A case is on at most 2 ** PART_OF lines, however many cases it meets.

    Cases with the arrival ``before_all`` come before all others; they are counted by set, stand on no line and get no row."""
    old = F.lit(False) if before_all is None else F.col("arrival").eqNullSafe(before_all)
    cases = cut(linked.shared.groupBy(*CASE, "arrival").agg(F.sort_array(F.collect_list("number")).alias("own")))
    sets = cut(cases.groupBy("own").agg(F.count("*").alias("n"), F.count(F.when(old, 1)).alias("n_old")))
    at = sets.withColumn("number", F.explode("own"))
    several = cut(at.groupBy("number").agg(F.count("*").alias("sets")).filter("sets > 1"))
    hot = several.filter(F.col("sets") > hot_rows).select("number")
    common = cut(join_on_hot_key(at, several, ["number"], hot).groupBy("own", "n", "n_old").agg(F.sort_array(F.collect_list("number")).alias("common")))
    wide = common.filter(F.size("common") > PART_OF)
    any_wide = not wide.isEmpty()

    parts = cut(parts_of(common))
    held = cut(parts.groupBy("part").agg(F.count("*").alias("sets"), F.sum("n").alias("all"), F.sum("n_old").alias("base")).filter("sets > 1"))
    sign = F.when(F.size("part") % 2 == 1, 1).otherwise(-1)
    lines = join_on_hot_key(parts.select("own", "part"), held, ["part"], held.filter(F.col("sets") > hot_rows).select("part"))
    lines = cut(lines.select("own", "part", sign.alias("weight"), F.size("part").alias("shared"), (F.col("all") - F.col("base")).alias("length"), "base"))
    # the line of a set itself is told from that of the same part by the number before it
    rest = lines.groupBy("own").agg(F.sum("weight").alias("w"))
    alone = sets.join(rest, "own", "left").select("own", F.concat(F.array(F.lit(-1).cast("long")), "own").alias("part"), (1 - F.coalesce("w", F.lit(0))).cast("int").alias("weight"),
                                                  F.size("own").alias("shared"), (F.col("n") - F.col("n_old")).alias("length"), F.col("n_old").alias("base"))
    if any_wide:  # on the lines of others, but counted another way
        lines = lines.join(wide.select("own", F.lit(True).alias("wide")), "own", "left").unionByName(alone.join(wide, "own", "left_anti").withColumn("wide", F.lit(None).cast("boolean")))
    else:
        lines = lines.unionByName(alone).withColumn("wide", F.lit(None).cast("boolean"))

    new = cases if before_all is None else cases.filter(~old)
    crowded = sets.filter(F.col("n") > hot_rows).select("own")
    on = lambda some: join_on_hot_key(new, some, ["own"], crowded).select(*CASE, "arrival", "part", "weight", "shared", "base", "wide")
    before = F.row_number().over(Window.partitionBy("part").orderBy("arrival", "case_id")) - 1
    ranked = on(lines.filter(F.col("length") <= hot_rows)).withColumn("before", before)
    long = lines.filter(F.col("length") > hot_rows)
    if not long.isEmpty():
        ranked = ranked.unionByName(rank_within(on(long), ["part"], ["arrival", "case_id"], "before"))
    seen = F.col("before") + F.when(F.col("arrival").isNull(), 0).otherwise(F.col("base"))  # a case without arrival comes before all
    ranked = ranked.filter("wide is null").withColumn("before", seen)
    found = ranked.groupBy(*CASE).agg(F.sum(F.col("weight") * F.col("before")).alias("related"), F.max(F.when(F.col("before") > 0, F.col("shared"))).alias("best"))
    return found.unionByName(earlier_of_wide(cases, wide)) if any_wide else found


def related_prior(linked: Linked, all_cases: DataFrame, before_all: Column | None = None) -> DataFrame:
    """Per case, how many earlier cases of the same owner it shares
    indicators with, and the largest number shared with one of them.  Cases
    with the arrival ``before_all`` are counted as earlier ones only."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (all_cases.select(*CASE).distinct().join(earlier_by_sets(linked, before_all), CASE, "left")
            .select(*CASE, zero("related").cast("long").alias("related_cases"), zero("best").cast("int").alias("shared_indicator_count")))


def campaign_reuse(prior: DataFrame) -> DataFrame:
    """The reuse finding; confidence grows to 1 at five shared indicators."""
    hit = F.col("related_cases") > 0
    return prior.select("*", F.when(hit, "TRIGGERED").otherwise("CLEAR").alias("status"),
                        F.when(hit, F.least(F.lit(1.0), F.col("shared_indicator_count") / 5)).otherwise(1.0).alias("confidence"))


def correlate_batch(batch: DataFrame, stored: DataFrame | None, hub_degree: int = HUB_DEGREE, all_cases: DataFrame | None = None) -> DataFrame:
    """Related earlier cases of the cases in ``batch``.  Stored cases count as
    earlier whenever they arrived: the order is (stored or not, arrival, case_id), so a
    late case of a later batch still meets them and each pair is reported once.  Only
    stored rows that share an indicator with the batch are read further.  ``all_cases`` adds cases without indicators."""
    cases = batch.select("owner", "case_id").distinct()
    rows = batch.select("owner", "case_id", "arrival", "kind", "value")
    before_all = None
    if stored is not None:
        old = stored.join(rows.select(*EDGE).distinct(), EDGE, "left_semi").join(cases, CASE, "left_anti")
        before_all = F.lit("0001-01-01").cast(rows.schema["arrival"].dataType)
        rows = rows.unionByName(old.select("owner", "case_id", before_all.alias("arrival"), "kind", "value"))
    return campaign_reuse(related_prior(split_hubs(rows, hub_degree), cases if all_cases is None else all_cases.select("owner", "case_id"), before_all))


def relationships_of(indicators: DataFrame, focus: DataFrame, top: int = 5) -> DataFrame:
    """Strongest related cases of the given cases; work is linear in the
    members of their indicators."""
    mine = indicators.join(focus.select(*CASE), CASE, "left_semi").select(*EDGE, F.col("case_id").alias("focus_id")).distinct()
    hits = indicators.join(mine, EDGE).filter(F.col("case_id") != F.col("focus_id")).select("owner", "focus_id", "case_id", "kind", "value").distinct()
    pair = hits.groupBy("owner", "focus_id", "case_id").agg(F.round(strength_of(F.sum(weight_of(F.col("kind")))), 6).alias("strength"), F.count("*").alias("n_shared"))
    # top-k by bounded aggregate: the focus group is never sorted in one task
    total = pair.groupBy("owner", "focus_id").agg(F.count("*").alias("related_count"))
    salted = pair.withColumn("_s", F.pmod(F.xxhash64("case_id"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy("owner", "focus_id", *by).orderBy(F.desc("strength"), "case_id"))
    best = salted.withColumn("_r", rank("_s")).filter(F.col("_r") <= top)
    best = best.withColumn("rank", rank()).filter(F.col("rank") <= top).drop("_r", "_s")
    return best.join(total, ["owner", "focus_id"])


# ------------------------------------------------------------------ campaigns

def components(indicators: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components of size two or more.

    Minimum labels travel case -> indicator -> case and then jump to the label of
    their label, so chains collapse in a logarithmic number of rounds.  Unshared
    indicators are dropped first.  Every round is checkpointed."""
    edges = indicators.select("owner", "case_id", "kind", "value").distinct()
    degree = edges.groupBy(*EDGE).agg(F.count("*").alias("n")).filter(F.col("n") >= 2).drop("n")
    hot = cut(hot_keys(edges, EDGE, hot_rows))
    edges = cut(join_on_hot_key(edges, degree, EDGE, hot))
    labels = edges.select(*CASE).distinct().withColumn("label", F.col("case_id"))
    while True:
        on_edge = edges.join(labels, CASE)
        low = on_edge.groupBy(*EDGE).agg(F.min("label").alias("low"))
        spread = join_on_hot_key(on_edge, low, EDGE, hot)
        step = spread.groupBy(*CASE).agg(F.min("low").alias("next"), F.min("label").alias("label"))
        roots = step.select("owner", F.col("case_id").alias("next"), F.col("next").alias("root"))
        crowded = hot_keys(step, ["owner", "next"], hot_rows)
        moved = cut(join_on_hot_key(step, roots, ["owner", "next"], crowded)
                    .select(*CASE, F.least("next", "root").alias("label"), (F.least("next", "root") != F.col("label")).alias("changed")))
        labels = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")


def depth_limited_clusters(indicators: DataFrame, depth: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clusters of the cases within ``depth`` links of the smallest case not yet taken.  Clusters of one case are dropped.

    Taken one after the other, a case starts a cluster as soon as no smaller case that is still free lies within 2 * depth links: no
    cluster before it can reach what it takes.  So all such cases of all components start at once, and their clusters cannot meet;
    what is left goes into the next round.  A round is 3 * depth steps over the shared indicators, whatever the number of clusters."""
    edges = indicators.select("owner", "case_id", "kind", "value").distinct()
    degree = edges.groupBy(*EDGE).agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    hot = cut(hot_keys(edges, EDGE, hot_rows))
    edges = cut(join_on_hot_key(edges, degree, EDGE, hot))
    free, done = cut(edges.select(*CASE).distinct()), None
    while not free.isEmpty():
        live = cut(edges.join(free, CASE, "left_semi"))
        labels = free.withColumn("low", F.col("case_id"))
        for _ in range(2 * depth):
            on_edge = live.join(labels, CASE)
            least = on_edge.groupBy(*EDGE).agg(F.min("low").alias("least"))
            labels = cut(join_on_hot_key(on_edge, least, EDGE, hot).groupBy(*CASE).agg(F.min("least").alias("low")))
        reached = frontier = cut(labels.filter("low = case_id").select("owner", "case_id", F.col("case_id").alias("cluster")))
        for _ in range(depth):
            touched = live.join(frontier, CASE).select(*EDGE, "cluster").distinct()
            near = join_on_hot_key(live, touched, EDGE, hot).select(*CASE, "cluster").distinct()
            frontier = cut(near.join(reached.select(*CASE), CASE, "left_anti"))
            reached = reached.unionByName(frontier)
        done = reached if done is None else done.unionByName(reached)
        free = cut(free.join(reached.select(*CASE), CASE, "left_anti"))
    if done is None:
        done = edges.select("owner", "case_id", F.col("case_id").alias("cluster"))
    sizes = done.groupBy("owner", "cluster").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    return join_on_hot_key(done, sizes, ["owner", "cluster"], hot_keys(done, ["owner", "cluster"], hot_rows))


def cluster_indicators(indicators: DataFrame, clusters: DataFrame) -> DataFrame:
    """Indicators of each cluster's members, one row each with the number of members that have it."""
    rows = indicators.select("owner", "case_id", "kind", "value").distinct().join(clusters.select("owner", "case_id", "cluster"), CASE)
    return rows.groupBy("owner", "cluster", "kind", "value").agg(F.count("*").alias("n_cases"))


def core_indicators(indicators: DataFrame, comp: DataFrame) -> DataFrame:
    """Indicators of each campaign, one row each (a set can be large)."""
    return indicators.join(comp, CASE).select("owner", "component", "kind", "value").distinct()


def cohesion(linked: Linked, comp: DataFrame) -> DataFrame:
    """Size and mean strength over linked pairs, per campaign."""
    linked = replace(linked, pairs=cut(narrow_pairs(linked)))  # used for listed pairs and for those left to classes
    sizes = comp.groupBy("owner", "component").agg(F.count("*").alias("size"))
    listed = (pair_strengths(linked).select("owner", F.col("case_a").alias("case_id"), "strength", F.lit(1).cast("long").alias("n_pairs"))
              .join(comp, CASE).groupBy("owner", "component").agg(F.sum("strength").alias("s"), F.sum("n_pairs").alias("n")))
    # a hub belongs to exactly one component: that of any of its cases
    home = (linked.hubs.select("owner", "case_id", F.explode("hubs").alias("h")).join(comp, CASE).groupBy("owner", "h").agg(F.min("component").alias("component")))
    counted = (hub_pair_classes(linked).withColumn("h", F.element_at("shared", 1)).join(home, ["owner", "h"])
               .groupBy("owner", "component").agg(F.sum(F.col("strength") * F.col("n_pairs")).alias("s"), F.sum("n_pairs").alias("n")))
    both = listed.unionByName(counted).groupBy("owner", "component").agg(F.sum("s").alias("s"), F.sum("n").alias("n_pairs"))
    return sizes.join(both, ["owner", "component"]).select(
        "owner", "component", "size", "n_pairs", F.round(F.col("s") / F.col("n_pairs"), 2).alias("cohesion"))


def campaign_rollup(comp: DataFrame, cases: DataFrame) -> DataFrame:
    """First and last sighting and case count per campaign."""
    return (comp.join(cases.select("owner", "case_id", "arrival"), CASE).groupBy("owner", "component")
            .agg(F.min("arrival").alias("first_seen"), F.max("arrival").alias("last_seen"), F.count("*").alias("case_count")))


def shared_iocs(indicators: DataFrame) -> DataFrame:
    """Indicators seen in two or more cases."""
    return (indicators.select(*EDGE, "case_id").distinct().groupBy(*EDGE).agg(F.count("*").alias("n_cases")).filter(F.col("n_cases") >= 2))


def isolated_cases(cases: DataFrame, comp: DataFrame) -> DataFrame:
    """Cases in no campaign."""
    return cases.select(*CASE).join(comp.select(*CASE), CASE, "left_anti")


# ---------------------------------------------------------------- entity graph

def entity_links(cases: DataFrame, hops: DataFrame, urls: DataFrame, attachments: DataFrame, headers: DataFrame | None = None,
                 suffixes: SuffixRules | None = None) -> DataFrame:
    """Typed links, each once.  ``hops`` carries trust and public."""
    cid = F.col("case_id").cast("string")
    alias = F.array(*[F.struct(F.col(c).alias("addr"), F.lit(r).alias("rel")) for c, r in
                      (("from_addr", "from"), ("reply_to", "reply-to"), ("return_path", "return-path"))])
    a = (cases.select("owner", cid.alias("case"), F.explode(alias).alias("x")).filter(F.coalesce(F.col("x.addr"), F.lit("")) != "")
         .select("owner", "case", F.lower("x.addr").alias("addr"), F.col("x.rel").alias("rel")))
    link = lambda df, s, t, r: df.select("owner", s.alias("source"), t.alias("target"), r.alias("rel"))
    node = F.concat(F.lit("alias:"), F.col("addr"))
    owned = cases.select("owner", "case_id")
    h = hops.filter(F.col("public")).join(owned, "case_id")
    u = urls.filter(F.coalesce(F.col("domain"), F.lit("")) != "").join(owned, "case_id").withColumn("reg", F.coalesce(registrable(F.lower("domain"), suffixes), F.lower("domain")))
    t = attachments.filter(F.coalesce(F.col("sha256"), F.lit("")) != "").join(owned, "case_id")
    parts = [link(a, F.col("case"), node, F.col("rel")),
             link(a.filter(F.col("addr").contains("@")), node, F.concat(F.lit("domain:"), domain_of(F.col("addr"))), F.lit("domain")),
             link(h, cid, F.concat(F.lit("ip:"), F.col("from_ip")), F.when(F.col("trust") == "BOUNDARY", "origin").otherwise("relay")),
             link(u, cid, F.concat(F.lit("infra:"), F.col("reg")), F.lit("link")),
             link(t, cid, F.concat(F.lit("hash:"), F.col("sha256")), F.lit("attachment"))]
    if headers is not None:
        r = reply_chain(cases, headers)
        parts.append(r.select("owner", F.col("case_id").cast("string").alias("source"), F.col("other").cast("string").alias("target"), F.lit("reply-chain").alias("rel")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reply_chain(cases: DataFrame, headers: DataFrame) -> DataFrame:
    """Case -> the case whose Message-ID it replies to, within one owner.
    On duplicate ids the last case wins."""
    known = (cases.filter(F.trim("message_id") != "").groupBy("owner", F.trim("message_id").alias("mid"))
             .agg(F.max_by("case_id", F.struct("arrival", "case_id")).alias("other")))
    refs = (headers.filter(F.lower("name").isin("in-reply-to", "references"))
            .select("case_id", F.explode(F.regexp_extract_all("value", F.lit(r"<[^>]+>"), F.lit(0))).alias("mid")))
    return (refs.join(cases.select(*CASE), "case_id").join(known, ["owner", "mid"]).filter(F.col("other") != F.col("case_id"))
            .select("owner", "case_id", "other").distinct())


def entity_nodes(cases: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """Nodes; a hash keeps the label of its first attachment."""
    case_nodes = cases.select("owner", F.col("case_id").cast("string").alias("id"), F.lit("case").alias("type"), F.coalesce("subject", F.lit("(no subject)")).alias("label"))
    others = links.filter(F.col("rel") != "reply-chain").select("owner", F.col("target").alias("id")).distinct()
    kind = F.substring_index("id", ":", 1)
    first = (attachments.join(cases.select("owner", "case_id"), "case_id").groupBy("owner", F.concat(F.lit("hash:"), F.col("sha256")).alias("id"))
             .agg(F.min_by("filename", F.struct("case_id", "pos")).alias("filename")))
    tail = F.expr("substring(id, instr(id, ':') + 1)")
    rest = (others.join(first, ["owner", "id"], "left").select("owner", "id", kind.alias("type"), F.when(kind == "hash", F.coalesce("filename", F.substring(tail, 1, 10))).otherwise(tail).alias("label")))
    return case_nodes.unionByName(rest)


def campaign_subgraph(links: DataFrame, indicators: DataFrame, comp: DataFrame, owner: str, component) -> DataFrame:
    """Labelled edges of one campaign."""
    members = comp.filter((F.col("owner") == owner) & (F.col("component") == component)).select(*CASE)
    direct = links.join(members.select("owner", F.col("case_id").cast("string").alias("source")), ["owner", "source"], "left_semi")
    shared = (indicators.join(members, CASE, "left_semi").select("owner", F.col("case_id").cast("string").alias("source"),
              F.concat_ws(":", "kind", "value").alias("target"), F.lit("indicator").alias("rel")))
    return direct.unionByName(shared).distinct()


def legacy_correlation(emails: DataFrame) -> DataFrame:
    """First-generation correlation on origin ip and sender domain, as
    indicator rows ready for components(), with the pairs each value makes."""
    kinds = F.array(F.struct(F.lit("ip_address").alias("kind"), F.col("origin_ip").alias("value")),
                    F.struct(F.lit("sender_domain").alias("kind"), F.col("from_domain").alias("value")))
    return (emails.select("owner", "case_id", F.explode(kinds).alias("x")).select("owner", "case_id", "x.kind", "x.value")
            .filter(F.coalesce(F.col("value"), F.lit("")) != ""))


def legacy_edge_counts(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("owner", "kind", "value").agg(F.count("*").alias("n_emails")).filter(F.col("n_emails") > 1)
            .withColumn("n_edges", F.expr("n_emails * (n_emails - 1) div 2")))
