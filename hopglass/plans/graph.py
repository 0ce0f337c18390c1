"""Queries G01-G21."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.net import with_routability
from ..operators import graph as op, headers as hd, scoring
from ..operators.dims import EARLIER, LATEST
from . import oracle_parts as o
from .registry import query

HUB = 50  # low on purpose: both ways of counting pairs must do real work here
_label = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["value"])), ",")

_W = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in fx.INDICATOR_WEIGHTS.items()) + f" ELSE {fx.OTHER_INDICATOR_WEIGHT} END"
_IND = f"""ind AS (SELECT DISTINCT owner, case_id, arrival, kind, value, {_W} AS w FROM d_indicators)"""
_PAIRS = f"""{_IND}, pr AS (SELECT a.owner, a.case_id AS a, b.case_id AS b, count(*) AS n_shared, round(least(1.0, sum(a.w) / 2), 6) AS strength,
    string_agg(a.kind || ':' || a.value, ',' ORDER BY a.kind || ':' || a.value) AS shared
  FROM ind a JOIN ind b ON a.owner = b.owner AND a.kind = b.kind AND a.value = b.value AND a.case_id < b.case_id GROUP BY 1, 2, 3)"""


def _components(edges: str, rounds: int = 40) -> str:
    """Label spreading over ``u(owner, x, y)``, a fixed number of rounds."""
    return f"""{edges}, lab AS (SELECT 0 AS i, owner, x AS n, min(y) AS l FROM u GROUP BY owner, x
      UNION ALL SELECT lab.i + 1, u.owner, u.x, min(lab.l) FROM lab JOIN u ON u.owner = lab.owner AND u.y = lab.n
        WHERE lab.i < {rounds} GROUP BY lab.i, u.owner, u.x),
    comp AS (SELECT owner, n AS case_id, l AS component FROM lab WHERE i = {rounds})"""


_EDGES = f"""{_IND}, c0 AS (SELECT owner, kind, value, min(case_id) AS c, count(*) AS n FROM ind GROUP BY 1, 2, 3 HAVING count(*) > 1),
    e AS (SELECT i.owner, i.case_id AS a, c0.c AS b FROM ind i JOIN c0 ON c0.owner = i.owner AND c0.kind = i.kind AND c0.value = i.value),
    u AS (SELECT owner, a AS x, b AS y FROM e UNION SELECT owner, b, a FROM e UNION SELECT owner, a, a FROM e UNION SELECT owner, b, b FROM e)"""
_COMP = f"WITH RECURSIVE {_components(_EDGES)} "


def _extracted(src, version=LATEST):
    facts = hd.relay_facts(src.d_hops).select("case_id", "origin_ip", (F.col("origin_seq").eqNullSafe(F.col("boundary_seq")) & F.col("origin_ip").isNotNull()).alias("defensible"))
    hops = with_routability(src.d_hops, "from_ip")
    return op.extract_indicators(src.d_cases, facts, src.d_urls, src.d_attachments, version, hops, src.suffixes)


_SKIP = o.words(fx.PUBLIC_PROVIDERS + fx.COMMON_LINK_HOSTS)
_TAILX = """UNION SELECT case_id, 'hash', sha256 FROM d_attachments"""


@query("g01_extract_indicators", f"""WITH {o.hop_ctes()}, uu AS (SELECT case_id, domain, {o.org('domain')} AS reg FROM d_urls),
    x AS (SELECT case_id, 'ip' AS kind, origin_ip AS value FROM origin WHERE origin_ip IS NOT NULL
      UNION SELECT case_id, 'url', domain FROM uu WHERE reg IS NULL OR reg NOT IN ({_SKIP})
      UNION SELECT case_id, 'urlreg', reg FROM uu WHERE reg NOT IN ({_SKIP}) {_TAILX})
    SELECT c.owner, x.* FROM x JOIN d_cases c ON c.case_id = x.case_id""")
def g01(src):
    return _extracted(src).drop("arrival")


@query("g02_fallback_all_hops", f"""WITH {o.hop_ctes()}, uu AS (SELECT case_id, domain, {o.org('domain', False)} AS reg FROM d_urls),
    nb AS (SELECT case_id FROM origin WHERE NOT coalesce(origin_seq = boundary_seq, false)),
    x AS (SELECT case_id, 'ip' AS kind, origin_ip AS value FROM origin WHERE origin_ip IS NOT NULL AND case_id NOT IN (SELECT case_id FROM nb)
      UNION SELECT case_id, 'ip', from_ip FROM hx WHERE pub AND case_id IN (SELECT case_id FROM nb)
      UNION SELECT case_id, 'url', domain FROM uu
      UNION SELECT case_id, 'urlreg', reg FROM uu WHERE reg IS NOT NULL AND reg NOT IN ({o.words(fx.PUBLIC_PROVIDERS)}) {_TAILX})
    SELECT c.owner, x.* FROM x JOIN d_cases c ON c.case_id = x.case_id""")
def g02(src):
    return _extracted(src, EARLIER).drop("arrival")


@query("g03_new_indicators", """SELECT DISTINCT i.owner, i.case_id, i.kind, i.value FROM d_indicators i
    WHERE NOT EXISTS (SELECT 1 FROM d_indicators s WHERE s.arrival < TIMESTAMP '1996-01-01' AND s.owner = i.owner AND s.case_id = i.case_id AND s.kind = i.kind AND s.value = i.value)""")
def g03(src):
    d = src.d_indicators
    return op.new_indicators(d.filter("arrival < timestamp '1996-01-01'"), d).drop("arrival")


_PRIOR = f"""{_IND}, pp AS (SELECT a.owner, a.case_id, b.case_id AS other, count(*) AS n FROM ind a JOIN ind b
      ON a.owner = b.owner AND a.kind = b.kind AND a.value = b.value AND (b.arrival, b.case_id) < (a.arrival, a.case_id) GROUP BY 1, 2, 3),
    agg AS (SELECT owner, case_id, count(*) AS related_cases, max(n) AS shared FROM pp GROUP BY 1, 2),
    al AS (SELECT DISTINCT owner, case_id FROM ind)"""


@query("g04_related_prior", f"""WITH {_PRIOR} SELECT al.owner, al.case_id, coalesce(related_cases, 0) AS related_cases,
    coalesce(shared, 0) AS shared_indicator_count FROM al LEFT JOIN agg ON agg.owner = al.owner AND agg.case_id = al.case_id""")
def g04(src):
    return op.related_prior(op.split_hubs(src.d_indicators, HUB), src.d_indicators)


@query("g05_campaign_reuse", f"""WITH {_PRIOR} SELECT CASE WHEN related_cases > 0 THEN 'TRIGGERED' ELSE 'CLEAR' END AS status,
    CASE WHEN related_cases > 0 THEN least(1.0, shared / 5.0) ELSE 1.0 END AS confidence, count(*) AS n
    FROM al LEFT JOIN agg ON agg.owner = al.owner AND agg.case_id = al.case_id GROUP BY 1, 2""")
def g05(src):
    prior = op.related_prior(op.split_hubs(src.d_indicators, HUB), src.d_indicators)
    return op.campaign_reuse(prior).groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query("g06_pair_strengths", f"WITH {_PAIRS} SELECT owner, shared, n_shared, strength, count(*) AS n_pairs FROM pr GROUP BY 1, 2, 3, 4")
def g06(src):
    """Every linked pair, by what it shares: listed pairs plus counted hub classes."""
    linked = op.split_hubs(src.d_indicators, HUB)
    listed = (op.pair_strengths(linked).select("owner", F.array_sort(F.transform("shared", lambda s: F.concat_ws(":", s["kind"], s["value"]))).alias("x"), "n_shared", "strength")
              .groupBy("owner", F.array_join("x", ",").alias("shared"), "n_shared", "strength").agg(F.count("*").alias("n_pairs")))
    counted = op.hub_pair_classes(linked).select("owner", _label("shared").alias("shared"), F.size("shared").alias("n_shared"), "strength", "n_pairs")
    return (listed.select("owner", "shared", "n_shared", "strength", "n_pairs").unionByName(counted.select("owner", "shared", "n_shared", "strength", "n_pairs"))
            .groupBy("owner", "shared", "n_shared", "strength").agg(F.sum("n_pairs").alias("n_pairs")))


@query("g07_components", _COMP + "SELECT owner, case_id, component FROM comp")
def g07(src):
    return op.components(src.d_indicators)


#: One seed per component and step, the smallest free case; what lies within three links of it is taken.
_CLUSTERS = f"""{_components(_EDGES)}, adj AS (SELECT DISTINCT a.owner, a.case_id AS a, b.case_id AS b FROM d_indicators a JOIN d_indicators b ON a.owner = b.owner AND a.kind = b.kind AND a.value = b.value AND a.case_id <> b.case_id),
    st AS (SELECT owner, case_id, component, CAST(NULL AS BIGINT) AS cluster, 0 AS step FROM comp
      UNION ALL SELECT st.owner, st.case_id, st.component, coalesce(st.cluster, n.seed), st.step + 1 FROM st LEFT JOIN (
          SELECT x.owner, x.case_id, min(x.seed) AS seed FROM (
            WITH f AS (SELECT owner, case_id, component FROM st WHERE cluster IS NULL), s0 AS (SELECT owner, min(case_id) AS seed, min(case_id) AS case_id FROM f GROUP BY owner, component),
              s1 AS (SELECT f.owner, s0.seed, f.case_id FROM s0 JOIN adj ON adj.owner = s0.owner AND adj.a = s0.case_id JOIN f ON f.owner = adj.owner AND f.case_id = adj.b),
              s2 AS (SELECT DISTINCT f.owner, s1.seed, f.case_id FROM s1 JOIN adj ON adj.owner = s1.owner AND adj.a = s1.case_id JOIN f ON f.owner = adj.owner AND f.case_id = adj.b),
              s3 AS (SELECT DISTINCT f.owner, s2.seed, f.case_id FROM s2 JOIN adj ON adj.owner = s2.owner AND adj.a = s2.case_id JOIN f ON f.owner = adj.owner AND f.case_id = adj.b)
            SELECT owner, seed, case_id FROM s0 UNION SELECT owner, seed, case_id FROM s1 UNION SELECT owner, seed, case_id FROM s2 UNION SELECT owner, seed, case_id FROM s3) x GROUP BY 1, 2) n
        ON n.owner = st.owner AND n.case_id = st.case_id WHERE (SELECT count(*) FROM st WHERE cluster IS NULL) > 0),
    cl AS (SELECT owner, case_id, cluster, count(*) OVER (PARTITION BY owner, cluster) AS size FROM st WHERE step = (SELECT max(step) FROM st))"""


@query("g08_depth_limited_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT owner, case_id, cluster, size FROM cl WHERE size > 1")
def g08(src):
    return op.depth_limited_clusters(src.d_indicators).select("owner", "case_id", "cluster", "size")


@query("g08_cluster_indicators", f"""WITH RECURSIVE {_CLUSTERS} SELECT cl.owner, cluster, kind, value, count(*) AS n_cases
    FROM cl JOIN (SELECT DISTINCT owner, case_id, kind, value FROM d_indicators) i ON i.owner = cl.owner AND i.case_id = cl.case_id WHERE size > 1 GROUP BY 1, 2, 3, 4""")
def g08_core(src):
    return op.cluster_indicators(src.d_indicators, op.depth_limited_clusters(src.d_indicators))


@query("g09_core_indicators", _COMP + """SELECT DISTINCT c.owner, c.component, i.kind, i.value FROM comp c
    JOIN ind i ON i.owner = c.owner AND i.case_id = c.case_id""")
def g09(src):
    return op.core_indicators(src.d_indicators, op.components(src.d_indicators))


@query("g10_cohesion", f"WITH RECURSIVE {_components(_EDGES)}, {_PAIRS.split('FROM d_indicators), ')[1]}, " + """
    sz AS (SELECT owner, component, count(*) AS size FROM comp GROUP BY 1, 2)
    SELECT c.owner, c.component, max(sz.size) AS size, count(*) AS n_pairs, round(round(avg(pr.strength), 9), 2) AS cohesion
    FROM pr JOIN comp c ON c.owner = pr.owner AND c.case_id = pr.a JOIN sz ON sz.owner = c.owner AND sz.component = c.component GROUP BY 1, 2""")
def g10(src):
    d = src.d_indicators
    return op.cohesion(op.split_hubs(d, HUB), op.components(d))


_FOCUS = "(SELECT owner, min(case_id) AS focus_id FROM d_indicators GROUP BY owner)"


@query("g11_case_relationships", f"""WITH {_PAIRS}, s AS (SELECT owner, a AS focus_id, b AS case_id, n_shared, strength FROM pr UNION ALL SELECT owner, b, a, n_shared, strength FROM pr),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY s.owner, s.focus_id ORDER BY strength DESC, case_id) AS rank, count(*) OVER (PARTITION BY s.owner, s.focus_id) AS related_count
      FROM s JOIN {_FOCUS} f ON f.owner = s.owner AND f.focus_id = s.focus_id)
    SELECT owner, focus_id, case_id, strength, n_shared, rank, related_count FROM r WHERE rank <= 5""")
def g11(src):
    focus = src.d_indicators.groupBy("owner").agg(F.min("case_id").alias("case_id"))
    return op.relationships_of(src.d_indicators, focus)


@query("g12_live_graph", f"""WITH {o.verdict_ctes()} SELECT v.case_id, v.score, v.band, c.subject, c.from_addr, count(i.value) AS n_edges
    FROM verdict v JOIN d_cases c ON c.case_id = v.case_id LEFT JOIN d_indicators i ON i.case_id = v.case_id GROUP BY 1, 2, 3, 4, 5""")
def g12(src):
    v = scoring.score_cases(src.d_evidence).select("case_id", "score", "band")
    edges = src.d_indicators.groupBy("case_id").agg(F.count("*").alias("n_edges"))
    return (v.join(src.d_cases.select("case_id", "subject", "from_addr"), "case_id").join(edges, "case_id", "left").na.fill(0, ["n_edges"]))


def _links(src, replies=True):
    hops = with_routability(hd.with_trust(src.d_hops), "from_ip").drop("boundary_seq")
    return op.entity_links(src.d_cases, hops, src.d_urls, src.d_attachments, src.d_headers if replies else None, src.suffixes)


_REPLY = """known AS (SELECT owner, trim(message_id) AS mid, arg_max(case_id, (arrival, case_id)) AS other FROM d_cases WHERE message_id IS NOT NULL GROUP BY 1, 2),
    refs AS (SELECT DISTINCT case_id, unnest(regexp_extract_all(value, '<[^>]+>')) AS mid FROM d_headers WHERE lower(name) IN ('in-reply-to', 'references')),
    rc AS (SELECT DISTINCT c.owner, r.case_id, k.other FROM refs r JOIN d_cases c ON c.case_id = r.case_id JOIN known k ON k.owner = c.owner AND k.mid = r.mid WHERE k.other <> r.case_id)"""
_LINKS = f"""{o.hop_ctes()}, al AS (SELECT owner, case_id, from_addr AS addr, 'from' AS rel FROM d_cases WHERE from_addr IS NOT NULL
      UNION SELECT owner, case_id, reply_to, 'reply-to' FROM d_cases WHERE reply_to IS NOT NULL
      UNION SELECT owner, case_id, return_path, 'return-path' FROM d_cases WHERE return_path IS NOT NULL), {_REPLY},
    links AS (SELECT owner, CAST(case_id AS STRING) AS source, 'alias:' || addr AS target, rel FROM al
      UNION SELECT owner, 'alias:' || addr, 'domain:' || {o.dom('addr')}, 'domain' FROM al
      UNION SELECT c.owner, CAST(h.case_id AS STRING), 'ip:' || from_ip, CASE trust WHEN 'BOUNDARY' THEN 'origin' ELSE 'relay' END FROM hx h JOIN d_cases c ON c.case_id = h.case_id WHERE pub
      UNION SELECT c.owner, CAST(u.case_id AS STRING), 'infra:' || coalesce({o.org('u.domain')}, u.domain), 'link' FROM d_urls u JOIN d_cases c ON c.case_id = u.case_id
      UNION SELECT c.owner, CAST(t.case_id AS STRING), 'hash:' || t.sha256, 'attachment' FROM d_attachments t JOIN d_cases c ON c.case_id = t.case_id
      UNION SELECT owner, CAST(case_id AS STRING), CAST(other AS STRING), 'reply-chain' FROM rc)"""


@query("g13_entity_links", f"WITH {_LINKS} SELECT * FROM links")
def g13(src):
    return _links(src)


@query("g14_reply_chain", f"WITH {_REPLY} SELECT * FROM rc")
def g14(src):
    return op.reply_chain(src.d_cases, src.d_headers)


_NODES = f"""{_LINKS}, fl AS (SELECT c.owner, 'hash:' || t.sha256 AS id, arg_min(filename, (t.case_id, t.pos)) FILTER (filename IS NOT NULL) AS any_name,
      first(filename ORDER BY t.case_id, t.pos) AS filename FROM d_attachments t JOIN d_cases c ON c.case_id = t.case_id GROUP BY 1, 2),
    ot AS (SELECT DISTINCT owner, target AS id FROM links WHERE rel <> 'reply-chain'),
    nodes AS (SELECT owner, CAST(case_id AS STRING) AS id, 'case' AS type, coalesce(subject, '(no subject)') AS label FROM d_cases
      UNION ALL SELECT ot.owner, ot.id, string_split(ot.id, ':')[1], CASE WHEN ot.id LIKE 'hash:%' THEN coalesce(fl.filename, substr(ot.id, 6, 10))
        ELSE substr(ot.id, position(':' IN ot.id) + 1) END FROM ot LEFT JOIN fl ON fl.owner = ot.owner AND fl.id = ot.id)"""


@query("g15_entity_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def g15(src):
    return op.entity_nodes(src.d_cases, _links(src), src.d_attachments)


@query("g16_shared_iocs", """SELECT owner, kind, value, count(DISTINCT case_id) AS n_cases FROM d_indicators GROUP BY 1, 2, 3 HAVING count(DISTINCT case_id) >= 2""")
def g16(src):
    return op.shared_iocs(src.d_indicators)


@query("g16_tracked_totals", """WITH s AS (SELECT owner, kind, value, count(DISTINCT case_id) AS n FROM d_indicators GROUP BY 1, 2, 3)
    SELECT owner, count(*) AS tracked, count(*) FILTER (n >= 2) AS shared FROM s GROUP BY owner""")
def g16_totals(src):
    per = src.d_indicators.select("owner", "kind", "value", "case_id").distinct().groupBy("owner", "kind", "value").agg(F.count("*").alias("n"))
    return per.groupBy("owner").agg(F.count("*").alias("tracked"), F.count(F.when(F.col("n") >= 2, 1)).alias("shared"))


@query("g17_isolated_cases", _COMP + "SELECT owner, case_id FROM d_cases WHERE (owner, case_id) NOT IN (SELECT owner, case_id FROM comp)")
def g17(src):
    return op.isolated_cases(src.d_cases, op.components(src.d_indicators))


@query("g17_shared_infrastructure", _COMP + """SELECT c.owner, c.component, i.kind || ':' || i.value AS infra, count(*) AS n_cases FROM comp c
    JOIN ind i ON i.owner = c.owner AND i.case_id = c.case_id GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def g17_infra(src):
    comp = op.components(src.d_indicators)
    edges = src.d_indicators.select("owner", "case_id", "kind", "value").distinct()
    return (edges.join(comp, op.CASE).groupBy("owner", "component", F.concat_ws(":", "kind", "value").alias("infra"))
            .agg(F.count("*").alias("n_cases")).filter("n_cases > 1"))


_LEG = f"""{o.hop_ctes()}, ind AS (SELECT c.owner, c.case_id, 'ip_address' AS kind, g.origin_ip AS value FROM d_cases c JOIN origin g ON g.case_id = c.case_id WHERE g.origin_ip IS NOT NULL
      UNION ALL SELECT owner, case_id, 'sender_domain', {o.dom('from_addr')} FROM d_cases)"""


def _legacy(src):
    org = hd.relay_facts(src.d_hops).select("case_id", "origin_ip")
    emails = src.d_cases.join(org, "case_id", "left").withColumn("from_domain", hd.domain_of(F.col("from_addr")))
    return op.legacy_correlation(emails)


@query("g18_legacy_edges", f"WITH {_LEG} SELECT owner, kind, value, count(*) AS n_emails, count(*) * (count(*) - 1) // 2 AS n_edges FROM ind GROUP BY 1, 2, 3 HAVING count(*) > 1")
def g18(src):
    return op.legacy_edge_counts(_legacy(src))


@query("g18_legacy_clusters", f"""WITH RECURSIVE {_components(_LEG + _EDGES.split('FROM d_indicators)')[1])}
    SELECT owner, component, count(*) AS size FROM comp GROUP BY 1, 2""")
def g18_clusters(src):
    return op.components(_legacy(src)).groupBy("owner", "component").agg(F.count("*").alias("size"))


@query("g19_campaign_rollup", _COMP + """SELECT c.owner, c.component, CAST(min(d.arrival) AS STRING) AS first_seen, CAST(max(d.arrival) AS STRING) AS last_seen,
    count(*) AS case_count FROM comp c JOIN d_cases d ON d.owner = c.owner AND d.case_id = c.case_id GROUP BY 1, 2""")
def g19(src):
    r = op.campaign_rollup(op.components(src.d_indicators), src.d_cases)
    return r.withColumn("first_seen", F.col("first_seen").cast("string")).withColumn("last_seen", F.col("last_seen").cast("string"))


@query("g20_entity_counts", f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def g20(src):
    return op.entity_nodes(src.d_cases, _links(src), src.d_attachments).groupBy("type").agg(F.count("*").alias("n"))


@query("g20_case_picker", """SELECT case_id, subject, from_addr FROM d_cases WHERE contains(lower(coalesce(subject, '') || ' ' || coalesce(from_addr, '')), 'invoice 7')""")
def g20_picker(src):
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("from_addr", F.lit(""))))
    return src.d_cases.filter(text.contains("invoice 7")).select("case_id", "subject", "from_addr")


@query("g21_campaign_subgraph", f"WITH RECURSIVE {_components(_EDGES)}, {_LINKS}, " + """
    big AS (SELECT owner, component FROM comp GROUP BY 1, 2 ORDER BY count(*) DESC, owner, component LIMIT 1),
    mem AS (SELECT c.owner, c.case_id FROM comp c JOIN big ON big.owner = c.owner AND big.component = c.component)
    SELECT l.owner, l.source, l.target, l.rel FROM links l JOIN mem ON mem.owner = l.owner AND CAST(mem.case_id AS STRING) = l.source
    UNION SELECT i.owner, CAST(i.case_id AS STRING), i.kind || ':' || i.value, 'indicator' FROM ind i JOIN mem ON mem.owner = i.owner AND mem.case_id = i.case_id""")
def g21(src):
    """Typed edges of the largest campaign."""
    comp = op.components(src.d_indicators)
    big = comp.groupBy("owner", "component").count().orderBy(F.desc("count"), "owner", "component").first()
    return op.campaign_subgraph(_links(src), src.d_indicators, comp, big["owner"], big["component"])
