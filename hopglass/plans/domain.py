"""Queries D01-D13."""

from pyspark.sql import functions as F

from ..functions import domains as fd, fixed_values as fx
from ..functions.similarity import brand_parts, indel
from ..operators import domain as op, headers as hd
from ..operators.dims import EARLIER, inline
from . import oracle_parts as o
from .registry import query

_AS_OF = "2024-06-01"
_DOMS = f"(SELECT DISTINCT {o.dom('from_addr')} AS domain FROM d_cases)"


def _domains(src):
    return src.d_cases.select(fd.domain_of(F.col("from_addr")).alias("domain")).distinct()


def _facts(src):
    return op.domain_facts(_domains(src), src.d_domain_intel, F.lit(_AS_OF).cast("date"))


def _lane(src):
    o_ = hd.relay_facts(src.d_hops).select("case_id", "origin_host", "origin_ip")
    return op.domain_lane(src.d_cases, _facts(src), op.rdns_mismatches(o_, src.d_host_ips))


_I = f"""i AS (SELECT domain, CASE WHEN rdap_state <> 'unreachable' THEN date_diff('day', created_at, DATE '{_AS_OF}') END AS age_days, rdap_state = 'unreachable' AS age_down,
    dns_state = 'unreachable' AS dns_down, has_mx, has_a FROM d_domain_intel), c AS (SELECT c.case_id, i.* FROM d_cases c LEFT JOIN i ON i.domain = {o.dom('c.from_addr')})"""


@query("d01_domain_age", f"""WITH {_I} SELECT case_id, CASE WHEN age_down THEN 'UNAVAILABLE' ELSE 'TRIGGERED' END AS status, CAST(CASE WHEN NOT age_down THEN age_days END AS STRING) AS age_days
    FROM c WHERE age_down OR age_days < 30""")
def d01(src):
    e = _lane(src).filter("signal = 'domain_age_lt_30d' and status <> 'CLEAR'")
    return e.select("case_id", "status", F.get_json_object("detail", "$.age_days").alias("age_days"))


@query("d02_dns_state", f"""WITH {_I} SELECT case_id, 'domain_does_not_resolve' AS signal, 'UNAVAILABLE' AS status FROM c WHERE dns_down
    UNION ALL SELECT case_id, 'domain_no_mx', 'TRIGGERED' FROM c WHERE NOT dns_down AND NOT has_mx
    UNION ALL SELECT case_id, 'domain_does_not_resolve', 'TRIGGERED' FROM c WHERE NOT dns_down AND NOT has_a""")
def d02(src):
    return _lane(src).filter(F.col("signal").isin("domain_no_mx", "domain_does_not_resolve")).select("case_id", "signal", "status")


_SK = f"translate(lower(domain), '{fx.DOMAIN_CONFUSABLE_FROM}', '{fx.DOMAIN_CONFUSABLE_TO}')"
_SHAPE = f"""sk AS (SELECT domain, {_SK} AS skel FROM {_DOMS}),
    sh AS (SELECT *, string_split(skel, '.')[:-2] AS labels, array_to_string(string_split(skel, '.')[:-2], '.') AS core FROM sk),
    tk AS (SELECT *, list_distinct(list_filter(string_split(replace(core, '-', '.'), '.'), lambda t: length(t) >= 4)) AS toks,
      list_distinct(list_filter(string_split(replace(replace(core, '-', '.'), '_', '.'), '.'), lambda t: t <> '')) AS pts FROM sh)"""


@query("d03_skeleton", f"SELECT domain, {_SK} AS skel FROM {_DOMS}")
def d03(src):
    return op.domain_shape(_domains(src)).select("domain", "skel")


_PUNY = """SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'xn--80ak6aa92e.com' WHEN 1 THEN 'shop' || CAST(c_custkey % 11 AS STRING) || '.xn--mnchen-3ya.de' ELSE 'plain' || CAST(c_custkey AS STRING) || '.org' END AS domain FROM customer"""


@query("d04_punycode", f"SELECT domain, replace(replace(domain, 'xn--80ak6aa92e', 'аррӏе'), 'xn--mnchen-3ya', 'münchen') AS decoded FROM ({_PUNY})")
def d04(src):
    src.customer.createOrReplaceTempView("customer")
    d = src.spark.sql(_PUNY)
    return d.select("domain", op.unicode_domain(F.col("domain")).alias("decoded"))


@query("d05_tokens", f"""WITH {_SHAPE} SELECT domain, 'token' AS kind, unnest(toks) AS part FROM tk UNION ALL SELECT domain, 'part', unnest(pts) FROM tk""")
def d05(src):
    s = op.domain_shape(_domains(src))
    return (s.select("domain", F.lit("token").alias("kind"), F.explode("tokens").alias("part"))
            .unionByName(s.select("domain", F.lit("part").alias("kind"), F.explode("parts").alias("part"))))


_CORES = [(i, b, brand_parts(b)[0], t) for i, b in enumerate(fx.PROTECTED_BRANDS) for t in brand_parts(b)[1]]
_BR = f"br AS (SELECT * FROM {o.values_sql(_CORES, 't(i, brand, bcore, btok)')})"
_LCS = """lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: 0) AS dp FROM pq
      UNION ALL SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1),
        lambda k: CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN dp[k] + 1 ELSE dp[k + 1] END)) END) FROM lcs WHERE i < length(a)),
    sim AS (SELECT a, b, 200.0 * dp[length(b) + 1] / (length(a) + length(b)) AS ratio FROM lcs WHERE i = length(a))"""
_PQ = """pq AS (SELECT DISTINCT unnest(toks) AS a, btok AS b FROM tk, br UNION SELECT DISTINCT list_reduce(labels, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END), bcore FROM tk, br)"""


@query("d06_indel_similarity", f"WITH RECURSIVE {_SHAPE}, {_BR}, {_PQ}, {_LCS} SELECT a, b, round(ratio, 6) AS ratio FROM sim")
def d06(src):
    s = op.domain_shape(_domains(src))
    brands = [brand_parts(b) for b in fx.PROTECTED_BRANDS]
    words = F.array(*[F.lit(t) for _, names in brands for t in names])
    cores = F.array(*[F.lit(c) for c, _ in brands])
    pair = lambda a, b: s.select(F.explode(a).alias("a"), b.alias("bs")).select("a", F.explode("bs").alias("b"))
    pairs = pair(F.col("tokens"), words).union(pair(F.array("sig"), cores)).distinct()
    return pairs.select("a", "b", F.round(indel("a", "b"), 6).alias("ratio"))


def _look(near_list):
    raw = "domain"
    exempt = " OR ".join(f"{raw} = '{n}' OR {raw} LIKE '%.{n}'" for n in fx.PROTECTED_BRANDS + near_list)
    parts = "OR list_contains(pts, bcore)" if near_list else ""
    return f"""WITH RECURSIVE {_SHAPE}, {_BR}, {_PQ}, {_LCS},
    sg AS (SELECT *, list_reduce(labels, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS sig FROM tk WHERE NOT ({exempt})),
    m AS (SELECT sg.domain, br.i, br.brand, CASE WHEN skel = brand THEN 'typosquat' WHEN list_contains(labels, bcore) OR list_contains(toks, bcore) {parts} THEN 'brand-name-in-domain'
        WHEN length(bcore) >= 4 AND (SELECT max(ratio) FROM sim WHERE a = sig AND b = bcore) >= 82 THEN 'typosquat'
        WHEN length(bcore) >= 4 AND length(btok) >= 5 AND (SELECT max(ratio) FROM sim WHERE list_contains(toks, a) AND b = btok) >= 85 THEN 'typosquat' END AS technique FROM sg, br)
    SELECT domain, arg_min(brand, i) AS brand, arg_min(technique, i) AS technique FROM m WHERE technique IS NOT NULL GROUP BY domain"""


@query("d07_brand_lookalike", _look(fx.LEGIT_NEAR_BRANDS))
def d07(src):
    return op.brand_lookalikes(_domains(src))


@query("d08_without_near_brand_list", _look([]))
def d08(src):
    return op.brand_lookalikes(_domains(src), EARLIER)


@query("d09_rdns_mismatch", f"""WITH {o.hop_ctes()}, oh AS (SELECT h.case_id, h.from_host AS hostname, h.from_ip AS connecting_ip FROM hx h JOIN origin g ON g.case_id = h.case_id AND g.origin_seq = h.seq WHERE h.from_host LIKE '%.%'),
    net AS (SELECT host, ip, array_to_string(string_split(ip, '.')[:-2], '.') AS n FROM d_host_ips WHERE ip IS NOT NULL)
    SELECT case_id, hostname, connecting_ip, CASE WHEN hostname IN (SELECT host FROM net) THEN 'TRIGGERED' ELSE 'UNAVAILABLE' END AS rdns_status FROM oh
    WHERE (hostname IN (SELECT host FROM net) AND (hostname, array_to_string(string_split(connecting_ip, '.')[:-2], '.')) NOT IN (SELECT host, n FROM net))
       OR (hostname NOT IN (SELECT host FROM net) AND hostname IN (SELECT host FROM d_host_ips WHERE state = 'unreachable'))""")
def d09(src):
    o_ = hd.relay_facts(src.d_hops).select("case_id", "origin_host", "origin_ip")
    return op.rdns_mismatches(o_, src.d_host_ips)


@query("d10_legacy_domain_risk", f"""WITH {_I} SELECT domain, concat_ws('; ', CASE WHEN age_days < 30 THEN 'Domain registered only ' || age_days || ' days ago' END,
    CASE WHEN NOT has_mx AND NOT dns_down THEN 'No MX records' END, CASE WHEN NOT has_a AND NOT dns_down THEN 'Does not resolve' END) AS risk_flags,
    CASE WHEN age_days < 30 THEN 1 ELSE 0 END + CASE WHEN NOT has_mx AND NOT dns_down THEN 1 ELSE 0 END + CASE WHEN NOT has_a AND NOT dns_down THEN 1 ELSE 0 END AS n_flags FROM i""")
def d10(src):
    return op.legacy_domain_risk(_facts(src))


_HOSTS = "(SELECT DISTINCT domain AS host FROM d_urls UNION SELECT DISTINCT from_host FROM d_hops WHERE from_host IS NOT NULL)"


def _hosts(src):
    return src.d_urls.select(F.col("domain").alias("host")).union(src.d_hops.select("from_host")).filter("host is not null").distinct()


@query("d11_registrable_domain", f"SELECT host, {o.org('host')} AS org_domain, {o.org('host', False)} AS org_without_private FROM {_HOSTS}")
def d11(src):
    rules = src.suffixes
    return _hosts(src).select("host", fd.registrable(F.col("host"), rules).alias("org_domain"), fd.registrable(F.col("host"), rules, False).alias("org_without_private"))


@query("d11_suffix_table", f"SELECT host, {o.org('host')} AS org_domain FROM {_HOSTS}")
def d11_table(src):
    by = fd.registrable_by_table(_hosts(src), "host", src.d_suffix_rules)
    # hosts without a listed suffix use their last label, so "localhost" has none
    return by.select("host", F.when(F.col("org_domain").contains("."), F.col("org_domain")).alias("org_domain"))


@query("d12_same_org", f"SELECT case_id, {o.same(o.dom('from_addr'), o.dom('return_path'))} AS same FROM d_cases WHERE return_path IS NOT NULL")
def d12(src):
    return (src.d_cases.filter("return_path is not null")
            .select("case_id", fd.same_org(fd.domain_of(F.col("from_addr")), fd.domain_of(F.col("return_path")), src.suffixes).alias("same")))


@query("d13_lane_clear", f"""WITH RECURSIVE {_I}, lk AS ({_look(fx.LEGIT_NEAR_BRANDS).replace('WITH RECURSIVE', 'WITH RECURSIVE')})
    SELECT case_id FROM c WHERE NOT age_down AND coalesce(age_days >= 30, true) AND NOT dns_down AND has_mx AND has_a AND domain NOT IN (SELECT domain FROM lk)""")
def d13(src):
    return op.domain_lane(src.d_cases, _facts(src)).filter("status = 'CLEAR'").select("case_id")
