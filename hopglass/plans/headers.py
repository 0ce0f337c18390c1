"""Queries H01-H18."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.net import with_ip_facts
from ..operators import headers as op
from . import oracle_parts as o
from .registry import query

_H = f"WITH {o.hop_ctes()} "
_text = lambda c: F.col(c).cast("string").alias(c)


@query("h01_parse_hops", """SELECT case_id, seq, coalesce(from_host, 'unknown-host') AS from_host, by_host, protocol,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM d_hops""")
def h01(src):
    return op.parse_hops(src.d_headers).select("case_id", "seq", "from_host", "by_host", "protocol",
                                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


_RAW = """SELECT l_orderkey AS case_id, CAST(l_partkey AS INT) AS seq, l_suppkey,
  CASE l_partkey % 4 WHEN 0 THEN 'from [203.0.113.' || CAST(l_suppkey AS STRING) || '] by a.b.c with SMTP'
    WHEN 1 THEN 'from (rdns.x.org [IPv6:2001:db8::1]) by a.b.c' WHEN 2 THEN 'from host.y.org by [10.0.0.1] id 1'
    ELSE 'from h.z.org (back.z.org [10.1.2.3]) by q' END AS raw FROM lineitem"""


@query("h02_bare_ip_and_rdns", f"""SELECT CASE k WHEN 0 THEN '203.0.113.' || s WHEN 3 THEN '10.1.2.3' END AS from_ip,
    CASE k WHEN 2 THEN 'host.y.org' WHEN 3 THEN 'h.z.org' END AS from_host, count(*) AS n
    FROM (SELECT l_partkey % 4 AS k, CAST(l_suppkey AS STRING) AS s FROM lineitem) GROUP BY 1, 2""")
def h02(src):
    src.lineitem.createOrReplaceTempView("lineitem")
    hops = op._hop_fields(src.spark.sql(_RAW))
    return hops.groupBy("from_ip", "from_host").agg(F.count("*").alias("n"))


_IPS = """SELECT l_orderkey AS case_id, CASE l_partkey % 8 WHEN 0 THEN ' 10.0.0.' || CAST(l_suppkey % 256 AS STRING)
    WHEN 1 THEN 'IPv6:2001:DB8:0:0:0:0:0:' || CAST(1 + l_suppkey % 9 AS STRING) WHEN 2 THEN 'ipv6:fe80::1'
    WHEN 3 THEN '300.1.1.1' WHEN 4 THEN '203.0.113.' || CAST(l_suppkey % 256 AS STRING) WHEN 5 THEN '2002:0a00:0005::1'
    WHEN 6 THEN NULL ELSE '8.8.4.' || CAST(l_suppkey % 256 AS STRING) END AS raw_ip, l_partkey % 8 AS k, l_suppkey % 256 AS s FROM lineitem"""
_CLEAN = """CASE k WHEN 0 THEN '10.0.0.' || CAST(s AS STRING) WHEN 1 THEN '2001:db8::' || CAST(1 + l_suppkey_9 AS STRING)
    WHEN 2 THEN 'fe80::1' WHEN 4 THEN '203.0.113.' || CAST(s AS STRING) WHEN 5 THEN '2002:a00:5::1' WHEN 7 THEN '8.8.4.' || CAST(s AS STRING) END"""
_IPX = f"(SELECT raw_ip, k, s, CAST(substr(raw_ip, length(raw_ip)) AS STRING) AS tail FROM ({_IPS}) z) x"


@query("h03_clean_ip", f"""SELECT {_CLEAN.replace("CAST(1 + l_suppkey_9 AS STRING)", "tail")} AS ip, count(*) AS n FROM {_IPX} GROUP BY 1""")
def h03(src):
    src.lineitem.createOrReplaceTempView("lineitem")
    return with_ip_facts(src.spark.sql(_IPS), "raw_ip").groupBy("ip").agg(F.count("*").alias("n"))


@query("h04_routable", f"""SELECT k, k IN (0, 2, 5) AS unroutable, k IN (1, 4, 7) AS public, count(*) AS n FROM {_IPX} GROUP BY 1, 2, 3""")
def h04(src):
    src.lineitem.createOrReplaceTempView("lineitem")
    return with_ip_facts(src.spark.sql(_IPS), "raw_ip").groupBy("k", "unroutable", "public").agg(F.count("*").alias("n"))


@query("h05_trust_boundary", _H + "SELECT case_id, seq, trust FROM hx")
def h05(src):
    return op.with_trust(src.d_hops).select("case_id", "seq", "trust")


@query("h06_trusted_networks", f"""WITH {o.hop_ctes("OR coalesce(" + o.in_cidrs('from_ip', ['198.51.100.0/24', '80.0.0.0/7', '2a02:3::/32', 'fd00::/8']) + ", false)")}
    SELECT case_id, seq, trust FROM hx""")
def h06(src):
    infra = op.Infrastructure(hosts=("", " "), cidrs=("198.51.100.0/24", "80.0.0.0/7", "2a02:3::/32", "fd00::/8", "300.0.0.0/8"))
    return op.with_trust(src.d_hops, infra).select("case_id", "seq", "trust")


@query("h07_authenticated_origin", _H + "SELECT case_id, boundary_ip, origin_ip, origin_seq FROM origin")
def h07(src):
    return op.relay_facts(src.d_hops).select("case_id", "boundary_ip", "origin_ip", "origin_seq")


@query("h08_forged_hops", _H + """SELECT case_id, string_agg(seq, ',' ORDER BY seq) AS injected_hops, max(boundary_seq) AS boundary_seq,
    (SELECT max(i.from_ip) FROM hx i WHERE i.case_id = hx.case_id AND i.seq = 0) AS claimed_ip FROM hx WHERE forged GROUP BY case_id""")
def h08(src):
    f = op.relay_facts(src.d_hops).filter(F.size("injected_hops") > 0)
    return f.select("case_id", F.array_join(F.col("injected_hops").cast("array<string>"), ",").alias("injected_hops"), "boundary_seq", "claimed_ip")


@query("h09a_private_ip_whole_chain", _H + """SELECT case_id, min(seq) AS hop, arg_min(from_ip, seq) AS ip FROM hx WHERE bad AND NOT forged GROUP BY case_id""")
def h09a(src):
    f = op.relay_facts(src.d_hops).filter(F.col("private_hit_whole_chain").isNotNull())
    return f.select("case_id", F.col("private_hit_whole_chain.seq").alias("hop"), F.col("private_hit_whole_chain.from_ip").alias("ip"))


@query("h09b_private_ip_in_transit", _H + """, tail AS (SELECT *, min(CASE WHEN from_ip IS NULL OR bad THEN 1 ELSE 0 END)
      OVER (PARTITION BY case_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS in_tail FROM hx)
    SELECT case_id, max(seq) AS hop, arg_max(from_ip, seq) AS ip FROM tail WHERE in_tail = 0 AND bad AND NOT forged GROUP BY case_id""")
def h09b(src):
    f = op.relay_facts(src.d_hops).filter(F.col("private_hit_in_transit").isNotNull())
    return f.select("case_id", F.col("private_hit_in_transit.seq").alias("hop"), F.col("private_hit_in_transit.from_ip").alias("ip"))


@query("h10_timestamp_regression", """WITH s AS (SELECT case_id, seq, ts, lag(ts) OVER w AS before, lag(seq) OVER w AS after_hop FROM d_hops
      WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY seq))
    SELECT case_id, min(seq) AS hop, arg_min(after_hop, seq) AS after_hop FROM s WHERE ts < before GROUP BY case_id""")
def h10(src):
    return op.timestamp_regressions(src.d_hops)


@query("h11_reply_to_mismatch", f"""SELECT case_id, coalesce({o.dom('from_addr')} <> {o.dom('reply_to')}, false) AS exact_mismatch,
    coalesce(reply_to IS NOT NULL AND NOT {o.same(o.dom('from_addr'), o.dom('reply_to'))}, false) AS org_mismatch FROM d_cases""")
def h11(src):
    return src.d_cases.select("case_id", op.reply_to_mismatch(F.col("from_addr"), F.col("reply_to"), False).alias("exact_mismatch"),
                              op.reply_to_mismatch(F.col("from_addr"), F.col("reply_to"), suffixes=src.suffixes).alias("org_mismatch"))


@query("h12_fake_reply", """SELECT case_id, trim(subject) AS subject FROM d_cases WHERE regexp_matches(trim(subject), '(?i)^\\s*(re|fwd|fw)\\s*(\\[\\d+\\])?\\s*:')
    AND case_id NOT IN (SELECT case_id FROM d_headers WHERE lower(name) IN ('in-reply-to', 'references'))""")
def h12(src):
    return op.fake_replies(src.d_cases, src.d_headers)


_MID = "lower(regexp_extract(message_id, '@([^>\\s]+)', 1))"


@query("h13_message_id_divergence", f"""WITH m AS (SELECT case_id, {_MID} AS mid, {o.dom('from_addr')} AS d FROM d_cases WHERE message_id IS NOT NULL),
    r AS (SELECT case_id, by_host AS host FROM d_hops UNION ALL SELECT case_id, from_host FROM d_hops)
    SELECT case_id, mid AS message_id_domain, d AS from_domain FROM m WHERE NOT {o.same('mid', 'd')}
      AND NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = m.case_id AND r.host IS NOT NULL AND {o.same('mid', 'r.host')})""")
def h13(src):
    return op.message_id_divergence(src.d_cases, src.d_hops, src.suffixes)


@query("h14_chain_discontinuity", f"""WITH a AS (SELECT case_id, seq, {o.org('from_host')} AS org FROM d_hops WHERE from_host LIKE '%.%'),
    p AS (SELECT * FROM (SELECT *, lag(org) OVER (PARTITION BY case_id ORDER BY seq) AS prev FROM a WHERE org IS NOT NULL) WHERE prev IS NULL OR prev <> org),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id, org ORDER BY seq) AS k FROM p)
    SELECT case_id, arg_min(org, seq) FILTER (k >= 2) AS domain, string_agg(org, ' -> ' ORDER BY seq) AS relay_path FROM n GROUP BY case_id HAVING max(k) >= 2""")
def h14(src):
    return op.chain_discontinuities(src.d_hops, src.suffixes)


_V4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b"


@query("h15_legacy_origin", f"""WITH f AS (SELECT case_id, pos, list_filter(regexp_extract_all(value, '{_V4}'),
      lambda x: NOT regexp_matches(x, '{fx.LEGACY_PRIVATE_PREFIX}')) AS ips FROM d_headers WHERE lower(name) = 'received')
    SELECT case_id, arg_max(ips[1], pos) AS origin_ip FROM f WHERE len(ips) > 0 GROUP BY case_id""")
def h15(src):
    return op.legacy_origin(src.d_headers)


@query("h16_legacy_identity_flags", f"""SELECT case_id, concat_ws('; ',
      CASE WHEN {o.dom('reply_to')} <> {o.dom('from_addr')} THEN 'Reply-To domain (' || {o.dom('reply_to')} || ') differs from From domain (' || {o.dom('from_addr')} || ')' END,
      CASE WHEN {o.dom('return_path')} <> {o.dom('from_addr')} THEN 'Return-Path domain (' || {o.dom('return_path')} || ') differs from From domain (' || {o.dom('from_addr')} || ')' END) AS flags
    FROM d_cases""")
def h16(src):
    return op.legacy_identity_flags(src.d_cases).withColumn("flags", F.array_join("flags", "; "))


def _off(d):
    f = o.dom("from_addr")
    return f"coalesce(NOT ({d} = {f} OR {d} LIKE '%.' || {f} OR {f} LIKE '%.' || {d}), false)"


@query("h17_alignment_view", f"""SELECT case_id, {_off(o.dom('reply_to'))} AS reply_mismatch, {_off(o.dom('return_path'))} AS return_mismatch,
    NOT {_off(o.dom('reply_to'))} AND NOT {_off(o.dom('return_path'))} AS aligned FROM d_cases""")
def h17(src):
    return op.alignment_view(src.d_cases)


@query("h18_hop_timeline", """WITH s AS (SELECT case_id, ts, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY case_id) AS n
      FROM d_hops WHERE ts IS NOT NULL)
    SELECT case_id, CAST(max(ts) FILTER (i = 1) AS STRING) AS origin_sent, CAST(max(ts) FILTER (i = n // 2 + 1) AS STRING) AS relayed,
      CAST(max(ts) FILTER (i = n) AS STRING) AS delivered FROM s GROUP BY case_id""")
def h18(src):
    return op.hop_timeline(src.d_hops).select("case_id", _text("origin_sent"), _text("relayed"), _text("delivered"))


_STEPS = """st AS (SELECT case_id, seq, ts, lag(ts) OVER (PARTITION BY case_id ORDER BY seq) AS before FROM d_hops WHERE ts IS NOT NULL),
    tail AS (SELECT *, min(CASE WHEN from_ip IS NULL OR bad THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS in_tail FROM hx)"""


@query("u_header_lane", f"""{_H}, {_STEPS}, pa AS (SELECT case_id, seq, {o.org('from_host')} AS org FROM d_hops WHERE from_host LIKE '%.%'),
    pp AS (SELECT * FROM (SELECT *, lag(org) OVER (PARTITION BY case_id ORDER BY seq) AS prev FROM pa WHERE org IS NOT NULL) WHERE prev IS NULL OR prev <> org),
    md AS (SELECT case_id, {_MID} AS mid, {o.dom('from_addr')} AS d FROM d_cases WHERE message_id IS NOT NULL),
    rl AS (SELECT case_id, by_host AS host FROM d_hops UNION ALL SELECT case_id, from_host FROM d_hops),
    found AS (SELECT case_id, 'forged_received_hop' AS signal FROM hx WHERE forged
      UNION SELECT case_id, 'private_ip_in_public_chain' FROM tail WHERE in_tail = 0 AND bad AND NOT forged
      UNION SELECT case_id, 'timestamp_regression' FROM st WHERE ts < before
      UNION SELECT case_id, 'reply_to_domain_mismatch' FROM d_cases WHERE reply_to IS NOT NULL AND NOT {o.same(o.dom('from_addr'), o.dom('reply_to'))}
      UNION SELECT case_id, 'fake_reply' FROM d_cases WHERE regexp_matches(trim(subject), '(?i)^\\s*(re|fwd|fw)\\s*(\\[\\d+\\])?\\s*:')
        AND case_id NOT IN (SELECT case_id FROM d_headers WHERE lower(name) IN ('in-reply-to', 'references'))
      UNION SELECT case_id, 'message_id_domain_divergence' FROM md WHERE NOT {o.same('mid', 'd')}
        AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.case_id = md.case_id AND rl.host IS NOT NULL AND {o.same('mid', 'rl.host')})
      UNION SELECT case_id, 'chain_discontinuity' FROM (SELECT case_id, org FROM pp GROUP BY 1, 2 HAVING count(*) > 1)),
    names AS (SELECT DISTINCT signal FROM found)
    SELECT c.case_id, n.signal, CASE WHEN f.case_id IS NULL THEN 'CLEAR' ELSE 'TRIGGERED' END AS status
    FROM d_cases c CROSS JOIN (VALUES ('forged_received_hop'), ('private_ip_in_public_chain'), ('timestamp_regression'), ('reply_to_domain_mismatch'),
      ('fake_reply'), ('message_id_domain_divergence'), ('chain_discontinuity')) AS n(signal) LEFT JOIN found f ON f.case_id = c.case_id AND f.signal = n.signal""")
def header_lane(src):
    """The lane in one go: every case with all seven signals."""
    return op.header_lane(src.d_cases, src.d_headers, src.d_hops, suffixes=src.suffixes).select("case_id", "signal", "status")
