"""Queries N01-N10."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.net import with_routability
from ..operators import network as op
from ..operators.dims import EARLIER, LATEST
from . import oracle_parts as o
from .registry import query

_NUM = o.num("from_ip")
_BOUNDS = f"contains(first_ip, ':') AS six, {o.num('first_ip')} AS lo, {o.num('last_ip')} AS hi"
_RANGES = f"rg AS (SELECT kind, {_BOUNDS} FROM d_ip_ranges WHERE contains(first_ip, ':') = contains(last_ip, ':'))"
_IN = lambda kind: f"EXISTS (SELECT 1 FROM rg WHERE kind = '{kind}' AND rg.six = v.six AND num BETWEEN lo AND hi)"
_MEMBER = f"""{o.hop_ctes()}, {_RANGES}, v AS (SELECT DISTINCT from_ip AS ip, {_NUM} AS num, {o.six('from_ip')} AS six FROM hx WHERE pub),
    fl AS (SELECT v.ip, num, EXISTS (SELECT 1 FROM d_ip_list t WHERE t.ip = v.ip) AS tor, {_IN('vpn')} AS vpn, {_IN('dc')} AS dc FROM v),
    fh AS (SELECT hx.*, fl.tor, fl.vpn, fl.dc, CASE WHEN boundary_seq IS NULL OR seq >= boundary_seq THEN 1.0 ELSE 0.7 END AS conf FROM hx JOIN fl ON fl.ip = hx.from_ip WHERE pub)"""


def _member(flag):
    def run(src):
        hops = op.flagged_hops(src.d_hops, src.d_ip_list, src.d_ip_ranges)
        return hops.filter(flag).select("case_id", "seq", "ip")
    return run


for _name, _flag in (("n01_tor_exit", "tor"), ("n02_vpn_range", "vpn"), ("n03_datacenter_range", "dc")):
    query(_name, f"WITH {_MEMBER} SELECT case_id, seq, from_ip AS ip FROM fh WHERE {_flag}")(_member(_flag))


def _facts(src):
    return op.network_facts(src.d_cases, src.d_hops, src.d_ip_list, src.d_ip_ranges)


@query("n04_origin_anonymized", f"""WITH {_MEMBER} SELECT case_id, arg_min(from_ip, seq) AS ip, min(seq) AS seq,
    arg_min(CASE WHEN tor THEN 'Tor exit node' ELSE 'known VPN range' END, seq) AS classification, arg_min(conf, seq) AS confidence
    FROM fh WHERE tor OR vpn GROUP BY case_id""")
def n04(src):
    return _facts(src).filter(F.col("anon").isNotNull()).select("case_id", "anon.*")


_DC = "og AS (SELECT fh.case_id, from_ip AS ip, conf AS confidence, dc FROM fh JOIN origin g ON g.case_id = fh.case_id AND g.origin_seq = fh.seq)"


@query("n05_origin_datacenter", f"WITH {_MEMBER}, {_DC} SELECT case_id, ip, confidence FROM og WHERE dc")
def n05(src):
    return _facts(src).filter("origin.dc").select("case_id", "origin.ip", "origin.confidence")


@query("n06_provider_withholds_origin", f"""WITH {_MEMBER} SELECT case_id, {o.dom('from_addr')} AS provider FROM d_cases
    WHERE case_id NOT IN (SELECT case_id FROM fh) AND {o.dom('from_addr')} IN ({o.words(fx.WEBMAIL_WITHHOLDING)})""")
def n06(src):
    lane = op.network_lane(_facts(src))
    return (lane.filter("signal = 'provider_withholds_origin'").select("case_id", F.get_json_object("detail", "$.provider").alias("provider")))


_PER = f"""{_MEMBER}, {_DC}, an AS (SELECT DISTINCT case_id FROM fh WHERE tor OR vpn), rt AS (SELECT DISTINCT case_id FROM fh),
    x AS (SELECT c.case_id, c.case_id IN (SELECT case_id FROM rt) AS has, c.case_id IN (SELECT case_id FROM an) AS an, c.case_id IN (SELECT case_id FROM og WHERE dc) AS dc,
      coalesce({o.dom('c.from_addr')} IN ({o.words(fx.WEBMAIL_WITHHOLDING)}), false) AS wm FROM d_cases c)"""


def _lane_oracle(parts):
    return f"WITH {_PER} SELECT signal, status, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{sig}' AS signal, '{st}' AS status FROM x WHERE {cond}" for sig, st, cond in parts) + ") GROUP BY 1, 2"


def _count(lane):
    return lane.groupBy("signal", "status").agg(F.count("*").alias("n"))


@query("n07_network_lane", _lane_oracle([
    ("provider_withholds_origin", "TRIGGERED", "NOT has AND wm"), ("origin_anonymized", "CLEAR", "NOT has AND NOT wm"),
    ("origin_anonymized", "TRIGGERED", "has AND an"), ("origin_datacenter_hosted", "TRIGGERED", "has AND dc"),
    ("origin_anonymized", "CLEAR", "has AND NOT an AND NOT dc")]))
def n07(src):
    return _count(op.network_lane(_facts(src)))


@query("n07_datacenter_list_missing", _lane_oracle([
    ("provider_withholds_origin", "TRIGGERED", "NOT has AND wm"), ("origin_anonymized", "CLEAR", "NOT has AND NOT wm"),
    ("origin_anonymized", "TRIGGERED", "has AND an"), ("origin_anonymized", "UNAVAILABLE", "has AND NOT an")]))
def n07_partial(src):
    return _count(op.network_lane(_facts(src), has_dc=False))


@query("n07_no_intel_earlier_rules", _lane_oracle([("origin_anonymized", "UNAVAILABLE", "true")]))
def n07_none(src):
    return _count(op.network_lane(_facts(src), False, False, False, version=EARLIER))


GEO = f"""gg AS (SELECT country, city, lat, lon, {_BOUNDS} FROM d_geo_ranges),
    pl AS (SELECT * FROM (SELECT v.ip, gg.*, row_number() OVER (PARTITION BY v.ip ORDER BY hi - lo, lo) AS rn FROM v JOIN gg ON gg.six = v.six AND num BETWEEN lo AND hi) WHERE rn = 1)"""


@query("n08_geo", f"WITH {_MEMBER}, {GEO} SELECT ip, country, city, lat, lon FROM pl")
def n08(src):
    ips = with_routability(src.d_hops, "from_ip").filter("public").select(F.col("from_ip").alias("ip"))
    return op.geo_lookup(ips, src.d_geo_ranges)


@query("q03_relay_trace", f"""WITH {_MEMBER}, {GEO} SELECT hx.case_id, hx.seq, boundary_seq, trust, from_ip, by_host, country, city, lat, lon
    FROM hx LEFT JOIN pl ON pl.ip = hx.from_ip AND hx.pub""")
def q03(src):
    """The hop rows of every case with trust and place."""
    return op.hop_trace(src.d_hops, src.d_geo_ranges).select("case_id", "seq", "boundary_seq", "trust", "from_ip", "by_host", "country", "city", "lat", "lon")


@query("n02_unreadable_ranges", f"SELECT kind, first_ip, last_ip FROM d_ip_ranges WHERE contains(first_ip, ':') <> contains(last_ip, ':') OR {o.num('first_ip')} IS NULL OR {o.num('last_ip')} IS NULL")
def n02_unreadable(src):
    return op.unreadable_ranges(src.d_ip_ranges)


_SCORE = """least(95, 8 + CASE WHEN tor THEN 62 ELSE 0 END + CASE WHEN vpn THEN 24 ELSE 0 END + CASE WHEN dc THEN 18 ELSE 0 END + CASE WHEN bad THEN 40 ELSE 0 END)"""
_REP = f"""{_RANGES}, v AS (SELECT DISTINCT from_ip AS ip, {_NUM} AS num, {o.bad_ip('from_ip')} AS bad, {o.six('from_ip')} AS six FROM d_hops WHERE from_ip IS NOT NULL),
    fl AS (SELECT ip, bad, EXISTS (SELECT 1 FROM d_ip_list t WHERE t.ip = v.ip) AS tor, {_IN('vpn')} AS vpn, {_IN('dc')} AS dc FROM v),
    sc AS (SELECT ip, {_SCORE} AS score FROM fl)"""
_RISK = "CASE WHEN score >= 70 THEN 'High' WHEN score >= 35 THEN 'Medium' ELSE 'Low' END AS risk"


def _heuristic(src):
    ips = src.d_hops.filter(F.col("from_ip").isNotNull()).select(F.col("from_ip").alias("ip"))
    return op.reputation(ips, src.d_ip_list, src.d_ip_ranges)


@query("n09_reputation", f"WITH {_REP} SELECT ip, score, {_RISK} FROM sc")
def n09(src):
    return _heuristic(src).select("ip", "score", "risk")


@query("n10_reputation_feed", f"""WITH {_REP}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY fetched_at DESC, feed_score DESC) AS rn FROM d_feed
      WHERE fetched_at > TIMESTAMP '2024-01-20 06:00:00' AND fetched_at <= TIMESTAMP '2024-01-20 12:00:00') WHERE rn = 1),
    j AS (SELECT sc.ip, coalesce(f.feed_score, sc.score) AS score, CASE WHEN f.ip IS NULL THEN 'heuristic' ELSE 'feed' END AS source,
      CASE WHEN CASE WHEN f.ip IS NULL THEN sc.score >= 70 ELSE f.total_reports >= 20 END THEN 'High' ELSE 'Low' END AS recent_abuse FROM sc LEFT JOIN f ON f.ip = sc.ip)
    SELECT ip, score, source, recent_abuse, {_RISK} FROM j""")
def n10(src):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return op.reputation_with_feed(_heuristic(src), src.d_feed, as_of).select("ip", "score", "source", "recent_abuse", "risk")
