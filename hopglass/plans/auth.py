"""Queries A01-A09."""

from pyspark.sql import functions as F

from ..operators import auth as op, headers as hd
from ..operators.dims import EARLIER
from . import oracle_parts as o
from .registry import query

_word = lambda m: f"coalesce(nullif(lower(regexp_extract(value, '(?i){m}=(\\w+)', 1)), ''), 'not found')"
_FD = o.dom("from_addr")


@query("a01_header_verdicts", f"""SELECT case_id, {_word('spf')} AS spf, {_word('dkim')} AS dkim, {_word('dmarc')} AS dmarc FROM d_headers WHERE lower(name) = 'authentication-results'""")
def a01(src):
    return op.header_verdicts(src.d_headers)


_SIG = "sig AS (SELECT case_id, pos, lower(trim(regexp_extract(value, '(?i)[;\\s]d\\s*=\\s*([^;]+)', 1))) AS domain FROM d_headers WHERE lower(name) = 'dkim-signature')"


@query("a02_signing_domains", f"WITH {_SIG} SELECT * FROM sig WHERE domain <> ''")
def a02(src):
    return op.signing_domains(src.d_headers)


@query("a03_alignment", f"""WITH {_SIG} SELECT s.case_id, s.pos, {o.same('s.domain', o.dom('c.from_addr'))} AS by_org,
    s.domain = {o.dom('c.from_addr')} OR s.domain LIKE '%.' || {o.dom('c.from_addr')} OR {o.dom('c.from_addr')} LIKE '%.' || s.domain AS by_suffix
    FROM sig s JOIN d_cases c ON c.case_id = s.case_id""")
def a03(src):
    j = op.signing_domains(src.d_headers).join(src.d_cases.select("case_id", hd.domain_of(F.col("from_addr")).alias("fd")), "case_id")
    return j.select("case_id", "pos", op.aligned(F.col("domain"), F.col("fd"), suffixes=src.suffixes).alias("by_org"), op.aligned(F.col("domain"), F.col("fd"), EARLIER).alias("by_suffix"))


_DK = f"""{_SIG}, sa AS (SELECT s.*, {o.same('s.domain', o.dom('c.from_addr'))} AS al FROM sig s JOIN d_cases c ON c.case_id = s.case_id),
    sc AS (SELECT case_id, bool_or(al) AS has_al FROM sa GROUP BY case_id),
    ra AS (SELECT r.case_id, bool_or(result = 'pass') AS pass, bool_or(result = 'temperror') AS temp FROM d_auth_results r JOIN d_cases c ON c.case_id = r.case_id
      WHERE mech = 'dkim' AND {o.same('r.domain', o.dom('c.from_addr'))} GROUP BY r.case_id),
    dk AS (SELECT sc.case_id, CASE WHEN ra.pass THEN 'dkim_valid_aligned' WHEN has_al AND (ra.case_id IS NULL OR ra.temp) THEN 'dkim_unavailable' WHEN has_al THEN 'dkim_fail' END AS signal,
      coalesce(ra.pass, false) AS dkim_pass FROM sc LEFT JOIN ra ON ra.case_id = sc.case_id)"""


@query("a04_dkim_decision", f"WITH {_DK} SELECT case_id, signal, dkim_pass FROM dk")
def a04(src):
    return op.dkim_decisions(src.d_cases, src.d_headers, src.d_auth_results, suffixes=src.suffixes).select("case_id", "signal", "dkim_pass")


@query("a04_dkim_first_signature", f"""WITH {_SIG}, f AS (SELECT case_id, arg_min(domain, pos) AS domain FROM sig GROUP BY case_id),
    r AS (SELECT f.case_id, f.domain, coalesce(bool_or(result = 'pass'), false) AS pass FROM f LEFT JOIN d_auth_results a ON a.case_id = f.case_id AND a.mech = 'dkim' AND a.domain = f.domain GROUP BY 1, 2)
    SELECT r.case_id, CASE WHEN pass AND (r.domain = {o.dom('c.from_addr')} OR r.domain LIKE '%.' || {o.dom('c.from_addr')} OR {o.dom('c.from_addr')} LIKE '%.' || r.domain) THEN 'dkim_valid_aligned' WHEN NOT pass THEN 'dkim_fail' END AS signal
    FROM r JOIN d_cases c ON c.case_id = r.case_id""")
def a04_first(src):
    return op.dkim_decisions(src.d_cases, src.d_headers, src.d_auth_results, EARLIER).select("case_id", "signal")


_SPF = f"""{o.hop_ctes()}, m AS (SELECT c.case_id, {o.dom('c.from_addr')} AS fd, coalesce({o.dom('c.return_path')}, {o.dom('c.from_addr')}) AS sd, g.boundary_ip AS bip FROM d_cases c JOIN origin g ON g.case_id = c.case_id AND g.boundary_ip IS NOT NULL),
    so AS (SELECT m.case_id, CASE min(CASE s.result WHEN 'fail' THEN 1 WHEN 'permerror' THEN 2 WHEN 'temperror' THEN 3 WHEN 'softfail' THEN 4 WHEN 'pass' THEN 9 ELSE 5 END)
        WHEN 1 THEN 'fail' WHEN 2 THEN 'permerror' WHEN 3 THEN 'temperror' WHEN 4 THEN 'softfail' WHEN 9 THEN 'pass' ELSE 'neutral' END AS result
      FROM m JOIN d_auth_results s ON s.case_id = m.case_id AND s.mech = 'spf' AND (s.ip IS NULL OR s.ip = m.bip) AND (s.domain IS NULL OR s.domain = m.sd) GROUP BY m.case_id),
    sp AS (SELECT m.case_id, m.sd AS spf_domain, CASE WHEN s.result = 'fail' AND a.result = 'pass' THEN 'arc_authenticated' WHEN s.result = 'fail' THEN 'spf_fail_hard'
        WHEN s.result IN ('temperror', 'permerror') THEN 'spf_unavailable' END AS signal, s.result = 'pass' AND {o.same('m.sd', 'm.fd')} AS spf_pass
      FROM m JOIN so s ON s.case_id = m.case_id LEFT JOIN d_auth_results a ON a.case_id = m.case_id AND a.mech = 'arc')"""


def _spf(src):
    return op.spf_decisions(src.d_cases, hd.relay_facts(src.d_hops), src.d_auth_results, suffixes=src.suffixes)


@query("a05_spf_decision", f"WITH {_SPF} SELECT case_id, spf_domain, signal, spf_pass FROM sp")
def a05(src):
    return _spf(src).select("case_id", "spf_domain", "signal", "spf_pass")


@query("a06_arc_mitigation", f"WITH {_SPF} SELECT signal, count(*) AS n FROM sp WHERE signal IN ('arc_authenticated', 'spf_fail_hard') GROUP BY signal")
def a06(src):
    return _spf(src).filter(F.col("signal").isin("arc_authenticated", "spf_fail_hard")).groupBy("signal").agg(F.count("*").alias("n"))


_POL = f"""dm AS (SELECT DISTINCT {_FD} AS domain FROM d_cases), dp AS (SELECT dm.domain, CASE WHEN e.state = 'found' THEN coalesce(e.p, 'none') WHEN g.state = 'found' THEN coalesce(g.sp, g.p, 'none') END AS policy,
      coalesce(e.state = 'unreachable', false) OR coalesce(g.state = 'unreachable', false) AS down
    FROM dm LEFT JOIN d_dns_policy e ON e.domain = dm.domain LEFT JOIN d_dns_policy g ON g.domain = {o.org('dm.domain')} AND g.domain <> dm.domain)"""


@query("a07_dmarc_policy", f"WITH {_POL} SELECT domain, policy, policy IS NULL AND down AS unavailable FROM dp")
def a07(src):
    return op.dmarc_policies(src.d_cases.select(hd.domain_of(F.col("from_addr")).alias("domain")), src.d_dns_policy, suffixes=src.suffixes)


@query("a07_dmarc_parent_walk", f"""SELECT d.domain, arg_max(coalesce(p, 'none'), length(r.domain)) AS policy FROM (SELECT DISTINCT {_FD} AS domain FROM d_cases) d
    JOIN d_dns_policy r ON r.state = 'found' AND (r.domain = d.domain OR d.domain LIKE '%.' || r.domain) GROUP BY 1""")
def a07_walk(src):
    return op.dmarc_policies(src.d_cases.select(hd.domain_of(F.col("from_addr")).alias("domain")), src.d_dns_policy, EARLIER).select("domain", "policy")


_ALL = f"""{_DK}, {_SPF}, {_POL}, au AS (SELECT c.case_id, sp.signal AS spf, dk.signal AS dkim, CASE WHEN dp.policy IS NULL AND dp.down THEN 'dmarc_unavailable'
      WHEN dp.policy IN ('reject', 'quarantine') AND NOT coalesce(sp.spf_pass, false) AND NOT coalesce(dk.dkim_pass, false) THEN 'dmarc_fail_strict' END AS dmarc
    FROM d_cases c LEFT JOIN sp ON sp.case_id = c.case_id LEFT JOIN dk ON dk.case_id = c.case_id LEFT JOIN dp ON dp.domain = {o.dom('c.from_addr')})"""


def _facts(src):
    return op.auth_facts(src.d_cases, src.d_headers, hd.relay_facts(src.d_hops), src.d_auth_results, src.d_dns_policy, suffixes=src.suffixes)


@query("a08_dmarc_fail_strict", f"WITH {_ALL} SELECT case_id, dmarc AS signal FROM au WHERE dmarc IS NOT NULL")
def a08(src):
    return _facts(src).filter(F.col("dmarc_signal").isNotNull()).select("case_id", F.col("dmarc_signal").alias("signal"))


@query("a09_verification_passed", f"WITH {_ALL} SELECT case_id FROM au WHERE spf IS NULL AND dmarc IS NULL AND coalesce(dkim = 'dkim_valid_aligned', true)")
def a09(src):
    return op.auth_lane(_facts(src)).filter("signal = 'auth_verification_passed'").select("case_id")
