"""Queries F01-F06."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators import footprint as op
from . import oracle_parts as o
from .registry import query

YEAR = 2024


@query("f01_disposable_sender", f"SELECT case_id, from_addr FROM d_cases WHERE {o.dom('from_addr')} IN ({o.words(fx.DISPOSABLE_DOMAINS)})")
def f01(src):
    return src.d_cases.filter(op.disposable(F.col("from_addr"))).select("case_id", "from_addr")


_BULK = " OR ".join(f"contains(lower(name), '{a}')" for a in fx.BREACH_AGGREGATORS)
_PLAT = f"""pl AS (SELECT email, arg_min(trim(name), seq) AS platform FROM d_breaches WHERE NOT ({_BULK}) GROUP BY email, lower(trim(name)))"""


@query("f02_breach_platforms", f"WITH {_PLAT} SELECT * FROM pl")
def f02(src):
    return op.breach_platforms(src.d_breaches)


_SUM = f"""su AS (SELECT email, count(*) AS breach_count, min(breach_date) AS earliest, max(breach_date) AS latest, greatest(0, {YEAR} - year(min(breach_date))) AS age_years FROM d_breaches GROUP BY email)"""


@query("f03_breach_summary", f"WITH {_SUM} SELECT email, breach_count, CAST(earliest AS STRING) AS earliest, CAST(latest AS STRING) AS latest, age_years FROM su")
def f03(src):
    s = op.breach_summary(src.d_breaches, YEAR)
    return s.withColumn("earliest", F.col("earliest").cast("string")).withColumn("latest", F.col("latest").cast("string"))


_REG = f"""{_PLAT}, ra AS (SELECT email, platform, status, source, seq FROM d_registrations UNION ALL SELECT email, platform, 'registered', 100, 0 FROM pl),
    rg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email, platform ORDER BY status <> 'registered', source, seq) AS rn FROM ra) WHERE rn = 1)"""


@query("f04_merged_registrations", f"WITH {_REG} SELECT email, platform, status, source FROM rg")
def f04(src):
    return op.merged_registrations(src.d_registrations, op.breach_platforms(src.d_breaches))


_FACT = f"""{_REG}, {_SUM}, rc AS (SELECT email, count(*) AS n FROM rg WHERE status = 'registered' GROUP BY email),
    x AS (SELECT c.case_id, c.from_addr, {o.dom('from_addr')} IN ({o.words(fx.DISPOSABLE_DOMAINS)}) AS disp, coalesce(rc.n, 0) AS reg, coalesce(su.breach_count, 0) AS br, su.age_years AS age
      FROM d_cases c LEFT JOIN rc ON rc.email = c.from_addr LEFT JOIN su ON su.email = c.from_addr),
    cr AS (SELECT *, CASE WHEN reg >= 1 OR br > 0 OR age >= 2 THEN CASE WHEN (reg >= 3 OR br >= 5) AND coalesce(age >= 2, false) THEN 'established_sender_identity' ELSE 'known_footprint_sender' END END AS credit FROM x)"""


def _lane(src):
    return op.footprint_lane(src.d_cases, op.footprint_facts(src.d_breaches, src.d_registrations, YEAR))


@query("f05_footprint_lane", f"""WITH {_FACT} SELECT case_id, 'disposable_sender_domain' AS signal, 'TRIGGERED' AS status FROM cr WHERE disp
    UNION ALL SELECT case_id, CASE WHEN reg > 0 THEN 'sender_email_footprint' ELSE 'sender_no_footprint' END, 'CLEAR' FROM cr
    UNION ALL SELECT case_id, credit, 'TRIGGERED' FROM cr WHERE credit IS NOT NULL""")
def f05(src):
    return _lane(src).select("case_id", "signal", "status")


@query("f06_identity_credits", f"WITH {_FACT} SELECT from_addr AS email, credit, max(reg) AS registered_count, max(br) AS breach_count FROM cr WHERE credit IS NOT NULL GROUP BY 1, 2")
def f06(src):
    f = op.footprint_facts(src.d_breaches, src.d_registrations, YEAR).withColumn("credit", op.identity_credit()).filter("credit is not null")
    senders = src.d_cases.select(F.col("from_addr").alias("email")).distinct()
    return f.join(senders, "email").select("email", "credit", "registered_count", "breach_count")
