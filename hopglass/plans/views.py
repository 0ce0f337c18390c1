"""Queries Q01-Q24."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators import dims, headers as hd, scoring, views as op
from ..operators.dims import EARLIER, LATEST
from . import oracle_parts as o
from .registry import query

_V = f"WITH {o.verdict_ctes()}"
_text = lambda c: F.col(c).cast("string")
_verdicts = lambda src, version=LATEST: scoring.score_cases(src.d_evidence, version=version)

_LIST = """SELECT l.owner, l.case_id, coalesce(nullif(l.subject, ''), '(no subject)') AS subject, l.from_addr, l.score, l.band, CAST(l.confidence AS DOUBLE) AS confidence, CAST(l.arrival AS STRING) AS analyzed_at,
    (SELECT count(*) FROM d_urls u WHERE u.case_id = l.case_id) AS urls, (SELECT count(*) FROM d_attachments a WHERE a.case_id = l.case_id) AS attachments"""


def _shown(df):
    return df.withColumn("analyzed_at", _text("analyzed_at"))


@query("q01_list_cases", f"""{_V}, {o.hop_ctes()}, l AS (SELECT v.*, c.owner, c.subject, c.from_addr, c.arrival FROM verdict v JOIN d_cases c ON c.case_id = v.case_id ORDER BY c.arrival DESC, v.case_id LIMIT 200)
    {_LIST}, origin.origin_ip FROM l LEFT JOIN origin ON origin.case_id = l.case_id WHERE band = 'SUSPICIOUS'""")
def q01(src):
    return _shown(op.case_list(_verdicts(src), src.d_cases, src.d_urls, src.d_attachments, hd.relay_facts(src.d_hops), band="SUSPICIOUS"))


@query("q01_list_cases_filter_first", f"""WITH {o.verdict_ctes(EARLIER)}, l AS (SELECT v.*, c.owner, c.subject, c.from_addr, c.arrival FROM verdict v JOIN d_cases c ON c.case_id = v.case_id
      WHERE band = 'SUSPICIOUS' ORDER BY c.arrival DESC, v.case_id LIMIT 200) {_LIST} FROM l""")
def q01_first(src):
    return _shown(op.case_list(_verdicts(src, EARLIER), src.d_cases, src.d_urls, src.d_attachments, band="SUSPICIOUS", version=EARLIER))


@query("q02_case_detail", f"""{_V} SELECT v.case_id, c.subject, c.message_id, CAST((SELECT max(ts) FROM d_hops h WHERE h.case_id = v.case_id) AS STRING) AS received_at,
    (SELECT count(*) FROM d_urls u WHERE u.case_id = v.case_id) AS url_count, (SELECT count(*) FROM d_attachments a WHERE a.case_id = v.case_id) AS attachment_count, v.score, v.band,
    (SELECT arg_min(detail, pos) FROM d_evidence e WHERE e.case_id = v.case_id AND e.signal IN ('sender_email_footprint', 'sender_no_footprint')) AS footprint
    FROM verdict v JOIN d_cases c ON c.case_id = v.case_id""")
def q02(src):
    d = op.case_detail(_verdicts(src), src.d_cases, src.d_hops, src.d_urls, src.d_attachments, src.d_evidence)
    return d.select("case_id", "subject", "message_id", _text("received_at").alias("received_at"), "url_count", "attachment_count", "score", "band", "footprint")


@query("q04_annotated_headers", f"""WITH {o.hop_ctes()}, r AS (SELECT case_id, raw, max(seq) AS hop, arg_max(trust, seq) AS trust FROM hx GROUP BY 1, 2)
    SELECT h.case_id, h.pos, h.name, r.hop, r.trust FROM d_headers h LEFT JOIN r ON r.case_id = h.case_id AND r.raw = h.value""")
def q04(src):
    return op.annotated_headers(src.d_headers, hd.with_trust(src.d_hops)).drop("value")


@query("q05_artifacts", f"""SELECT case_id, 'ip' AS kind, from_ip AS value, min(seq) AS first_hop FROM d_hops WHERE from_ip IS NOT NULL GROUP BY case_id, from_ip
    UNION ALL SELECT case_id, kind, value, NULL FROM (SELECT case_id, 'domain' AS kind, domain AS value FROM d_urls UNION SELECT case_id, 'domain', {o.dom('from_addr')} FROM d_cases
      UNION SELECT case_id, 'url', url FROM d_urls UNION SELECT case_id, 'email', from_addr FROM d_cases UNION SELECT case_id, 'email', reply_to FROM d_cases WHERE reply_to IS NOT NULL
      UNION SELECT case_id, 'email', return_path FROM d_cases WHERE return_path IS NOT NULL UNION SELECT case_id, 'hash', sha256 FROM d_attachments)""")
def q05(src):
    return op.artifacts(src.d_cases, src.d_hops, src.d_urls, src.d_attachments)


def _buckets(version):
    def run(src):
        v = _verdicts(src, version)
        return v.groupBy("band", op.bucket_of(F.col("band"), version).alias("bucket")).agg(F.count("*").alias("n"))
    return run


for _v, _n in ((LATEST, "q06_buckets"), (EARLIER, "q06_buckets_1_3_0")):
    query(_n, f"WITH {o.verdict_ctes(_v)} SELECT band, {o.bucket_case('band', _v)} AS bucket, count(*) AS n FROM verdict GROUP BY 1, 2")(_buckets(_v))

_TT = f"""tt AS (SELECT v.case_id, v.score, v.band, coalesce((SELECT arg_min({o.map_case('k.signal', fx.THREAT_TYPE)}, k.rank) FROM keep k WHERE k.case_id = v.case_id AND k.points > 0 AND k.signal IN ({o.words(fx.THREAT_TYPE)})),
      CASE WHEN EXISTS (SELECT 1 FROM keep k WHERE k.case_id = v.case_id AND k.points > 0) THEN 'Suspicious' ELSE 'Clean' END) AS threat_type FROM verdict v)"""


@query("q07_threat_type", f"{_V}, {_TT} SELECT case_id, threat_type FROM tt")
def q07(src):
    return op.threat_types(_verdicts(src)).select("case_id", "threat_type")


@query("q08_threat_ranking", f"{_V}, {_TT} SELECT threat_type, count(*) AS n FROM tt WHERE score > 0 GROUP BY threat_type ORDER BY n DESC, threat_type")
def q08(src):
    return (op.threat_types(_verdicts(src)).filter("score > 0").groupBy("threat_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "threat_type"))


@query("q09_trend", f"""{_V}, d AS (SELECT CAST(unnest(range(DATE '1997-03-04', DATE '1997-03-11', INTERVAL 1 DAY)) AS DATE) AS day),
    x AS (SELECT CAST(c.arrival AS DATE) AS day, {o.bucket_case('v.band')} AS b FROM verdict v JOIN d_cases c ON c.case_id = v.case_id)
    SELECT CAST(d.day AS STRING) AS day, count(*) FILTER (b = 'critical') AS critical, count(*) FILTER (b = 'high') AS high, count(*) FILTER (b = 'medium') AS medium, count(*) FILTER (b = 'low') AS low
    FROM d LEFT JOIN x ON x.day = d.day GROUP BY d.day""")
def q09(src):
    return op.trend(_verdicts(src), src.d_cases, "1997-03-10").withColumn("day", _text("day"))


@query("q10_recent", f"{_V} SELECT v.case_id, c.subject, v.band, v.score FROM verdict v JOIN d_cases c ON c.case_id = v.case_id ORDER BY c.arrival DESC, v.case_id LIMIT 6")
def q10(src):
    j = _verdicts(src).join(src.d_cases.select("case_id", "subject", "arrival"), "case_id")
    return j.orderBy(F.desc("arrival"), "case_id").limit(6).select("case_id", "subject", "band", "score")


@query("q11_forensic_report", f"""{_V}, n AS (SELECT case_id, string_agg(analyzer || '[' || items || ']', ' ' ORDER BY analyzer) AS entries FROM (SELECT case_id, analyzer,
      string_agg(pos || '|' || signal || '|' || status || '|' || CAST(round_even(confidence * 100, 0) AS INT) || '%|' || detail, ';' ORDER BY pos) AS items FROM d_evidence GROUP BY 1, 2) GROUP BY 1)
    SELECT v.case_id, v.score, {o.map_case('v.band', fx.BAND_SEVERITY)} AS severity, CAST(CAST(round_even(v.confidence * 100, 0) AS INT) AS STRING) || '%' AS confidence, c.from_addr, c.sha256 AS email_sha256, n.entries
    FROM verdict v JOIN d_cases c ON c.case_id = v.case_id JOIN n ON n.case_id = v.case_id""")
def q11(src):
    r = op.forensic_report(_verdicts(src), src.d_cases, src.d_evidence)
    item = lambda i: F.concat_ws("|", i["pos"].cast("string"), i["signal"], i["status"], i["confidence"], i["detail"])
    lane = lambda e: F.concat(e["key"], F.lit("["), F.array_join(F.transform(e["value"], item), ";"), F.lit("]"))
    return r.select("case_id", "score", "severity", "confidence", "from_addr", "email_sha256", F.array_join(F.transform(F.map_entries("evidence"), lane), " ").alias("entries"))


_RF = "rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, analyzer ORDER BY pos) AS n FROM d_evidence WHERE status = 'TRIGGERED') WHERE n <= 3)"


@query("q12_risk_factors", f"WITH {_RF} SELECT case_id, analyzer, n, signal, confidence FROM rf")
def q12(src):
    return op.risk_factors(src.d_evidence).drop("pos")


_REC = lambda items: "'" + "; ".join(items) + "'"


@query("q13_recommendations", f"{_V} SELECT case_id, CASE WHEN score >= 75 THEN {_REC(fx.RECOMMEND_HIGH)} WHEN score >= 50 THEN {_REC(fx.RECOMMEND_MEDIUM)} ELSE {_REC(fx.RECOMMEND_LOW)} END AS recommendations FROM verdict")
def q13(src):
    return _verdicts(src).select("case_id", F.array_join(op.recommendations(F.col("score")), "; ").alias("recommendations"))


_NUMBERED = lambda items: o.lit("\n".join(f"  {i}. {r}" for i, r in enumerate(items, 1)))


@query("q14_report_text", f"""{_V}, {_RF}, f AS (SELECT case_id, string_agg('  • ' || analyzer || ': ' || signal || ' (' || CAST(CAST(round_even(confidence * 100, 0) AS INT) AS STRING) || '%)', chr(10) ORDER BY analyzer, pos) AS t
      FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY analyzer, pos) AS k FROM rf) WHERE k <= 10 GROUP BY case_id)
    SELECT v.case_id, md5(concat_ws(chr(10), repeat('=', 80), 'FORENSIC ANALYSIS REPORT', repeat('=', 80), '', 'Case ID: ' || v.case_id, 'Email SHA256: ' || c.sha256, '', 'VERDICT', repeat('-', 80),
      'Score: ' || v.score || '/100 (' || {o.map_case('v.band', fx.BAND_SEVERITY)} || ')', 'Confidence: ' || CAST(round_even(v.confidence * 100, 0) AS INT) || '%', '', 'SENDER INFORMATION', repeat('-', 80),
      'From: ' || c.from_addr, 'Subject: ' || coalesce(c.subject, 'None'), 'Message-ID: ' || coalesce(c.message_id, 'None'), '', 'RISK FACTORS', repeat('-', 80), f.t, '', 'RECOMMENDATIONS', repeat('-', 80),
      CASE WHEN score >= 75 THEN {_NUMBERED(fx.RECOMMEND_HIGH)} WHEN score >= 50 THEN {_NUMBERED(fx.RECOMMEND_MEDIUM)} ELSE {_NUMBERED(fx.RECOMMEND_LOW)} END, '', repeat('=', 80))) AS digest
    FROM verdict v JOIN d_cases c ON c.case_id = v.case_id LEFT JOIN f ON f.case_id = v.case_id""")
def q14(src):
    r = op.report_text(op.forensic_report(_verdicts(src), src.d_cases, src.d_evidence), op.risk_factors(src.d_evidence))
    return r.select("case_id", F.md5(F.col("report").cast("binary")).alias("digest"))


@query("q15_history_search", f"{_V} SELECT v.case_id, v.band, c.subject FROM verdict v JOIN d_cases c ON c.case_id = v.case_id WHERE (contains(lower(coalesce(c.subject, '')), 'invoice') OR contains(lower(c.from_addr), 'invoice')) AND v.band = 'BENIGN'")
def q15(src):
    return op.history_search(_verdicts(src), src.d_cases, "Invoice", "BENIGN").select("case_id", "band", "subject")


@query("q16_alert_badge", f"""{_V} SELECT c.owner, count(*) AS n, arg_max(v.band, CASE v.band WHEN 'CRITICAL' THEN 3 WHEN 'HIGH_RISK' THEN 2 ELSE 1 END) AS worst
    FROM verdict v JOIN d_cases c ON c.case_id = v.case_id WHERE v.band <> 'BENIGN' AND NOT contains(coalesce(c.subject, ''), 'Report') GROUP BY c.owner""")
def q16(src):
    acked = F.contains(F.coalesce("subject", F.lit("")), F.lit("Report")).alias("acked")
    return op.alert_badge(_verdicts(src).join(src.d_cases.select("case_id", "owner", acked), "case_id"))


@query("q17_lane_coverage", f"{_V} SELECT case_id, 7 - n_lanes AS done, 7 AS total FROM verdict")
def q17(src):
    return op.lane_coverage(_verdicts(src))


_K1 = f"""k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS r1 FROM keep WHERE points > 0) WHERE r1 = 1)"""


@query("q18_report_category", f"""{_V}, {_K1} SELECT v.case_id,
    CASE WHEN v.band = 'BENIGN' OR k.case_id IS NULL THEN 'Clean' ELSE coalesce({o.map_case('k.signal', fx.REPORT_CATEGORY, lambda v: v[0])}, 'Suspicious') END AS category,
    CASE WHEN v.band = 'BENIGN' OR k.case_id IS NULL THEN 'None detected' ELSE coalesce({o.map_case('k.signal', fx.REPORT_CATEGORY, lambda v: v[1])}, 'Undetermined') END AS intent,
    CASE WHEN k.case_id IS NULL THEN NULL WHEN floor(k.points * 100 + 0.5) / 100 >= 15 THEN 'High impact' WHEN floor(k.points * 100 + 0.5) / 100 >= 8 THEN 'Medium impact' ELSE 'Low impact' END AS top_impact
    FROM verdict v LEFT JOIN k1 k ON k.case_id = v.case_id""")
def q18(src):
    return op.report_category(_verdicts(src))


@query("q19_band_shares", f"{_V}, n AS (SELECT {o.bucket_case('band')} AS bucket, count(*) AS n FROM verdict GROUP BY 1) SELECT bucket, n, CAST(floor(n * 100.0 / (SELECT sum(n) FROM n) + 0.5) AS INT) AS percent FROM n")
def q19(src):
    return op.band_shares(_verdicts(src))


@query("q20_auth_badges", """WITH t AS (SELECT case_id, bool_or(status = 'TRIGGERED' AND signal = 'spf_fail_hard') AS s, bool_or(status = 'TRIGGERED' AND signal = 'dkim_fail') AS df,
      bool_or(status = 'TRIGGERED' AND signal = 'dkim_valid_aligned') AS dp, bool_or(status = 'TRIGGERED' AND signal = 'dmarc_fail_strict') AS dm FROM d_evidence GROUP BY case_id)
    SELECT case_id, CASE WHEN s THEN 'FAIL' ELSE 'PASS / n/e' END AS spf, CASE WHEN df THEN 'FAIL' WHEN dp THEN 'PASS' ELSE 'NOT SIGNED' END AS dkim, CASE WHEN dm THEN 'FAIL' ELSE 'PASS / n/e' END AS dmarc FROM t""")
def q20(src):
    return op.auth_badges(src.d_evidence)


@query("q21_rule_health", f"""WITH r AS (SELECT * FROM {o.values_sql([(a, s) for v, s, _, a, _ in dims.rule_rows() if v == LATEST], 't(analyzer, signal)')}),
    d AS (SELECT analyzer, count(*) AS signals_defined FROM r GROUP BY 1), e AS (SELECT analyzer, count(*) AS rows FROM d_evidence GROUP BY 1)
    SELECT coalesce(d.analyzer, e.analyzer) AS analyzer, coalesce(signals_defined, 0) AS signals_defined, coalesce(rows, 0) AS rows, '{LATEST}' AS scorer_version FROM d FULL JOIN e ON e.analyzer = d.analyzer""")
def q21(src):
    return op.rule_health(dims.rules(src.spark), src.d_evidence)


@query("q22_tenant_scope", f"{_V} SELECT v.case_id, v.band FROM verdict v JOIN d_cases c ON c.case_id = v.case_id WHERE c.owner = 'owner3'")
def q22(src):
    return _verdicts(src).join(op.owned(src.d_cases, "owner3").select("case_id"), "case_id").select("case_id", "band")


@query("q23_latest_results", """WITH r AS (SELECT user_id AS msg_id, event_id AS record_id, ts AS seen, event_type FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY seen DESC, record_id DESC) AS n FROM r) WHERE n = 1)
    SELECT msg_id, record_id, event_type FROM l ORDER BY seen DESC, record_id DESC LIMIT 100""")
def q23(src):
    r = src.events.select(F.col("user_id").alias("msg_id"), F.col("event_id").alias("record_id"), F.col("ts").alias("at"), "event_type")
    return op.latest_per_message(r).select("msg_id", "record_id", "event_type")


@query("q24_attachment_flags", """SELECT case_id, pos, coalesce(regexp_matches(lower(filename), '\\.(html?|svg|js|vbs|exe|scr|jar|hta|iso|zip|rar|docm|xlsm)$'), false) AS risky FROM d_attachments""")
def q24(src):
    return src.d_attachments.select("case_id", "pos", op.risky_attachment(F.col("filename")).alias("risky"))


@query("q24_age_labels", """WITH s AS (SELECT event_id, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(ts))) AS BIGINT)) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hr ago' ELSE s // 86400 || ' d ago' END AS age FROM s""")
def q24_age(src):
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return src.events.select("event_id", op.age_label(F.col("ts"), as_of).alias("age"))
