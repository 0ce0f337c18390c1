"""Queries C01-C19."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fx, text as tx
from ..operators import content as op
from ..operators.dims import EARLIER, LATEST
from ..sources import urls as su
from . import oracle_parts as o
from .registry import query

q = o.lit
_NF = lambda x: f"translate(coalesce({x}, ''), 'ｖｅｒｉｆｙ', 'verify')"
_INV = f"[{fx.INVISIBLE}]"
_CANON = lambda x: f"lower(translate(regexp_replace({_NF(x)}, '{_INV}', '', 'g'), '{fx.TEXT_CONFUSABLE_FROM}', '{fx.TEXT_CONFUSABLE_TO}'))"
_NORM = lambda x: f"regexp_replace({_NF(x)}, '[{fx.ZERO_WIDTH}]', '', 'g')"
_M = lambda x, p: f"regexp_matches({x}, {q('(?i)' + p)})"
_BOTH = "coalesce(subject, '') || ' ' || coalesce(body_text, '')"


def _digest(c):
    return F.md5(c.cast("binary"))


@query("c01_canonical", f"SELECT case_id, md5({_CANON('body_text')}) AS digest FROM d_messages")
def c01(src):
    return src.d_messages.select("case_id", _digest(tx.canonical(F.col("body_text"))).alias("digest"))


@query("c02_strip_invisible", f"SELECT case_id, length(regexp_replace(body_text, '{_INV}', '', 'g')) AS n FROM d_messages")
def c02(src):
    return src.d_messages.select("case_id", F.length(tx.strip_invisible(F.col("body_text"))).alias("n"))


_MIX = f"""list_filter(string_split_regex({_BOTH}, '\\s+'), lambda w: CAST(regexp_matches(w, '\\p{{Latin}}') AS INT) + CAST(regexp_matches(w, '\\p{{Cyrillic}}') AS INT) + CAST(regexp_matches(w, '\\p{{Greek}}') AS INT) > 1)"""
_RUNS = f"len(regexp_extract_all({_BOTH}, '[\\p{{L}}\\p{{N}}_]{_INV}+[\\p{{L}}\\p{{N}}_]'))"


def _text(src):
    return src.d_messages.select("case_id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit(""))).alias("t"))


@query("c03_mixed_script_words", f"SELECT case_id, unnest({_MIX}) AS word FROM d_messages")
def c03(src):
    return _text(src).select("case_id", F.explode(tx.mixed_script_words(F.col("t"))).alias("word"))


_REP = f"SELECT case_id, len({_MIX}) AS mixed, array_to_string({_MIX}, ' ') AS words, {_RUNS} AS runs, len({_MIX}) > 0 OR {_RUNS} > 0 AS obfuscated FROM d_messages"


@query("c04_obfuscation_report", _REP)
def c04(src):
    r = tx.with_obfuscation_report(_text(src), "t", "r")
    return r.select("case_id", F.col("r.mixed_script_count").alias("mixed"), F.array_join("r.mixed_script_words", " ").alias("words"), F.col("r.invisible_runs").alias("runs"), "r.obfuscated")


def _lane(src, version=LATEST):
    links = op.link_domains_of(su.extract_urls(src.d_messages))
    return op.content_lane(src.d_messages.join(links, "case_id", "left"), version=version, suffixes=src.suffixes)


def _hits(lane, signal):
    return lane.filter((F.col("signal") == signal) & (F.col("status") == "TRIGGERED")).select("case_id")


@query("c05_obfuscated_text", f"SELECT case_id FROM ({_REP}) WHERE obfuscated")
def c05(src):
    return _hits(_lane(src), "obfuscated_text")


_STYLE = fx.HIDDEN_ELEMENT_PATTERN.split(r"[^>]*?", 1)[1].split(r"[^>]*>([\s\S]*?)")[0]
_INNER = lambda tag: f"regexp_extract_all(body_html, {q('(?i)<' + tag + '\\b[^>]*?' + _STYLE + '[^>]*>([^<]*(?:<b>[^<]*</b>[^<]*)?)</' + tag)}, 1)"
_CLEANTAG = "trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HID = f"""hid AS (SELECT *, trim(array_to_string(list_filter(list_transform(list_concat(list_concat({_INNER('p')}, {_INNER('div')}), {_INNER('span')}), lambda x: {_CLEANTAG}), lambda x: x <> ''), ' ')) AS hidden FROM d_messages)"""


@query("c06_hidden_text", f"WITH {_HID} SELECT case_id, hidden FROM hid WHERE hidden <> ''")
def c06(src):
    return op.with_texts(src.d_messages).filter("hidden <> ''").select("case_id", "hidden")


_ALNUM = "length(regexp_replace(hidden, '[^A-Za-z0-9]', '', 'g'))"
_ATTACK = " OR ".join(_M("hidden", p) for p in [fx.INJECTION_PATTERN, fx.HARVEST_PATTERN, fx.ACCOUNT_THREAT_PATTERN, *fx.PAYMENT_PATTERNS, fx.HIDDEN_MISC_PATTERN])


@query("c07a_hidden_text_any", f"WITH {_HID} SELECT case_id FROM hid WHERE length(regexp_replace(hidden, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 15 OR len(regexp_extract_all(body_text, '[{fx.ZERO_WIDTH}]')) >= 5")
def c07a(src):
    return _hits(_lane(src, EARLIER), "hidden_text_mismatch")


@query("c07b_hidden_attack", f"WITH {_HID} SELECT case_id FROM hid WHERE {_ALNUM} >= 15 AND ({_ATTACK})")
def c07b(src):
    return _hits(_lane(src), "hidden_text_mismatch")


_URL = r"https?://[^\s<>\"'')\]},]+"
_HOST = lambda u: f"lower(regexp_extract({u}, '(?i)^https?://(?:[^/?#]*@)?([^/:?#]+)', 1))"
_LK = f"""lk AS (SELECT case_id, list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(body_html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']?(http[^"''\\s>]+)', 1),
      regexp_extract_all(body_text, '(?i){_URL}')), lambda u: {_HOST('u')}), lambda h: h <> '')) AS hosts FROM d_messages)"""
_FDM = o.dom("m.from_addr")
_OFFX = f"""off AS (SELECT m.case_id, m.from_addr, m.subject, m.body_text, lk.hosts, CASE WHEN from_addr IS NULL THEN len(hosts) > 0 ELSE
      len(list_filter(hosts, lambda h: NOT (h = {_FDM} OR h LIKE '%.' || {_FDM} OR {_FDM} LIKE '%.' || h OR coalesce({o.org('h')}, h) = coalesce({o.org(_FDM)}, {_FDM})))) > 0 END AS off
    FROM d_messages m JOIN lk ON lk.case_id = m.case_id)"""
_SHORT = "length(trim(regexp_replace(coalesce(body_text, ''), 'https?://\\S+', '', 'g'))) < 20 AND len(hosts) > 0"


@query("c08_links_no_text", f"WITH {_LK}, {_OFFX} SELECT case_id, off AS off_organisation FROM off WHERE {_SHORT}")
def c08(src):
    any_link = _hits(_lane(src, EARLIER), "links_no_text")
    off = _hits(_lane(src), "links_no_text").withColumn("off_organisation", F.lit(True))
    return any_link.join(off, "case_id", "left").select("case_id", F.coalesce("off_organisation", F.lit(False)).alias("off_organisation"))


def _linked(src):
    links = op.link_domains_of(su.extract_urls(src.d_messages))
    return op.link_facts(src.d_messages.join(links, "case_id", "left"), suffixes=src.suffixes)


@query("c09_off_organisation_link", f"WITH {_LK}, {_OFFX} SELECT case_id, off FROM off")
def c09(src):
    return _linked(src).select("case_id", F.col("off_domain").alias("off"))


_OBF = f"(len({_MIX}) > 0 OR {_RUNS} > 0)"
_NH, _NV = _NORM("hidden"), _NORM("body_text")
_CLS = f"""{_HID}, ct AS (SELECT *, {_NV} || CASE WHEN hidden <> '' THEN chr(10) || chr(10) || '{fx.HIDDEN_SECTION_MARK}' || chr(10) || {_NH} ELSE '' END
      || CASE WHEN {_OBF} THEN chr(10) || chr(10) || '{fx.FOLDED_SECTION_MARK}' || chr(10) || {_CANON(_NV + " || ' ' || " + _NH)} ELSE '' END AS ctext FROM hid),
    tx AS (SELECT *, {_CANON("coalesce(subject, '') || ' ' || ctext")} AS t, {_CANON("coalesce(from_display_name, '') || ' ' || coalesce(subject, '') || ' ' || ctext")} AS nt FROM ct)"""
_cnt = lambda words: " + ".join(f"CAST(contains(t, {q(w)}) AS INT)" for w in words)
_any = lambda words: "(" + " OR ".join(f"contains(t, {q(w)})" for w in words) + ")"


@query("c10_keyword_classifier", f"""WITH {_CLS} SELECT case_id, round(least(0.95, ({_cnt(fx.KEYWORDS_PHISHING)}) / {len(fx.KEYWORDS_PHISHING)}.0 * 0.5), 6) AS score,
    {_any(fx.KEYWORDS_CREDENTIAL)} AS credential, {_any(fx.KEYWORDS_PAYMENT)} AS payment, {_any(fx.KEYWORDS_EXECUTIVE)} AS executive FROM tx""")
def c10(src):
    return op.classified(src.d_messages, EARLIER).select("case_id", F.round("phishing_score", 6).alias("score"), "credential", "payment", "executive")


_INT = f"""{_CLS}, i1 AS (SELECT *, {_M('t', fx.ACCOUNT_THREAT_PATTERN)} AS threat, {_M('t', fx.HARVEST_PATTERN)} AS harvest, {' OR '.join(_M('t', p) for p in fx.PAYMENT_PATTERNS)} AS payment,
      {_M('nt', fx.EXECUTIVE_PATTERN)} AND {_M('t', fx.EXECUTIVE_ASK_PATTERN)} AS executive, {_M('t', fx.GIFT_CARD_PATTERN)} AS gift FROM tx),
    i2 AS (SELECT *, NOT (threat OR harvest OR payment OR executive OR gift) AND {_M('t', fx.LEGIT_FLOW_PATTERN)} AND ({_M('t', fx.REASSURE_PATTERN)} OR {_M('t', fx.CODE_PATTERN)}) AS transactional,
      ({_cnt(fx.PHISHING_PHRASES)}) / {len(fx.PHISHING_PHRASES)}.0 AS share FROM i1),
    i3 AS (SELECT *, CASE WHEN harvest OR payment OR executive OR gift THEN greatest(share, 0.72) WHEN threat THEN greatest(share, 0.66) ELSE share END AS raised FROM i2),
    i4 AS (SELECT *, CAST(CASE WHEN transactional THEN least(raised, 0.1) ELSE least(0.95, raised) END AS DOUBLE) AS score, harvest OR (NOT transactional AND threat) AS credential FROM i3)"""


@query("c11_intents", f"WITH {_INT} SELECT case_id, threat, harvest, payment, executive, gift FROM i4")
def c11(src):
    return op.classified(src.d_messages).select("case_id", "threat", "harvest", "payment", "executive", "gift")


@query("c12_transactional", f"WITH {_INT} SELECT case_id FROM i4 WHERE transactional")
def c12(src):
    return op.classified(src.d_messages).filter("transactional").select("case_id")


@query("c13_phishing_score", f"WITH {_INT} SELECT case_id, round(score, 6) AS score FROM i4")
def c13(src):
    return op.classified(src.d_messages).select("case_id", F.round("phishing_score", 6).alias("score"))


@query("c14_classifier_high", f"WITH {_INT} SELECT case_id, round(score, 6) AS confidence FROM i4 WHERE score >= {fx.CLASSIFIER_THRESHOLD}")
def c14(src):
    e = _lane(src).filter("signal = 'classifier_phishing_high'")
    return e.select("case_id", F.round("confidence", 6).alias("confidence"))


_KEY = "sha256(coalesce(subject, '') || ':' || ctext)"


@query("c15_model_scores", f"""WITH {_INT}, ms AS (SELECT DISTINCT {_KEY} AS k, length(ctext) % 5 / 5.0 AS phishing FROM i4 WHERE length(ctext) % 3 = 0)
    SELECT case_id, round(coalesce(ms.phishing, score), 6) AS score, CASE WHEN ms.k IS NULL THEN 'heuristic' ELSE 'model' END AS source FROM i4 LEFT JOIN ms ON ms.k = {_KEY}""")
def c15(src):
    key = op.content_key(F.col("subject"), F.col("classifier_text"))
    n = F.length("classifier_text")
    scores = (op.with_texts(src.d_messages).filter(n % 3 == 0).select(key.alias("content_key"), (n % 5 / 5).alias("phishing"))
              .distinct().withColumns({c: F.lit(False) for c in ("credential", "payment", "executive", "gift")}))
    return op.classified(src.d_messages, model_scores=scores).select("case_id", F.round("phishing_score", 6).alias("score"), "source")


@query("c16_classifier_text", f"WITH {_CLS} SELECT case_id, md5(ctext) AS digest FROM ct")
def c16(src):
    return op.with_texts(src.d_messages).select("case_id", _digest(F.col("classifier_text")).alias("digest"))


@query("c17_off_domain_sign_in", f"""WITH {_INT}, {_LK}, {_OFFX} SELECT i4.case_id, off AND {_M(_CANON("coalesce(i4.subject, '') || ' ' || coalesce(i4.body_text, '')"), fx.SIGNIN_PATTERN)} AS off_domain_login
    FROM i4 JOIN off ON off.case_id = i4.case_id WHERE credential OR (off AND {_M(_CANON("coalesce(i4.subject, '') || ' ' || coalesce(i4.body_text, '')"), fx.SIGNIN_PATTERN)})""")
def c17(src):
    e = _lane(src).filter("signal = 'credential_harvest_intent'")
    return e.select("case_id", (F.get_json_object("detail", "$.off_domain_login") == "true").alias("off_domain_login"))


_ATT = f"""att AS (SELECT *, regexp_extract(lower(coalesce(filename, '')), '\\.([a-z0-9]{{1,6}})$', 1) AS ext FROM d_attachments),
    bad AS (SELECT case_id, pos, coalesce(filename, '(unnamed)') AS filename, CASE WHEN ext IN ({o.words(fx.DANGEROUS_EXTENSIONS)}) THEN
        CASE WHEN regexp_matches(lower(filename), {q(fx.DOUBLE_EXTENSION_PATTERN)}) THEN 'double extension (' || ext || ')' ELSE '.' || ext || ' executable/script' END
      WHEN {_M('content_type', fx.DANGEROUS_CONTENT_TYPE_PATTERN)} THEN 'content-type ' || content_type END AS reason FROM att)"""


def _attachments(src):
    active = F.when(F.col("has_active"), F.array(F.lit("<script>x</script>"))).otherwise(F.array().cast("array<string>"))
    return op.attachment_findings(src.d_attachments.withColumn("active_content", active))


@query("c18_dangerous_attachment", f"WITH {_ATT} SELECT case_id, arg_min(filename, pos) AS filename, arg_min(reason, pos) AS reason FROM bad WHERE reason IS NOT NULL GROUP BY case_id")
def c18(src):
    return _attachments(src).filter("dangerous is not null").select("case_id", "dangerous.filename", "dangerous.reason")


@query("c19_active_svg_attachment", "SELECT case_id, arg_min(coalesce(filename, '(unnamed)'), pos) AS filename FROM d_attachments WHERE has_active GROUP BY case_id")
def c19(src):
    return _attachments(src).filter("active_svg is not null").select("case_id", "active_svg.filename")
