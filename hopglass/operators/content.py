"""Content lane (C01-C19).  Everything is a column expression over the message row,
so the lane adds no shuffle; only the optional model-score lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx, text as tx
from ..functions.domains import SuffixRules, domain_of, registrable
from . import dims
from .evidence import emit, finding, row
from .lookup import join_facts

matches, folded = tx.matches, tx.matches_folded


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def carries_attack(text: Column) -> Column:
    """Does hidden text hold an injection, harvest, threat or payment payload?"""
    return _any(text, [fx.INJECTION_PATTERN, fx.HARVEST_PATTERN, fx.ACCOUNT_THREAT_PATTERN, *fx.PAYMENT_PATTERNS, fx.HIDDEN_MISC_PATTERN])


def off_organisation_link(from_domain: Column, link_domains: Column, suffixes: SuffixRules | None = None) -> Column:
    """Some link leaves the sender's organisation; without a sender any link does."""
    f = F.lower(from_domain)
    org = F.coalesce(registrable(f, suffixes), f)
    dot = lambda a, b: a.endswith(F.concat(F.lit("."), b))
    away = F.exists(link_domains, lambda d: ~((d == f) | dot(d, f) | dot(f, d) | (F.coalesce(registrable(d, suffixes), d) == org)))
    return F.when(F.coalesce(f, F.lit("")) == "", F.size(link_domains) > 0).otherwise(F.coalesce(away, F.lit(False)))


def alnum_count(text: Column, ascii_only: bool) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Za-z0-9]" if ascii_only else r"[^\p{L}\p{N}]", ""))


def with_texts(messages: DataFrame) -> DataFrame:
    """Hidden text, obfuscation report and the classifier input.

    Each text is a column of its own before it is used again, so no regular
    expression runs twice."""
    df = (messages.withColumn("_hidden", tx.hidden_text(F.col("body_html")))
          .withColumn("_both", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit("")))))
    df = tx.with_obfuscation_report(df, "_both")
    df = df.withColumn("hidden", tx.normalized(F.col("_hidden"))).withColumn("visible", tx.normalized(F.col("body_text")))
    df = df.withColumn("_joined", F.when(F.col("report.obfuscated"), F.concat_ws(" ", "visible", "hidden")))
    df = df.withColumn("_folded", tx.canonical(F.col("_joined")))
    section = lambda mark, body: F.concat(F.lit(f"\n\n{mark}\n"), body)
    return tx.settled(df, report=F.col("report"), hidden=F.col("hidden"), visible=F.col("visible"), _both=F.col("_both"), classifier_text=F.concat(
        "visible", F.when(F.col("hidden") != "", section(fx.HIDDEN_SECTION_MARK, F.col("hidden"))).otherwise(""),
        F.when(F.col("report.obfuscated"), section(fx.FOLDED_SECTION_MARK, F.col("_folded"))).otherwise(""))).drop("_hidden", "_joined", "_folded")


def content_key(subject: Column, body: Column) -> Column:
    """Key of stored model answers, over the whole text."""
    return F.sha2(F.concat(F.coalesce(subject, F.lit("")), F.lit(":"), body), 256)


def keyword_scores(df: DataFrame, text: str) -> DataFrame:
    """Keyword-share classifier of the earlier rules."""
    t = F.col(text)
    hits = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    some = lambda words: hits(words) > 0
    n = len(fx.KEYWORDS_PHISHING)
    return (df.withColumn("phishing_score", F.least(F.lit(0.95), hits(fx.KEYWORDS_PHISHING) / n * 0.5))
            .withColumn("credential", some(fx.KEYWORDS_CREDENTIAL)).withColumn("payment", some(fx.KEYWORDS_PAYMENT))
            .withColumn("executive", some(fx.KEYWORDS_EXECUTIVE)).withColumn("gift", F.lit(False)))


def intent_scores(df: DataFrame, text: str, named_text: str) -> DataFrame:
    """Intent patterns, transactional exemption and the phrase score.
    ``named_text`` also holds the display name, where executives are impersonated."""
    t = F.col(text)
    df = tx.settled(df, threat=folded(t, fx.ACCOUNT_THREAT_PATTERN), harvest=folded(t, fx.HARVEST_PATTERN),
                    payment=folded(t, fx.PAYMENT_PATTERNS[0]) | folded(t, fx.PAYMENT_PATTERNS[1]) | folded(t, fx.PAYMENT_PATTERNS[2]),
                    gift=folded(t, fx.GIFT_CARD_PATTERN),
                    executive=folded(F.col(named_text), fx.EXECUTIVE_PATTERN) & folded(t, fx.EXECUTIVE_ASK_PATTERN),
                    legit=folded(t, fx.LEGIT_FLOW_PATTERN) & (folded(t, fx.REASSURE_PATTERN) | folded(t, fx.CODE_PATTERN)),
                    share=sum((F.contains(t, F.lit(p)).cast("int") for p in fx.PHISHING_PHRASES), F.lit(0)) / len(fx.PHISHING_PHRASES))
    hard = F.col("harvest") | F.col("payment") | F.col("executive") | F.col("gift")
    df = df.withColumn("transactional", ~F.col("threat") & ~hard & F.col("legit"))
    raised = F.when(hard, F.greatest(F.lit(0.72), "share")).when(F.col("threat"), F.greatest(F.lit(0.66), "share")).otherwise(F.col("share"))
    return (df.withColumn("phishing_score", F.when(F.col("transactional"), F.least(raised, F.lit(0.1))).otherwise(F.least(F.lit(0.95), raised)))
            .withColumn("credential", F.col("harvest") | (~F.col("transactional") & F.col("threat"))))


def classified(messages: DataFrame, version: str = dims.LATEST, model_scores: DataFrame | None = None) -> DataFrame:
    """Heuristic (or stored model) classification of every message."""
    df = with_texts(messages)
    df = df.withColumn("_input", F.concat_ws(" ", F.coalesce("subject", F.lit("")), "classifier_text"))
    df = df.withColumn("text", tx.canonical(F.col("_input"))).drop("_input")
    if version == dims.EARLIER:
        df = keyword_scores(df, "text")
    else:
        # every fold comes before the first pattern: a fold placed later would make
        # the optimizer merge the stages and repeat the patterns
        df = df.withColumn("_name", tx.canonical(F.col("from_display_name"))).withColumn("_cta", tx.canonical(F.col("_both")))
        df = tx.settled(df, text=F.col("text"), _cta=F.col("_cta"), named_text=F.concat_ws(" ", "_name", "text"))
        df = intent_scores(df, "text", "named_text")
    df = df.withColumn("source", F.lit("heuristic"))
    if model_scores is not None:
        df = df.withColumn("content_key", content_key(F.col("subject"), F.col("classifier_text")))
        m = model_scores.select("content_key", F.struct("phishing", "credential", "payment", "executive", "gift").alias("model"))
        df = join_facts(df, m, "content_key")
        use = F.col("model").isNotNull()
        for c, name in (("phishing_score", "phishing"), ("credential", "credential"), ("payment", "payment"), ("executive", "executive"), ("gift", "gift")):
            df = df.withColumn(c, F.when(use, F.col(f"model.{name}")).otherwise(F.col(c)))
        df = df.withColumn("source", F.when(use, "model").otherwise("heuristic"))
    return df


def link_facts(df: DataFrame, version: str = dims.LATEST, suffixes: SuffixRules | None = None) -> DataFrame:
    """Needs ``link_domains`` on the message row."""
    links = F.coalesce("link_domains", F.array().cast("array<string>"))
    shown = F.length(F.trim(F.regexp_replace(F.coalesce("body_text", F.lit("")), r"https?://\S+", "")))
    df = df.withColumn("link_domains", links).withColumn("visible_text_len", shown)
    df = df.withColumn("off_domain", off_organisation_link(domain_of(F.col("from_addr")), F.col("link_domains"), suffixes))
    has = F.size("link_domains") > 0
    empty = (F.col("visible_text_len") < 20) & has
    return df.withColumn("links_no_text", empty if version == dims.EARLIER else empty & F.col("off_domain"))


def attachment_findings(attachments: DataFrame) -> DataFrame:
    """C18/C19 per case: first dangerous and first active-SVG attachment."""
    name = F.lower(F.coalesce("filename", F.lit("")))
    ext = F.regexp_extract(name, r"\.([a-z0-9]{1,6})$", 1)
    by_ext = ext.isin(fx.DANGEROUS_EXTENSIONS)
    doubled = name.rlike(tx.rx(fx.DOUBLE_EXTENSION_PATTERN))
    by_type = matches(F.col("content_type"), fx.DANGEROUS_CONTENT_TYPE_PATTERN)
    reason = (F.when(by_ext & doubled, F.concat(F.lit("double extension ("), ext, F.lit(")")))
              .when(by_ext, F.concat(F.lit("."), ext, F.lit(" executable/script")))
              .when(by_type, F.concat(F.lit("content-type "), F.col("content_type"))))
    shown = F.coalesce("filename", F.lit("(unnamed)")).alias("filename")
    a = attachments.withColumn("reason", reason)
    return a.groupBy("case_id").agg(
        F.min_by(F.struct(shown, "reason"), F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("dangerous"),
        F.min_by(F.struct(shown, F.col("active_content").alias("samples")), F.when(F.size("active_content") > 0, F.col("pos"))).alias("active_svg"))


def content_lane(messages: DataFrame, attachments: DataFrame | None = None, version: str = dims.LATEST,
                 model_scores: DataFrame | None = None, suffixes: SuffixRules | None = None) -> DataFrame:
    """M4 evidence rows.  ``messages`` carries ``link_domains``."""
    df = link_facts(classified(messages, version, model_scores), version, suffixes)
    if attachments is not None and version == dims.LATEST:
        df = df.join(attachment_findings(attachments), "case_id", "left")
    df = df.withColumn("hidden_count", alnum_count(F.col("hidden"), version == dims.LATEST))
    count = F.col("hidden_count")
    if version == dims.EARLIER:
        zero = F.regexp_count(F.coalesce("body_text", F.lit("")), F.lit(f"[{fx.ZERO_WIDTH}]"))
        hidden_hit = (count >= 15) | (zero >= 5)
    else:
        hidden_hit = (count >= 15) & carries_attack(F.col("hidden"))
    df = df.withColumn("hidden_hit", hidden_hit)
    rows = [
        finding("hidden_text_mismatch", F.col("hidden_hit"), F.struct(count.alias("hidden_char_count"), F.col("hidden").alias("hidden_sample"))),
        finding("obfuscated_text", F.col("report.obfuscated"), F.struct("report.mixed_script_words", "report.invisible_runs")),
        finding("links_no_text", F.col("links_no_text"), F.struct("visible_text_len", F.array_sort("link_domains").alias("link_domains"))),
        row("classifier_phishing_high", "TRIGGERED", F.col("phishing_score"), F.struct("phishing_score", "source"), when=F.col("phishing_score") >= fx.CLASSIFIER_THRESHOLD),
        row("payment_diversion_intent", "TRIGGERED", when=F.col("payment")),
        row("executive_impersonation", "TRIGGERED", when=F.col("executive")),
    ]
    if version == dims.LATEST:
        df = df.withColumn("off_domain_login", folded(F.col("_cta"), fx.SIGNIN_PATTERN) & F.col("off_domain"))
        rows += [row("credential_harvest_intent", "TRIGGERED", 1.0, F.struct("off_domain_login"), when=F.col("credential") | F.col("off_domain_login")),
                 row("gift_card_scam", "TRIGGERED", when=F.col("gift"))]
        if attachments is not None:
            rows += [row("dangerous_attachment", "TRIGGERED", 1.0, F.col("dangerous"), when=F.col("dangerous").isNotNull()),
                     row("active_svg_attachment", "TRIGGERED", 1.0, F.col("active_svg"), when=F.col("active_svg").isNotNull())]
    else:
        rows.append(row("credential_harvest_intent", "TRIGGERED", when=F.col("credential")))
    return emit(df, "M4", rows)


def link_domains_of(urls: DataFrame) -> DataFrame:
    """Distinct link hosts per case, for messages kept apart from their URL table."""
    return urls.filter(F.coalesce(F.col("domain"), F.lit("")) != "").groupBy("case_id").agg(F.sort_array(F.collect_set(F.lower("domain"))).alias("link_domains"))
