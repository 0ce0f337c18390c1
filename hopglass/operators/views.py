"""Query views and analytics over verdicts (Q01-Q24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import domain_of
from . import dims


def bucket_of(band: Column, version: str = dims.LATEST) -> Column:
    out = F.lit("low")
    for b, _, bucket in fx.BANDS[version]:
        out = F.when(band == b, bucket).otherwise(out)
    return out


def case_list(verdicts: DataFrame, cases: DataFrame, urls: DataFrame, attachments: DataFrame, origins: DataFrame | None = None,
              band: str | None = None, limit: int = 200, version: str = dims.LATEST) -> DataFrame:
    """Q01: newest cases.  The earlier rules filter before the limit, the newer ones after."""
    base = verdicts.join(cases.select("owner", "case_id", "subject", "from_addr", F.col("arrival").alias("analyzed_at")), "case_id")
    newest = [F.desc("analyzed_at"), F.col("case_id")]
    match = F.lit(True) if band is None else F.col("band") == band
    top = base.filter(match).orderBy(*newest).limit(limit) if version == dims.EARLIER else base.orderBy(*newest).limit(limit).filter(match)
    top = top.select("owner", "case_id", F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)")).alias("subject"), "from_addr", "score", "band", "confidence", "analyzed_at")
    n = lambda t, name: t.join(F.broadcast(top.select("case_id")), "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias(name))
    out = top.join(n(urls, "urls"), "case_id", "left").join(n(attachments, "attachments"), "case_id", "left").na.fill(0, ["urls", "attachments"])
    return out if origins is None else out.join(origins.select("case_id", "origin_ip"), "case_id", "left")


def case_detail(verdicts: DataFrame, cases: DataFrame, hops: DataFrame, urls: DataFrame, attachments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q02: message columns, last stamped hop, counts, verdict and the sender-footprint detail, which no contribution carries."""
    n = lambda t, name: t.groupBy("case_id").agg(F.count("*").alias(name))
    got = hops.groupBy("case_id").agg(F.max("ts").alias("received_at"))
    footprint = (evidence.filter(F.col("signal").isin("sender_email_footprint", "sender_no_footprint")).groupBy("case_id")
                 .agg(F.min_by("detail", "pos").alias("footprint")))
    return (cases.join(verdicts.select("case_id", "score", "band", "confidence", "summary"), "case_id")
            .join(got, "case_id", "left").join(n(urls, "url_count"), "case_id", "left").join(n(attachments, "attachment_count"), "case_id", "left")
            .join(footprint, "case_id", "left").na.fill(0, ["url_count", "attachment_count"]))


def annotated_headers(headers: DataFrame, trusted_hops: DataFrame) -> DataFrame:
    """Q04: every header with the hop and trust of its Received line."""
    h = trusted_hops.select("case_id", F.col("raw").alias("value"), F.col("seq").alias("hop"), "trust")
    one = h.groupBy("case_id", "value").agg(F.max_by(F.struct("hop", "trust"), "hop").alias("h"))
    return headers.join(one, ["case_id", "value"], "left").select("case_id", "pos", "name", "value", "h.hop", "h.trust")


def artifacts(cases: DataFrame, hops: DataFrame, urls: DataFrame, attachments: DataFrame) -> DataFrame:
    """Q05: observables of every case, one row each; an address keeps its first hop."""
    ip = (hops.filter(F.col("from_ip").isNotNull()).groupBy("case_id", F.col("from_ip").alias("value"))
          .agg(F.min("seq").alias("first_hop")).select("case_id", F.lit("ip").alias("kind"), "value", "first_hop"))
    flat = lambda df, kind, value: df.select("case_id", F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("int").alias("first_hop"))
    addrs = cases.select("case_id", F.explode(F.array("from_addr", "reply_to", "return_path")).alias("a"))
    rest = (flat(urls, "domain", F.col("domain")).unionByName(flat(cases, "domain", domain_of(F.col("from_addr"))))
            .unionByName(flat(urls, "url", F.col("url"))).unionByName(flat(addrs, "email", F.col("a"))).unionByName(flat(attachments, "hash", F.col("sha256"))))
    return ip.unionByName(rest.filter(F.coalesce(F.col("value"), F.lit("")) != "").distinct())


def positive(verdicts: DataFrame) -> Column:
    """Positive contributions, strongest first; the contribution order breaks ties."""
    return F.filter("contributions", lambda c: c["points"] > 0)


def _by_points(verdicts: DataFrame) -> DataFrame:
    # positive contributions are already ranked by absolute points
    return verdicts.withColumn("_pos", positive(verdicts))


def _map(mapping: dict, pick=lambda v: v) -> Column:
    return F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, pick(v))])


def threat_types(verdicts: DataFrame) -> DataFrame:
    """Q07: class of the strongest mapped signal, else Suspicious / Clean."""
    m = _map(fx.THREAT_TYPE)
    mapped = F.filter(F.transform("_pos", lambda c: F.try_element_at(m, c["signal"])), lambda t: t.isNotNull())
    kind = F.coalesce(F.try_element_at(mapped, F.lit(1)), F.when(F.size("_pos") > 0, "Suspicious").otherwise("Clean"))
    return _by_points(verdicts).select("case_id", "score", "band", kind.alias("threat_type"))


def report_category(verdicts: DataFrame) -> DataFrame:
    """Q18: category and intent of the strongest finding with its impact grade."""
    cat, intent = _map(fx.REPORT_CATEGORY, lambda v: v[0]), _map(fx.REPORT_CATEGORY, lambda v: v[1])
    top = F.try_element_at("_pos", F.lit(1))
    clean = (F.col("band") == "BENIGN") | (F.size("_pos") == 0)
    pick = lambda m, none, other: F.when(clean, none).otherwise(F.coalesce(F.try_element_at(m, top["signal"]), F.lit(other)))
    grade = F.when(top["points"] >= 15, "High impact").when(top["points"] >= 8, "Medium impact").when(top.isNotNull(), "Low impact")
    return _by_points(verdicts).select("case_id", pick(cat, "Clean", "Suspicious").alias("category"),
                                       pick(intent, "None detected", "Undetermined").alias("intent"), grade.alias("top_impact"))


def trend(verdicts: DataFrame, cases: DataFrame, as_of: str, days: int = 7, version: str = dims.LATEST) -> DataFrame:
    """Q09: cases per day and bucket for the last days, empty days included."""
    spark = verdicts.sparkSession
    spine = spark.sql(f"SELECT explode(sequence(date_sub(date '{as_of}', {days - 1}), date '{as_of}')) AS day")
    buckets = list(dict.fromkeys(b for _, _, b in reversed(fx.BANDS[version])))
    day = F.to_date("arrival")
    recent = cases.filter(day.between(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).select("case_id", day.alias("day"))
    banded = verdicts.select("case_id", bucket_of(F.col("band"), version).alias("bucket"))
    counts = recent.join(banded, "case_id").groupBy("day").pivot("bucket", buckets).count()
    return spine.join(counts, "day", "left").na.fill(0, buckets)


def forensic_report(verdicts: DataFrame, cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q11: one report row per case: custody, verdict, evidence nested by lane."""
    pct = lambda c: F.concat(F.bround(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    item = F.struct("pos", "signal", "status", pct("confidence").alias("confidence"), "detail")
    per_lane = evidence.groupBy("case_id", "analyzer").agg(F.sort_array(F.collect_list(item)).alias("items"))
    nested = per_lane.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("analyzer", "items")))).alias("evidence"))
    severity = F.coalesce(F.try_element_at(_map(fx.BAND_SEVERITY), F.col("band")), F.lit("Unknown"))
    return (verdicts.join(cases, "case_id").join(nested, "case_id", "left")
            .select("case_id", F.col("arrival").alias("created_at"), F.col("sha256").alias("email_sha256"), "score", "band", severity.alias("severity"),
                    pct("confidence").alias("confidence"), "from_addr", "subject", "message_id", "evidence"))


def risk_factors(evidence: DataFrame, per_lane: int = 3) -> DataFrame:
    """Q12: the first triggered findings of every lane."""
    w = Window.partitionBy("case_id", "analyzer").orderBy("pos")
    return (evidence.filter(F.col("status") == "TRIGGERED").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_lane)
            .select("case_id", "analyzer", "n", "pos", "signal", "confidence"))


def recommendations(score: Column) -> Column:
    """Q13."""
    lit = lambda items: F.array(*[F.lit(i) for i in items])
    return F.when(score >= 75, lit(fx.RECOMMEND_HIGH)).when(score >= 50, lit(fx.RECOMMEND_MEDIUM)).otherwise(lit(fx.RECOMMEND_LOW))


def report_text(report: DataFrame, factors: DataFrame) -> DataFrame:
    """Q14: the report as plain text with the first ten risk factors."""
    line = F.concat(F.lit("  • "), F.col("analyzer"), F.lit(": "), F.col("signal"), F.lit(" ("), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)"))
    listed = factors.groupBy("case_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("analyzer", "pos", line.alias("t")))), 1, 10).alias("f"))
    rule, dash = F.lit("=" * 80), F.lit("-" * 80)
    text = lambda label, c: F.concat(F.lit(label), F.coalesce(c.cast("string"), F.lit("None")))
    rec = F.transform(recommendations(F.col("score")), lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r))
    lines = F.concat(
        F.array(rule, F.lit("FORENSIC ANALYSIS REPORT"), rule, F.lit(""), text("Case ID: ", F.col("case_id")), text("Email SHA256: ", F.col("email_sha256")), F.lit(""),
                F.lit("VERDICT"), dash, F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit("/100 ("), F.col("severity"), F.lit(")")),
                text("Confidence: ", F.col("confidence")), F.lit(""), F.lit("SENDER INFORMATION"), dash, text("From: ", F.col("from_addr")),
                text("Subject: ", F.col("subject")), text("Message-ID: ", F.col("message_id")), F.lit(""), F.lit("RISK FACTORS"), dash),
        F.coalesce(F.transform("f", lambda x: x["t"]), F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("RECOMMENDATIONS"), dash), rec, F.array(F.lit(""), rule))
    return report.join(listed, "case_id", "left").select("case_id", F.array_join(lines, "\n").alias("report"))


def history_search(verdicts: DataFrame, cases: DataFrame, text: str, band: str | None = None) -> DataFrame:
    """Q15: subject or sender contains the text."""
    needle = F.lit(text.lower())
    hit = F.contains(F.lower(F.coalesce("subject", F.lit(""))), needle) | F.contains(F.lower(F.coalesce("from_addr", F.lit(""))), needle)
    out = verdicts.join(cases.filter(hit).select("case_id", "subject", "from_addr"), "case_id")
    return out if band is None else out.filter(F.col("band") == band)


def alert_badge(records: DataFrame) -> DataFrame:
    """Q16: unacknowledged non-benign records and the worst band, per owner."""
    rank = F.array_position(F.array(*[F.lit(b) for b, _, _ in fx.BANDS[dims.LATEST]]), F.col("band"))
    live = records.filter(~F.col("acked") & F.col("band").isNotNull() & (F.col("band") != "BENIGN"))
    return live.groupBy("owner").agg(F.count("*").alias("n"), F.max_by("band", rank).alias("worst"))


def lane_coverage(verdicts: DataFrame) -> DataFrame:
    """Q17: lanes that ran, of all lanes."""
    lanes = F.array(*[F.lit(x) for x in fx.LANES])
    return verdicts.select("case_id", F.size(F.array_except(lanes, "lanes_unavailable")).alias("done"), F.lit(len(fx.LANES)).alias("total"))


def band_shares(verdicts: DataFrame, version: str = dims.LATEST) -> DataFrame:
    """Q19: rounded share of every bucket."""
    n = verdicts.groupBy(bucket_of(F.col("band"), version).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a handful of buckets
    return n.withColumn("percent", F.floor(F.col("n") * 100 / total + 0.5).cast("int"))


def auth_badges(evidence: DataFrame) -> DataFrame:
    """Q20."""
    has = lambda s: F.max((F.col("signal") == s) & (F.col("status") == "TRIGGERED"))
    b = evidence.groupBy("case_id").agg(has("spf_fail_hard").alias("s"), has("dkim_fail").alias("df"), has("dkim_valid_aligned").alias("dp"), has("dmarc_fail_strict").alias("dm"))
    return b.select("case_id", F.when(F.col("s"), "FAIL").otherwise("PASS / n/e").alias("spf"),
                    F.when(F.col("df"), "FAIL").when(F.col("dp"), "PASS").otherwise("NOT SIGNED").alias("dkim"),
                    F.when(F.col("dm"), "FAIL").otherwise("PASS / n/e").alias("dmarc"))


def rule_health(rules: DataFrame, evidence: DataFrame, version: str = dims.LATEST) -> DataFrame:
    """Q21: version, signals defined, lanes seen in the evidence."""
    seen = evidence.groupBy("analyzer").agg(F.count("*").alias("rows"))
    defined = rules.filter(F.col("version") == version).groupBy(F.col("rule_analyzer").alias("analyzer")).agg(F.count("*").alias("signals_defined"))
    return defined.join(seen, "analyzer", "full_outer").na.fill(0, ["rows", "signals_defined"]).withColumn("scorer_version", F.lit(version))


def owned(df: DataFrame, owner: str) -> DataFrame:
    """Q22: only the owner's rows."""
    return df.filter(F.col("owner") == owner)


def latest_per_message(records: DataFrame, limit: int = 100) -> DataFrame:
    """Q23: newest stored result of every message, newest first."""
    keep = [c for c in records.columns if c != "msg_id"]
    last = records.groupBy("msg_id").agg(F.max_by(F.struct(*keep), F.struct("at", "record_id")).alias("r")).select("msg_id", "r.*")
    return last.orderBy(F.desc("at"), F.desc("record_id")).limit(limit)


def risky_attachment(filename: Column) -> Column:
    """Q24."""
    return F.coalesce(F.lower(filename).rlike(fx.RISKY_ATTACHMENT_PATTERN), F.lit(False))


def age_label(ts: Column, as_of: Column) -> Column:
    s = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(ts))
    unit = lambda n, label: F.concat(F.floor(s / n).cast("string"), F.lit(label))
    return F.when(ts.isNull(), "—").when(s < 60, "just now").when(s < 3600, unit(60, " min ago")).when(s < 86400, unit(3600, " hr ago")).otherwise(unit(86400, " d ago"))
