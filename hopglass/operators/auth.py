"""Authentication lane (A01-A09) over outcome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import SuffixRules, domain_of, registrable, same_org, suffix_related
from ..functions.text import rx
from . import dims
from .evidence import emit, or_clear, row
from .lookup import join_facts


def header_verdicts(headers: DataFrame) -> DataFrame:
    """spf/dkim/dmarc words of Authentication-Results.  The Received-SPF
    fallback never takes effect in the original behaviour and is left out."""
    word = lambda m: F.lower(F.coalesce(F.nullif(F.regexp_extract("value", rx(rf"{m}=(\w+)"), 1), F.lit("")), F.lit("not found")))
    first = headers.filter(F.lower("name") == "authentication-results").groupBy("case_id").agg(F.min_by("value", "pos").alias("value"))
    return first.select("case_id", word("spf").alias("spf"), word("dkim").alias("dkim"), word("dmarc").alias("dmarc"))


def signing_domains(headers: DataFrame) -> DataFrame:
    """d= tags of DKIM signatures, in header order."""
    tag = F.nullif(F.lower(F.trim(F.regexp_extract("value", rx(fx.DKIM_DOMAIN_PATTERN), 1))), F.lit(""))
    return (headers.filter(F.lower("name") == "dkim-signature").select("case_id", "pos", tag.alias("domain"))
            .filter(F.col("domain").isNotNull()))


def aligned(a: Column, b: Column, version: str = dims.LATEST, suffixes: SuffixRules | None = None) -> Column:
    """Relaxed alignment."""
    return same_org(a, b, suffixes) if version == dims.LATEST else suffix_related(a, b)


def dkim_decisions(messages: DataFrame, headers: DataFrame, results: DataFrame, version: str = dims.LATEST,
                   suffixes: SuffixRules | None = None) -> DataFrame:
    """Per signed message the signal, its status and whether DKIM passed."""
    sender = messages.select("case_id", domain_of(F.col("from_addr")).alias("from_domain"))
    ok = lambda: aligned(F.col("domain"), F.col("from_domain"), version, suffixes)
    sig = signing_domains(headers)
    if version == dims.EARLIER:
        sig = sig.groupBy("case_id").agg(F.min_by("domain", "pos").alias("domain"), F.min("pos").alias("pos"))
        res = results.filter(F.col("mech") == "dkim").groupBy("case_id", "domain").agg(F.max(F.col("result") == "pass").alias("passed"))
        d = sig.join(res, ["case_id", "domain"], "left").join(sender, "case_id").withColumn("passed", F.coalesce("passed", F.lit(False)))
        good = F.col("passed") & ok()
        return (d.withColumn("signal", F.when(good, "dkim_valid_aligned").when(~F.col("passed"), "dkim_fail"))
                .select("case_id", F.col("domain").alias("dkim_domain"), "signal", F.when(F.col("signal").isNotNull(), "TRIGGERED").alias("status"), good.alias("dkim_pass")))
    s = (sig.join(sender, "case_id").withColumn("ok", ok()).groupBy("case_id")
         .agg(F.max("ok").alias("aligned_signature"), F.min_by("domain", F.struct(~F.col("ok"), F.col("pos"))).alias("dkim_domain")))
    r = (results.filter(F.col("mech") == "dkim").join(sender, "case_id").filter(ok()).groupBy("case_id")
         .agg(F.count("*").alias("n"), F.max(F.col("result") == "pass").alias("passed"), F.max(F.col("result") == "temperror").alias("temp")))
    no = lambda c: F.coalesce(c, F.lit(False))
    d = s.join(r, "case_id", "left")
    unknown = no("temp") | F.coalesce(F.col("n") == 0, F.lit(True))
    signal = (F.when(no("passed"), "dkim_valid_aligned").when(F.col("aligned_signature") & unknown, "dkim_unavailable")
              .when(F.col("aligned_signature"), "dkim_fail"))
    return d.select("case_id", "dkim_domain", signal.alias("signal"),
                    F.when(signal == "dkim_unavailable", "UNAVAILABLE").when(signal.isNotNull(), "TRIGGERED").alias("status"),
                    no("passed").alias("dkim_pass"))


def severity(result: Column) -> Column:
    """Rank of an outcome, the worst first."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in fx.AUTH_OUTCOMES_WORST_FIRST]), result).cast("int"), F.lit(0))


def spf_decisions(messages: DataFrame, origins: DataFrame, results: DataFrame, version: str = dims.LATEST,
                  suffixes: SuffixRules | None = None) -> DataFrame:
    """SPF outcome of (boundary address, SPF domain); a passing ARC chain turns a hard fail into ``arc_authenticated``.

    An outcome row names the ``ip`` and ``domain`` it was taken for; NULL there stands for any.  Of several outcomes of one
    key the worst counts."""
    worst = lambda mech: F.min_by("result", severity(F.col("result"))).alias(mech)
    ip = F.col("ip") if "ip" in results.columns else F.lit(None).cast("string")
    spf = results.filter(F.col("mech") == "spf").select("case_id", "result", ip.alias("_ip"), F.lower("domain").alias("_domain"))
    arc = results.filter(F.col("mech") == "arc").groupBy("case_id").agg(worst("arc"))
    sender = domain_of(F.col("from_addr"))
    d = (messages.select("case_id", sender.alias("from_domain"), F.coalesce(F.nullif(domain_of(F.col("return_path")), F.lit("")), sender).alias("spf_domain"))
         .join(origins.select("case_id", "boundary_ip").filter(F.col("boundary_ip").isNotNull()), "case_id")
         .filter(F.coalesce(F.col("spf_domain"), F.lit("")) != "")
         .join(spf, "case_id").filter(F.coalesce(F.col("_ip") == F.col("boundary_ip"), F.lit(True)) & F.coalesce(F.col("_domain") == F.col("spf_domain"), F.lit(True)))
         .groupBy("case_id", "from_domain", "spf_domain", "boundary_ip").agg(worst("spf")).join(arc, "case_id", "left"))
    passed = (F.col("spf") == "pass") & aligned(F.col("spf_domain"), F.col("from_domain"), version, suffixes)
    if version == dims.EARLIER:
        signal = F.when(F.col("spf") == "fail", "spf_fail_hard")
    else:
        signal = (F.when((F.col("spf") == "fail") & F.coalesce(F.col("arc") == "pass", F.lit(False)), "arc_authenticated")
                  .when(F.col("spf") == "fail", "spf_fail_hard").when(F.col("spf").isin("temperror", "permerror"), "spf_unavailable"))
    return d.select("case_id", "spf_domain", "boundary_ip", signal.alias("signal"),
                    F.when(signal == "spf_unavailable", "UNAVAILABLE").when(signal.isNotNull(), "TRIGGERED").alias("status"), passed.alias("spf_pass"))


def dmarc_policies(domains: DataFrame, dns: DataFrame, version: str = dims.LATEST, suffixes: SuffixRules | None = None) -> DataFrame:
    """Policy that governs each distinct domain."""
    d = domains.select("domain").distinct()
    if version == dims.EARLIER:
        labels = F.split("domain", r"\.")
        up = d.select("domain", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                      lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("depth", "at"))
        rec = dns.filter(F.col("state") == "found").select(F.col("domain").alias("at"), F.coalesce("p", F.lit("none")).alias("p"))
        return up.join(rec, "at").groupBy("domain").agg(F.min_by("p", "depth").alias("policy")).withColumn("unavailable", F.lit(False))
    exact = dns.select("domain", F.coalesce("p", F.lit("none")).alias("p"), F.col("state").alias("s"))
    parent = dns.select(F.col("domain").alias("org"), F.coalesce("sp", "p", F.lit("none")).alias("op"), F.col("state").alias("os"))
    org = registrable(F.col("domain"), suffixes)
    j = (d.withColumn("org", F.when(org != F.col("domain"), org)).join(exact, "domain", "left").join(parent, "org", "left"))
    policy = F.when(F.col("s") == "found", F.col("p")).when(F.col("os") == "found", F.col("op"))
    down = policy.isNull() & (F.coalesce(F.col("s") == "unreachable", F.lit(False)) | F.coalesce(F.col("os") == "unreachable", F.lit(False)))
    return j.select("domain", policy.alias("policy"), down.alias("unavailable"))


def auth_facts(messages: DataFrame, headers: DataFrame, origins: DataFrame, results: DataFrame, dns: DataFrame, version: str = dims.LATEST,
               suffixes: SuffixRules | None = None) -> DataFrame:
    m = messages.select("case_id", domain_of(F.col("from_addr")).alias("domain"))
    m = join_facts(m, dmarc_policies(m, dns, version, suffixes), "domain")
    rename = lambda df, p: df.withColumnsRenamed({"signal": f"{p}_signal", "status": f"{p}_status"})
    f = (m.join(rename(spf_decisions(messages, origins, results, version, suffixes), "spf"), "case_id", "left")
         .join(rename(dkim_decisions(messages, headers, results, version, suffixes), "dkim"), "case_id", "left"))
    passed = F.coalesce("spf_pass", F.lit(False)) | F.coalesce("dkim_pass", F.lit(False))
    strict = F.col("policy").isin("reject", "quarantine") & ~passed
    return (f.withColumn("dmarc_signal", F.when(F.col("unavailable"), "dmarc_unavailable").when(strict, "dmarc_fail_strict"))
            .withColumn("dmarc_status", F.when(F.col("unavailable"), "UNAVAILABLE").when(strict, "TRIGGERED")))


def auth_lane(facts: DataFrame) -> DataFrame:
    """Evidence rows; CLEAR when nothing but the DKIM credit was found."""
    conf = lambda p: F.when(F.col(f"{p}_status") == "UNAVAILABLE", 0.0).otherwise(1.0)
    made = {p: row(F.col(f"{p}_signal"), F.col(f"{p}_status"), conf(p), when=F.col(f"{p}_signal").isNotNull()) for p in ("spf", "dkim", "dmarc")}
    credit_only = F.col("spf_signal").isNull() & F.col("dmarc_signal").isNull() & F.coalesce(F.col("dkim_signal") == "dkim_valid_aligned", F.lit(True))
    return emit(facts, "M3", [*made.values(), row("auth_verification_passed", "CLEAR", 1.0, when=credit_only)])
