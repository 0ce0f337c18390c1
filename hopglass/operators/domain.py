"""Domain lane (D01-D13).  Everything that depends on the domain alone is worked
out once per distinct domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import domain_of, parts, skeleton, tokens
from ..functions.similarity import brand_parts, decode_punycode, near_brands
from . import dims
from .evidence import emit, or_clear, row
from .lookup import join_facts


def unicode_domain(domain: Column) -> Column:
    """Punycode labels decoded; other domains never reach the helper."""
    puny = F.when(domain.contains("xn--"), domain)
    return F.coalesce(F.nullif(decode_punycode(puny), F.lit("")), domain)


def domain_shape(domains: DataFrame) -> DataFrame:
    """Skeleton, labels and tokens of each distinct domain."""
    df = domains.select("domain").distinct().withColumn("raw", F.btrim(F.lower("domain"), F.lit(".")))
    df = df.withColumn("uni", unicode_domain(F.col("raw"))).withColumn("skel", skeleton(F.col("uni")))
    labels = F.split("skel", r"\.")
    return (df.withColumn("labels", F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels))
            .withColumn("core", F.array_join("labels", "."))
            .withColumn("tokens", tokens(F.col("core"))).withColumn("parts", parts(F.col("core")))
            # the first label of the greatest length
            .withColumn("sig", F.aggregate("labels", F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)))
            .withColumn("homographed", (F.col("uni") != F.col("raw")) | F.col("raw").contains("xn--") | F.col("raw").rlike(r"[^\x00-\x7F]")))


def _under(raw: Column, names: list[str]) -> Column:
    out = raw.isin(names)
    for n in names:
        out = out | raw.endswith("." + n)
    return out


def brand_lookalikes(domains: DataFrame, version: str = dims.LATEST) -> DataFrame:
    """(domain, brand, technique) of distinct look-alike domains; the first
    brand of the list that matches wins."""
    df = domain_shape(domains)
    exempt = _under(F.col("raw"), fx.PROTECTED_BRANDS)
    if version == dims.LATEST:
        exempt = exempt | _under(F.col("raw"), fx.LEGIT_NEAR_BRANDS)
    df = df.filter(~exempt).withColumn("near", near_brands("sig", "tokens"))
    # one row per (domain, protected brand): a fixed handful of brands
    brands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("brand"), F.lit(brand_parts(b)[0]).alias("name"))
                       for i, b in enumerate(fx.PROTECTED_BRANDS)])
    df = df.withColumn("b", F.explode(brands))
    name, i = F.col("b.name"), F.col("b.i")
    close = F.when(F.col("homographed"), "homograph").otherwise("typosquat")
    inside = F.array_contains("labels", name) | F.array_contains("tokens", name)
    if version == dims.LATEST:
        inside = inside | ((F.length(name) >= 3) & F.array_contains("parts", name))
    technique = (F.when(F.col("skel") == F.col("b.brand"), close).when(inside, "brand-name-in-domain")
                 .when(F.col("near")[2 * i], close).when(F.col("near")[2 * i + 1], "typosquat"))
    hits = df.select("domain", F.col("b.brand").alias("brand"), i.alias("i"), technique.alias("technique")).filter(F.col("technique").isNotNull())
    return hits.groupBy("domain").agg(F.min_by(F.struct("brand", "technique"), "i").alias("hit")).select("domain", "hit.brand", "hit.technique")


def domain_facts(domains: DataFrame, intel: DataFrame, as_of: Column, version: str = dims.LATEST) -> DataFrame:
    """D01/D02/D07 per distinct domain.  ``intel`` holds one snapshot row per domain."""
    d = domains.select("domain").distinct()
    i = d.join(intel, "domain", "left")
    age = F.datediff(as_of, F.col("created_at"))
    down = lambda c: F.coalesce(F.col(c) == "unreachable", F.lit(False)) & F.lit(version == dims.LATEST)
    return (i.select("domain", age.alias("age_days"), down("rdap_state").alias("age_down"), down("dns_state").alias("dns_down"),
                     F.coalesce(F.col("has_mx") & (F.col("dns_state") == "ok"), F.lit(False)).alias("has_mx"),
                     F.coalesce(F.col("has_a") & (F.col("dns_state") == "ok"), F.lit(False)).alias("has_a"))
            .withColumn("age_days", F.when(~F.col("age_down"), F.col("age_days")))
            .join(brand_lookalikes(d, version), "domain", "left"))


def rdns_mismatches(origins: DataFrame, host_ips: DataFrame) -> DataFrame:
    """Cases whose announced relay name is known only at other /24 networks.
    ``origins``: case_id, origin_host, origin_ip.  Distinct (host, network) pairs
    are judged once."""
    net = lambda ip: F.substring_index(ip, ".", 3)
    o = (origins.filter(F.col("origin_host").contains(".") & ~F.col("origin_ip").contains(":"))
         .select("case_id", "origin_ip", F.col("origin_host").alias("host"), net("origin_ip").alias("net")))
    known = host_ips.groupBy("host").agg(F.count("ip").alias("n_ips"), F.max(F.col("state") == "unreachable").alias("down"))
    near = host_ips.filter(F.col("ip").isNotNull()).select("host", net("ip").alias("net"), F.lit(True).alias("near")).distinct()
    judged = (o.select("host", "net").distinct().join(known, "host").join(near, ["host", "net"], "left")
              .withColumn("status", F.when(F.col("n_ips") > 0, F.when(F.col("near").isNull(), "TRIGGERED")).when(F.col("down"), "UNAVAILABLE"))
              .filter(F.col("status").isNotNull())
              .select(F.concat_ws("|", "host", "net").alias("place"), "status"))
    rows = o.withColumn("place", F.concat_ws("|", "host", "net"))
    return join_facts(rows, judged, "place", "inner").select("case_id", F.col("host").alias("hostname"), F.col("origin_ip").alias("connecting_ip"), F.col("status").alias("rdns_status"))


def domain_lane(messages: DataFrame, facts: DataFrame, rdns: DataFrame | None = None) -> DataFrame:
    """M6 evidence; D13: one CLEAR row when nothing else was found."""
    m = join_facts(messages.select("case_id", domain_of(F.col("from_addr")).alias("domain")), facts, "domain")
    if rdns is not None:
        m = m.join(rdns, "case_id", "left")
    else:
        m = m.withColumns({c: F.lit(None).cast("string") for c in ("hostname", "connecting_ip", "rdns_status")})
    some = F.coalesce(F.col("domain"), F.lit("")) != ""
    on = lambda c: some & F.coalesce(c, F.lit(False))
    age, dns = F.coalesce("age_down", F.lit(False)), F.coalesce("dns_down", F.lit(False))
    rows = [
        row("domain_age_lt_30d", "UNAVAILABLE", 0.0, when=on(age)),
        row("domain_age_lt_30d", "TRIGGERED", 1.0, F.struct("age_days"), when=on(~age & (F.col("age_days") < 30))),
        row("domain_does_not_resolve", "UNAVAILABLE", 0.0, when=on(dns)),
        row("domain_no_mx", "TRIGGERED", 1.0, F.struct("domain"), when=on(~dns & ~F.coalesce("has_mx", F.lit(False)))),
        row("domain_does_not_resolve", "TRIGGERED", 1.0, F.struct("domain"), when=on(~dns & ~F.coalesce("has_a", F.lit(False)))),
        row("brand_lookalike_domain", "TRIGGERED", 1.0, F.struct("domain", F.col("brand").alias("similar_to"), "technique"), when=on(F.col("brand").isNotNull())),
        row("rdns_mismatch", F.col("rdns_status"), F.when(F.col("rdns_status") == "TRIGGERED", 1.0).otherwise(0.0), F.struct("hostname", "connecting_ip"), when=on(F.col("rdns_status").isNotNull())),
        row("domain_age_lt_30d", "UNAVAILABLE", 0.0, F.struct(F.lit("No From domain found").alias("reason")), when=~some),
    ]
    return emit(m, "M6", or_clear(rows, row("domain_age_lt_30d", "CLEAR", 1.0, F.struct("domain", "age_days"))))


def legacy_domain_risk(facts: DataFrame) -> DataFrame:
    """First-generation risk flags and their number."""
    flags = F.array(
        F.when(F.col("age_days") < 30, F.concat(F.lit("Domain registered only "), F.col("age_days").cast("string"), F.lit(" days ago"))),
        F.when(~F.col("has_mx") & ~F.col("dns_down"), F.lit("No MX records")),
        F.when(~F.col("has_a") & ~F.col("dns_down"), F.lit("Does not resolve")))
    found = F.filter(flags, lambda f: f.isNotNull())
    return facts.select("domain", F.array_join(found, "; ").alias("risk_flags"), F.size(found).alias("n_flags"))
