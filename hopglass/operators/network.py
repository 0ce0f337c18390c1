"""Network lane and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import domain_of
from ..functions.net import network_parts, prefix_bits, with_address_key, with_routability
from . import dims
from .evidence import emit, row
from .headers import DEFAULT_INFRASTRUCTURE, Infrastructure, with_boundary, with_trust
from .lookup import join_facts
from .skew import hot_keys, join_on_hot_key


def networks(ranges: DataFrame) -> DataFrame:
    """Ranges as prefixes, any size and either family: one row per aligned prefix (``family``, ``bits``, ``p1``, ``p2``) with the
    range's other columns and ``specific``, which sorts narrow ranges first.  A range is given by ``lo`` and ``hi`` (IPv4
    numbers), by ``first_ip`` and ``last_ip`` or by ``cidr``; unreadable ones give no row (see ``unreadable_ranges``)."""
    if "p1" in ranges.columns:  # lines of a list, already prefixes
        return ranges.filter("family is not null").drop("cidr")
    return _with_parts(ranges).filter("_n.parts is not null").select("*", F.explode("_n.parts").alias("_p")).select(
        *[c for c in ranges.columns if c not in _BOUNDS], "_p.*", F.col("_n.specific").alias("specific"))


def unreadable_ranges(ranges: DataFrame) -> DataFrame:
    """Rows of a range table that ``networks`` cannot use."""
    if "p1" in ranges.columns:  # lines of a list, already prefixes
        return ranges.filter("family is not null").drop("cidr")
    return _with_parts(ranges).filter("_n.parts is null").drop("_n")


_BOUNDS = ("lo", "hi", "first_ip", "last_ip", "cidr")


def _with_parts(ranges: DataFrame) -> DataFrame:
    dotted = lambda n: F.when(F.col(n).between(0, 0xFFFFFFFF), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))
    if "cidr" in ranges.columns:
        first = last = F.col("cidr")
    elif "first_ip" in ranges.columns:
        first, last = F.col("first_ip"), F.col("last_ip")
    else:
        first, last = dotted("lo"), dotted("hi")
    return ranges.withColumn("_n", network_parts(first, last))


#: Prefixes (some 100 bytes each) that are broadcast.
BROADCAST_PREFIXES = 100_000


def network_matches(ips: DataFrame, nets: DataFrame, most: int = BROADCAST_PREFIXES) -> DataFrame:
    """Every network around each distinct address (``ip``): an equi-join on (family, bits, first bits), whatever the
    sizes of the networks.

    An address probes only the prefix lengths that occur (33 + 129 at most).  A list of at most BROADCAST_PREFIXES prefixes (counted
    first) goes to the addresses.  A larger one is joined by a shuffle, where a short prefix that covers much of the
    addresses is a hot key; such keys are counted and salted."""
    lengths = F.broadcast(nets.groupBy("family").agg(F.collect_set("bits").alias("_lengths")))  # two rows
    keyed = with_address_key(ips.select("ip").distinct(), "ip", "_key").filter(F.col("_key").isNotNull())
    probe = keyed.select("ip", "_key.*").join(lengths, "family").select("ip", "family", "hi", "lo", F.explode("_lengths").alias("bits"))
    p1, p2 = prefix_bits(F.col("family"), F.col("hi"), F.col("lo"), F.col("bits"))
    probe = probe.select("ip", "family", "bits", p1.alias("p1"), p2.alias("p2"))
    keys = ["family", "bits", "p1", "p2"]
    if nets.limit(most + 1).count() <= most:
        return probe.join(F.broadcast(nets), keys)
    return join_on_hot_key(probe, nets, keys, hot_keys(probe, keys))


def address_flags(ips: DataFrame, ip_list: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """Tor, VPN and datacenter membership of distinct addresses (``ip``)."""
    each = ips.select("ip").distinct()
    hit = network_matches(each, networks(ip_ranges)).groupBy("ip").agg(F.max(F.col("kind") == "vpn").alias("vpn"), F.max(F.col("kind") == "dc").alias("dc"))
    tor = ip_list.filter(F.col("kind") == "tor").select("ip", F.lit(True).alias("tor")).distinct()
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return each.join(tor, "ip", "left").join(hit, "ip", "left").select("ip", no("tor"), no("vpn"), no("dc"))


def flagged_hops(hops: DataFrame, ip_list: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """Routable hops with their membership flags; each distinct address is looked up once."""
    public = with_routability(hops, "from_ip").filter("public").withColumnRenamed("from_ip", "ip")
    return join_facts(public, address_flags(public, ip_list, ip_ranges), "ip")


def network_facts(messages: DataFrame, hops: DataFrame, ip_list: DataFrame, ip_ranges: DataFrame,
                  infra: Infrastructure = DEFAULT_INFRASTRUCTURE) -> DataFrame:
    """N04-N06 inputs, one row per message."""
    h = flagged_hops(with_boundary(hops, infra), ip_list, ip_ranges)
    seq, b = F.col("seq"), F.col("boundary_seq")
    trusted = b.isNull() | (seq >= b)
    conf = F.when(trusted, 1.0).otherwise(0.7)
    anon = F.when(F.col("tor"), "Tor exit node").when(F.col("vpn"), "known VPN range")
    pack = F.struct("ip", seq, anon.alias("classification"), conf.alias("confidence"))
    per_case = h.groupBy("case_id").agg(
        F.count("*").alias("routable_hops"),
        F.min_by(pack, F.when(F.col("tor") | F.col("vpn"), seq)).alias("anon"),
        # the boundary hop when it is routable, else the earliest routable hop
        F.min_by(F.struct("ip", seq, "dc", conf.alias("confidence")), F.struct(~F.coalesce(seq == b, F.lit(False)), seq)).alias("origin"))
    return messages.select("case_id", domain_of(F.col("from_addr")).alias("from_domain")).join(per_case, "case_id", "left")


def network_lane(facts: DataFrame, has_tor: bool = True, has_vpn: bool = True, has_dc: bool = True, has_geo: bool = False,
                 version: str = dims.LATEST) -> DataFrame:
    """Evidence rows.  Only evaluated dimensions may come out CLEAR; the
    earlier rules report missing intel before anything else."""
    none = F.col("routable_hops").isNull()
    webmail = F.col("from_domain").isin(fx.WEBMAIL_WITHHOLDING)
    intel = has_tor or has_vpn or has_dc or has_geo
    anon = F.col("anon").isNotNull() & F.lit(has_tor or has_vpn)
    dc = F.coalesce(F.col("origin.dc"), F.lit(False)) & F.lit(has_dc)
    missing = [n for n, ok in (("Tor/VPN", has_tor and has_vpn), ("datacenter", has_dc)) if not ok]
    live = ~none & F.lit(intel)
    if version == dims.EARLIER:
        rows = [row("origin_anonymized", "UNAVAILABLE", 0.0, when=F.lit(not intel))]
        none_rows = none & F.lit(intel)
        missing = []
    else:
        rows = [row("origin_anonymized", "UNAVAILABLE", 0.0, when=~none & F.lit(not intel))]
        none_rows = none
    rows += [
        row("provider_withholds_origin", "TRIGGERED", 1.0, F.struct(F.col("from_domain").alias("provider")), when=none_rows & webmail),
        row("origin_anonymized", "CLEAR", 1.0, when=none_rows & ~F.coalesce(webmail, F.lit(False))),
        row("origin_anonymized", "TRIGGERED", F.col("anon.confidence"), F.col("anon"), when=live & anon),
        row("origin_datacenter_hosted", "TRIGGERED", F.col("origin.confidence"), F.struct("origin.ip", "origin.seq"), when=live & dc),
        row("origin_anonymized", "UNAVAILABLE", 0.0, F.struct(F.lit(" & ".join(missing)).alias("missing")), when=live & ~anon & ~dc & F.lit(bool(missing))),
        row("origin_anonymized", "CLEAR", 1.0, F.struct("routable_hops"), when=live & ~anon & ~dc & F.lit(not missing)),
    ]
    return emit(facts, "M5", rows)


def geo_lookup(ips: DataFrame, geo_ranges: DataFrame) -> DataFrame:
    """Place of each distinct address; of nested or overlapping ranges the most specific wins."""
    place = F.struct("country", "city", "lat", "lon")
    hits = network_matches(ips, networks(geo_ranges))
    return hits.groupBy("ip").agg(F.min_by(place, F.col("specific")).alias("g")).select("ip", "g.country", "g.city", "g.lat", "g.lon")


def hop_trace(hops: DataFrame, geo_ranges: DataFrame, infra: Infrastructure = DEFAULT_INFRASTRUCTURE) -> DataFrame:
    """Q03: every hop with its trust, boundary and the place of its routable address; one lookup per distinct address."""
    h = with_routability(with_trust(hops, infra), "from_ip")
    public = h.filter("public").select(F.col("from_ip").alias("ip"))
    places = geo_lookup(public, geo_ranges).withColumnRenamed("ip", "_ip")
    return join_facts(h.withColumn("_ip", F.when(F.col("public"), F.col("from_ip"))), places, "_ip").drop("_ip")


def risk_of(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 35, "Medium").otherwise("Low")


def reputation(ips: DataFrame, ip_list: DataFrame, ip_ranges: DataFrame) -> DataFrame:
    """Heuristic score of each distinct address."""
    f = with_routability(address_flags(ips, ip_list, ip_ranges), "ip")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = F.least(F.lit(95), F.lit(8) + points(F.col("tor"), 62) + points(F.col("vpn"), 24) + points(F.col("dc"), 18)
                    + points(F.col("unroutable"), 40))
    return f.withColumn("score", score).withColumn("risk", risk_of(F.col("score")))


def reputation_with_feed(heuristic: DataFrame, feed: DataFrame, as_of: Column, ttl_hours: int = 6) -> DataFrame:
    """The newest feed row younger than its lifetime overrides the heuristic."""
    fresh = (feed.filter((F.col("fetched_at") > as_of - F.expr(f"interval {ttl_hours} hours")) & (F.col("fetched_at") <= as_of))
             .groupBy("ip").agg(F.max_by(F.struct("feed_score", "total_reports"), F.struct("fetched_at", "feed_score")).alias("f")))
    score = F.coalesce(F.col("f.feed_score"), F.col("score"))
    return (heuristic.join(fresh, "ip", "left")
            .withColumn("source", F.when(F.col("f").isNotNull(), "feed").otherwise("heuristic"))
            .withColumn("recent_abuse", F.when(F.coalesce(F.col("f.total_reports") >= 20, F.col("score") >= 70), "High").otherwise("Low"))
            .withColumn("score", score).withColumn("risk", risk_of(F.col("score"))).drop("f"))
