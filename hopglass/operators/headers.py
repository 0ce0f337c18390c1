"""Relay chain and header lane.

A case is one message, so the hops of a case are bounded by one message's header
block.  Per-case answers are aggregates (combined before the shuffle); windows
are used only where neighbouring hops are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import SuffixRules, domain_of, registrable, same_org, suffix_related
from ..functions.net import in_networks, usable_cidrs, with_address_key, with_ip_facts, with_routability
from ..functions.text import rx
from .evidence import emit, finding


@dataclass(frozen=True)
class Infrastructure:
    """Receiving hosts and networks (IPv4 or IPv6) we control; default hosts always included."""
    hosts: tuple[str, ...] = ()
    cidrs: tuple[str, ...] = ()

    def networks(self) -> list[str]:
        return usable_cidrs(self.cidrs)[0]

    def unreadable(self) -> list[str]:
        """CIDRs that take no part because they cannot be read."""
        return usable_cidrs(self.cidrs)[1]

    def trusted_hosts(self) -> list[str]:
        named = [h.strip().lower() for h in self.hosts if h and h.strip()]
        return sorted(set(fx.DEFAULT_TRUSTED_HOSTS) | set(named))


DEFAULT_INFRASTRUCTURE = Infrastructure()

_ZONES = {"UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
          "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def _one_space(c: Column) -> Column:
    """White space folded to one space; most values are left alone.  Pass a plain column: it is named more than once."""
    return F.when(c.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(c, r"\s+", " ")).otherwise(c)


def with_mail_date(df: DataFrame, text: str, out: str) -> DataFrame:
    """RFC 5322 date; comments and weekday dropped, a missing zone means UTC."""
    zone = F.regexp_extract("_d", r" ([A-Z]{1,3})$", 1)
    offset = F.coalesce(*[F.when(zone == name, v) for name, v in _ZONES.items()])
    d = F.col("_d")
    return (df.withColumn("_d", F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)|^\s*[A-Za-z]{3,9},?\s+", " "), r"\s+", " ")))
            .withColumn("_z", F.when(d.rlike(r"[+-][0-9]{4}$"), "").otherwise(F.coalesce(offset, F.lit("+0000"))))
            .withColumn("_d", F.when(F.col("_z") == "", d).otherwise(F.concat_ws(" ", F.regexp_replace(d, r" [A-Z]{1,3}$", ""), F.col("_z"))))
            .withColumn(out, F.coalesce(F.try_to_timestamp(d, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(d, F.lit("d MMM yyyy HH:mm Z"))))
            .drop("_d", "_z"))


def _group(col: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(col, rx(pattern), i), F.lit(""))


def _hop_fields(hops: DataFrame) -> DataFrame:
    """Split one Received value (column ``raw``) into its clauses."""
    flat = F.trim(_one_space(F.col("raw")))
    df = with_mail_date(hops.withColumn("_flat", flat).withColumn("_t", F.when(F.contains("_flat", F.lit(";")), F.substring_index("_flat", ";", -1))), "_t", "ts")
    f = F.col("_flat")
    bare = _group(F.split_part(f, F.lit(" by "), F.lit(1)), fx.BARE_IP_PATTERN, 1)
    df = (df.withColumn("from_host", F.coalesce(_group(f, fx.FROM_PATTERN, 1), _group(f, fx.FROM_PATTERN, 2)))
          .withColumn("_ip", F.coalesce(_group(f, fx.FROM_PATTERN, 3), bare))
          .withColumn("by_host", _group(f, fx.BY_PATTERN, 1))
          .withColumn("protocol", F.upper(_group(f, fx.WITH_PATTERN, 1))))
    df = with_ip_facts(df, "_ip", "from_ip")
    return df.select("case_id", "seq", "raw", "from_host", "from_ip", "by_host", "protocol", "ts", "unroutable", "public")


def parse_hops(headers: DataFrame) -> DataFrame:
    """Hops from a header table.  Each relay prepends its line, so the last one is
    seq 0, the claimed origin."""
    w = Window.partitionBy("case_id").orderBy(F.desc("pos"))
    received = headers.filter(F.lower("name") == "received")
    return _hop_fields(received.select("case_id", (F.row_number().over(w) - 1).alias("seq"), F.col("value").alias("raw")))


def hops_of_messages(messages: DataFrame) -> DataFrame:
    """Same from the in-row header arrays of a message table: no shuffle."""
    lines = F.reverse(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "received"), lambda h: h["value"]))
    return _hop_fields(messages.select("case_id", F.posexplode_outer(lines).alias("seq", "raw")).filter(F.col("raw").isNotNull()))


def _ours(infra: Infrastructure) -> Column:
    ours = F.coalesce(F.lower(F.trim("by_host")).isin(infra.trusted_hosts()), F.lit(False))
    return ours | in_networks(F.col("_net"), infra.networks()) if infra.networks() else ours


def with_boundary(hops: DataFrame, infra: Infrastructure = DEFAULT_INFRASTRUCTURE) -> DataFrame:
    """Every hop with its case's trust boundary.

    The trusted run is contiguous from the final delivery down, so it is what lies
    above the highest hop we cannot vouch for: a maximum over the case, no ordering needed."""
    case = Window.partitionBy("case_id")
    last = F.coalesce(F.max(F.when(~F.col("_ours"), F.col("seq"))).over(case), F.lit(-1))
    if infra.networks():
        hops = with_address_key(hops, "from_ip", "_net")
    return (hops.withColumn("_ours", _ours(infra)).withColumns({"_cut": last, "_top": F.max("seq").over(case)})
            .withColumn("boundary_seq", F.when(F.col("_cut") < F.col("_top"), F.col("_cut") + 1)).drop("_ours", "_cut", "_top", "_net"))


def with_trust(hops: DataFrame, infra: Infrastructure = DEFAULT_INFRASTRUCTURE) -> DataFrame:
    b = F.col("boundary_seq")
    trust = F.when(F.col("seq") > b, "TRUSTED").when(F.col("seq") == b, "BOUNDARY").otherwise("UNVERIFIED")
    return with_boundary(hops, infra).withColumn("trust", trust)


def relay_facts(hops: DataFrame, infra: Infrastructure = DEFAULT_INFRASTRUCTURE) -> DataFrame:
    """Origin, forged hops and private addresses, one row per case."""
    h = with_trust(with_routability(hops, "from_ip"), infra)
    seq, ip = F.col("seq"), F.col("from_ip")
    forged = F.coalesce(seq < F.col("boundary_seq"), F.lit(False)) & F.col("unroutable")
    rest = F.col("unroutable") & ~forged
    per_case = h.groupBy("case_id").agg(
        F.max("boundary_seq").alias("boundary_seq"),
        F.max(F.when(F.col("trust") == "BOUNDARY", ip)).alias("boundary_ip"),
        F.max(F.when((F.col("trust") == "BOUNDARY") & F.col("public"), ip)).alias("_defensible"),
        F.min_by(F.struct(ip, F.col("from_host"), seq), F.when(F.col("public"), seq)).alias("_earliest"),
        F.max(F.when(F.col("trust") == "BOUNDARY", F.col("from_host"))).alias("_boundary_host"),
        F.max_by(ip, F.when(seq == 0, seq)).alias("claimed_ip"),
        F.sort_array(F.collect_list(F.when(forged, seq))).alias("injected_hops"),
        F.count(F.when(F.col("public"), True)).alias("routable_hops"),
        F.min_by(F.struct(seq, ip), F.when(rest, seq)).alias("private_hit_whole_chain"),
        F.max(F.when(F.col("public"), seq)).alias("_transit_top"),
        F.collect_list(F.when(rest, F.struct(seq, ip))).alias("_rest"))
    transit = F.filter("_rest", lambda r: r["seq"] < F.col("_transit_top"))
    own = F.col("_defensible").isNotNull()
    return (per_case
            .withColumn("origin_ip", F.coalesce("_defensible", "_earliest.from_ip"))
            .withColumn("origin_seq", F.when(own, F.col("boundary_seq")).otherwise(F.col("_earliest.seq")))
            .withColumn("origin_host", F.when(own, F.col("_boundary_host")).otherwise(F.col("_earliest.from_host")))
            .withColumn("private_hit_in_transit", F.array_max(transit))
            .drop("_defensible", "_earliest", "_boundary_host", "_transit_top", "_rest"))


def timestamp_regressions(hops: DataFrame) -> DataFrame:
    """First pair of consecutive stamped hops whose time goes back."""
    w = Window.partitionBy("case_id").orderBy("seq")
    stamped = hops.filter(F.col("ts").isNotNull()).select(
        "case_id", "seq", "ts", F.lag("ts").over(w).alias("before"), F.lag("seq").over(w).alias("after_hop"))
    return (stamped.filter(F.col("ts") < F.col("before"))
            .groupBy("case_id").agg(F.min(F.struct("seq", "after_hop")).alias("r"))
            .select("case_id", F.col("r.seq").alias("hop"), F.col("r.after_hop").alias("after_hop")))


def reply_to_mismatch(from_addr: Column, reply_to: Column, by_org: bool = True, suffixes: SuffixRules | None = None) -> Column:
    """Organisational domains differ (``by_org``) or exact domains differ."""
    a, b = domain_of(from_addr), domain_of(reply_to)
    differs = ~same_org(a, b, suffixes) if by_org else a != b
    return F.coalesce(a.isNotNull() & b.isNotNull() & (a != "") & (b != "") & differs, F.lit(False))


def fake_replies(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """A reply subject on a message with no thread headers."""
    threaded = headers.filter(F.lower("name").isin("in-reply-to", "references")).select("case_id")
    claims = messages.filter(F.trim("subject").rlike(rx(fx.REPLY_PREFIX_PATTERN)))
    return claims.join(threaded, "case_id", "left_anti").select("case_id", F.trim("subject").alias("subject"))


def message_id_domain(message_id: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(message_id, r"@([^>\s]+)", 1)), F.lit(""))


def message_id_divergence(messages: DataFrame, hops: DataFrame, suffixes: SuffixRules | None = None) -> DataFrame:
    """Message-ID organisation is neither the sender's nor any relay's."""
    m = messages.select("case_id", message_id_domain(F.col("message_id")).alias("mid"), domain_of(F.col("from_addr")).alias("dom"))
    m = m.filter(F.col("mid").isNotNull() & F.col("dom").isNotNull() & ~same_org(F.col("mid"), F.col("dom"), suffixes))
    relays = hops.select("case_id", F.explode(F.array("by_host", "from_host")).alias("host")).filter(F.col("host").isNotNull())
    hit = (m.join(relays, "case_id").filter(same_org(F.col("mid"), F.col("host"), suffixes)).select("case_id"))
    return m.join(hit, "case_id", "left_anti").select("case_id", F.col("mid").alias("message_id_domain"), F.col("dom").alias("from_domain"))


def relay_path(hops: DataFrame, suffixes: SuffixRules | None = None) -> DataFrame:
    """Organisations along the path with consecutive repeats collapsed."""
    w = Window.partitionBy("case_id").orderBy("seq")
    orgs = (hops.filter(F.col("from_host").contains(".")).select("case_id", "seq", registrable(F.col("from_host"), suffixes).alias("org"))
            .filter(F.col("org").isNotNull()))
    return (orgs.withColumn("prev", F.lag("org").over(w)).filter(F.col("prev").isNull() | (F.col("prev") != F.col("org")))
            .select("case_id", "seq", "org"))


def chain_discontinuities(hops: DataFrame, suffixes: SuffixRules | None = None) -> DataFrame:
    """An organisation that leaves the path and comes back."""
    path = relay_path(hops, suffixes)
    steps = path.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seq", "org"))).alias("steps"))
    names = F.transform("steps", lambda s: s["org"])
    again = F.filter(names, lambda o, i: F.array_position(names, o) <= i)
    return (steps.withColumn("path", names).withColumn("domain", F.try_element_at(again, F.lit(1)))
            .filter(F.col("domain").isNotNull()).select("case_id", "domain", F.array_join("path", " -> ").alias("relay_path")))


def legacy_hops(headers: DataFrame) -> DataFrame:
    """Addresses found in each Received line, newest first."""
    found = F.regexp_extract_all("value", F.lit(rx(fx.LEGACY_IP_PATTERN)), F.lit(0))
    return (headers.filter(F.lower("name") == "received").select("case_id", "pos", found.alias("ips_found"))
            .withColumn("public_ips", F.filter("ips_found", lambda i: ~i.rlike(fx.LEGACY_PRIVATE_PREFIX))))


def legacy_origin(headers: DataFrame) -> DataFrame:
    h = legacy_hops(headers).filter(F.size("public_ips") > 0)
    return h.groupBy("case_id").agg(F.max_by(F.element_at("public_ips", 1), "pos").alias("origin_ip"))


def legacy_identity_flags(messages: DataFrame) -> DataFrame:
    """Reply-To / Return-Path domains that differ from From."""
    dom = lambda c: F.lower(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"@([\w.\-]+)", 1))
    say = lambda name, d: F.when((d != "") & (d != dom("from_addr")), F.concat(
        F.lit(f"{name} domain ("), d, F.lit(") differs from From domain ("), dom("from_addr"), F.lit(")")))
    flags = F.array(say("Reply-To", dom("reply_to")), say("Return-Path", dom("return_path")))
    return messages.select("case_id", F.filter(flags, lambda f: f.isNotNull()).alias("flags"))


def alignment_view(messages: DataFrame) -> DataFrame:
    """Are the reply and return paths aligned with the sender?"""
    f, r, p = (domain_of(F.col(c)) for c in ("from_addr", "reply_to", "return_path"))
    off = lambda d: F.coalesce(d.isNotNull() & f.isNotNull() & ~suffix_related(d, f), F.lit(False))
    return messages.select("case_id", off(r).alias("reply_mismatch"), off(p).alias("return_mismatch"),
                           (~off(r) & ~off(p)).alias("aligned"))


def hop_timeline(hops: DataFrame) -> DataFrame:
    """First, middle and last stamped hop of a case."""
    s = (hops.filter(F.col("ts").isNotNull()).groupBy("case_id")
         .agg(F.sort_array(F.collect_list(F.struct("seq", "ts"))).alias("s")))
    at = lambda i: F.element_at("s", i.cast("int"))["ts"]
    return s.select("case_id", at(F.lit(1)).alias("origin_sent"), at(F.floor(F.size("s") / 2) + 1).alias("relayed"),
                    at(F.size("s")).alias("delivered"))


def header_lane(messages: DataFrame, headers: DataFrame, hops: DataFrame, infra: Infrastructure = DEFAULT_INFRASTRUCTURE,
                earlier_rules: bool = False, suffixes: SuffixRules | None = None) -> DataFrame:
    """M2: evidence rows of the header lane for every message."""
    private = "private_hit_whole_chain" if earlier_rules else "private_hit_in_transit"
    facts = (messages.select("case_id", reply_to_mismatch(F.col("from_addr"), F.col("reply_to"), not earlier_rules, suffixes).alias("reply_off"),
                             domain_of(F.col("from_addr")).alias("from_domain"), domain_of(F.col("reply_to")).alias("reply_to_domain"))
             .join(relay_facts(hops, infra), "case_id", "left")
             .join(timestamp_regressions(hops), "case_id", "left")
             .join(fake_replies(messages, headers), "case_id", "left"))
    forged = F.size(F.coalesce("injected_hops", F.array())) > 0
    rows = [
        finding("forged_received_hop", forged, F.struct("injected_hops", "boundary_seq", F.col("boundary_ip").alias("authenticated_origin"),
                                                        F.col("claimed_ip").alias("claimed_origin"))),
        finding("private_ip_in_public_chain", F.col(private).isNotNull(), F.struct(F.col(private)["seq"].alias("hop"), F.col(private)["from_ip"].alias("ip"))),
        finding("timestamp_regression", F.col("hop").isNotNull(), F.struct("hop", "after_hop")),
        finding("reply_to_domain_mismatch", F.col("reply_off"), F.struct("from_domain", "reply_to_domain")),
        finding("fake_reply", F.col("subject").isNotNull(), F.struct("subject")),
    ]
    if not earlier_rules:
        facts = (facts.join(message_id_divergence(messages, hops, suffixes).drop("from_domain"), "case_id", "left")
                 .join(chain_discontinuities(hops, suffixes), "case_id", "left"))
        rows += [finding("message_id_domain_divergence", F.col("message_id_domain").isNotNull(), F.struct("message_id_domain", "from_domain")),
                 finding("chain_discontinuity", F.col("domain").isNotNull(), F.struct("domain", "relay_path"))]
    return emit(facts, "M2", rows)
