"""Prefix matches, routability and suffix rules against plain Python."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from hopglass.functions import domains, net
from hopglass.functions import fixed_values as fx
from hopglass.operators import headers, network
from hopglass.sources import store


def made(seed):
    rnd = random.Random(seed)
    ranges = [("half", "0.0.0.0", "127.255.255.255"), ("all", "0.0.0.0", "255.255.255.255"), ("all6", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("one", "9.9.9.9", "9.9.9.9")]
    for _ in range(60):
        for bits, kind in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
            a = rnd.randrange(1 << bits)
            b = min((1 << bits) - 1, a + rnd.choice([0, 7, 200, 60_000, 1 << rnd.randrange(1, bits)]))
            ranges.append((f"r{len(ranges)}", str(kind(a)), str(kind(b))))
    near = [f"77.77.77.{i}" for i in range(256)]  # most addresses in one /24
    return ranges, sorted({*near, *(r[1] for r in ranges), *(r[2] for r in ranges), *(str(ipaddress.IPv4Address(rnd.randrange(1 << 32))) for _ in range(40)),
                           *(str(ipaddress.IPv6Address(rnd.randrange(1 << 128))) for _ in range(40))})


def around(ip, ranges):
    x = ipaddress.ip_address(ip)
    return {k for k, a, b in ranges if ipaddress.ip_address(a).version == x.version and ipaddress.ip_address(a) <= x <= ipaddress.ip_address(b)}


def test_networks_around_addresses_against_brute_force(spark, monkeypatch):
    ranges, ips = made(3)
    nets = network.networks(spark.createDataFrame(ranges, "kind string, first_ip string, last_ip string"))
    assert nets.count() > len(ranges)
    wanted = {(ip, k) for ip in ips for k in around(ip, ranges)}
    df = spark.createDataFrame([(x,) for x in [*ips, "no address", None, "1.2.3.400"]], "ip string")
    assert {(r.ip, r.kind) for r in network.network_matches(df, nets).collect()} == wanted
    assert {(r.ip, r.kind) for r in network.network_matches(df, nets, most=10).collect()} == wanted
    from hopglass.operators import skew
    monkeypatch.setattr(network, "hot_keys", lambda rows, keys: skew.hot_keys(rows, keys, 20))  # short prefixes are hot keys
    assert {(r.ip, r.kind) for r in network.network_matches(df, nets, most=10).collect()} == wanted


def test_the_most_specific_range_wins(spark):
    rows = [("0.0.0.0", "127.255.255.255", "wide"), ("77.0.0.0", "77.77.77.100", "middle"), ("77.77.77.5", "77.77.77.6", "narrow"), ("2a00::", "2aff::", "six"), ("2a02:1::", "2a02:1::ffff", "six narrow"),
            ("1.1.1.2", "1.1.1.1", "reversed"), ("1.1.1.1", "2a00::", "mixed"), ("x", "y", "unreadable")]
    geo = spark.createDataFrame([(a, b, c, None, 0.0, 0.0) for a, b, c in rows], "first_ip string, last_ip string, country string, city string, lat double, lon double")
    ips = spark.createDataFrame([("77.77.77.5",), ("77.77.77.99",), ("77.77.77.101",), ("200.1.1.1",), ("2a02:1::1",), ("2a02:2::1",)], "ip string")
    got = {r.ip: r.country for r in network.geo_lookup(ips, geo).collect()}
    assert got == {"77.77.77.5": "narrow", "77.77.77.99": "middle", "77.77.77.101": "wide", "2a02:1::1": "six narrow", "2a02:2::1": "six"}
    assert {r.country for r in network.unreadable_ranges(geo).collect()} == {"reversed", "mixed", "unreadable"}


@pytest.mark.parametrize("raw", ["10.0.0.5", "8.8.8.8", "::ffff:10.0.0.5", "::ffff:8.8.8.8", "2002:0a00:0005::1", "2002:0808:0808::1", "64:ff9b::10.0.0.1", "64:ff9b::8.8.8.8", "fe80::1", "fd12::3", "::1", "::",
                                 "2001:db8::1", "2a02:6b8::feed", "IPv6:2A02:6B8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1::8", "gibberish", "1::2::3", "fe80::1%eth0"])
def test_routability_of_both_families(spark, raw):
    text = raw.lower().removeprefix("ipv6:")
    try:
        x = ipaddress.ip_address(text)
    except ValueError:
        x = None
    if x is not None and "%" in text:
        x = None
    bad = False
    if x is not None:
        inner = x if x.version == 4 else x.ipv4_mapped or x.sixtofour or (ipaddress.ip_address(int(x) & 0xFFFFFFFF) if x in ipaddress.ip_network("64:ff9b::/96") else None)
        bad = any((inner or x) in ipaddress.ip_network(c) for c in (fx.UNROUTABLE_V4 if inner else fx.UNROUTABLE_V6))
    row = net.with_ip_facts(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    if x is None:
        assert row.unroutable is False and (row.ip is None or "%" in raw)
    else:
        assert (row.ip, row.unroutable, row.public) == (str(x), bad, not bad)


def test_trusted_networks_of_both_families(spark):
    rows = [(1, 0, "10.0.0.5", "a"), (1, 1, "2a02:3::9", "b"), (1, 2, "198.51.100.9", "c"), (2, 0, "2a02:4::9", "d"), (2, 1, "2a02:3:ffff::9", "e")]
    hops = spark.createDataFrame(rows, "case_id long, seq int, from_ip string, by_host string")
    infra = headers.Infrastructure(cidrs=("198.51.100.0/24", "2a02:3::/32", "no/network"))
    assert infra.unreadable() == ["no/network"]
    got = {(r.case_id, r.seq): r.trust for r in headers.with_trust(hops, infra).collect()}
    assert got == {(1, 0): "UNVERIFIED", (1, 1): "BOUNDARY", (1, 2): "TRUSTED", (2, 0): "UNVERIFIED", (2, 1): "BOUNDARY"}


def test_ip_list_file(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# head\n\n 10.0.0.0/8 \n1.2.3.4\n2a02:1::/32\n2a02:9::1\nbad/99\n300.1.1.1\n")
    lines = store.read_ip_list(spark, str(f), "vpn")
    got = {r.cidr: (r.family, r.bits) for r in lines.collect()}
    assert got == {"10.0.0.0/8": (4, 8), "1.2.3.4/32": (4, 32), "2a02:1::/32": (6, 32), "2a02:9::1/128": (6, 128), "bad/99": (None, None), "300.1.1.1/32": (None, None)}
    ips = spark.createDataFrame([("10.1.2.3",), ("1.2.3.4",), ("2a02:1:ff::1",), ("2a02:9::1",), ("2a02:9::2",), ("1.2.3.5",)], "ip string")
    flags = network.address_flags(ips, spark.createDataFrame([], "kind string, ip string"), lines)
    assert {r.ip for r in flags.collect() if r.vpn} == {"10.1.2.3", "1.2.3.4", "2a02:1:ff::1", "2a02:9::1"}


RULES = [("com", False), ("com.mx", False), ("co.uk", False), ("*.ck", False), ("!www.ck", False), ("jp", False), ("*.kawasaki.jp", False), ("!city.kawasaki.jp", False), ("github.io", True), ("s3.amazonaws.com", True),
         ("*.compute.amazonaws.com", True)]
HOSTS = {"bank.com.mx": "bank.com.mx", "a.b.evil.com.mx": "evil.com.mx", "com.mx": None, "x.co.uk.": "x.co.uk", "co.uk": None, "shop.a.ck": "shop.a.ck", "a.ck": None, "ck": None, "www.ck": "www.ck", "m.www.ck": "www.ck",
         "xck.com": "xck.com", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None, "kawasaki.jp": "kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "u.github.io": "u.github.io", "github.io": None,
         "b.s3.amazonaws.com": "b.s3.amazonaws.com", "x.eu.compute.amazonaws.com": "x.eu.compute.amazonaws.com", "amazonaws.com": "amazonaws.com", "notco.uk": "notco.uk", "a.unlisted": "a.unlisted", "localhost": None,
         "10.0.0.1": None, "2a02::1": None, "": None, "A.B.Example.COM": "example.com"}


def test_suffix_rules_compiled_and_joined(spark):
    table = spark.createDataFrame(RULES, "rule string, private boolean")
    rules = domains.suffix_rules(table)
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    assert {r.host: r.org for r in hosts.select("host", domains.registrable(F.col("host"), rules).alias("org")).collect()} == HOSTS
    joined = {r.host: r.org_domain for r in domains.registrable_by_table(hosts, "host", table).collect()}
    for host, org in HOSTS.items():
        clean = host.strip(". ").lower()
        if clean and ":" not in clean and "." in clean:
            assert joined[clean] == org, host
    public = hosts.select("host", domains.registrable(F.col("host"), rules, private=False).alias("org"))
    assert {r.host: r.org for r in public.collect()}["u.github.io"] == "github.io"
    same = lambda a, b: spark.range(1).select(domains.same_org(F.lit(a), F.lit(b), rules)).first()[0]
    assert not same("bank.com.mx", "evil.com.mx") and same("a.bank.com.mx", "bank.com.mx") and not same("com.mx", "x.com.mx")


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError, match="registrable_by_table"):
        domains.suffix_rules(spark.range(30).selectExpr("'s' || id || '.org' as rule", "false as private"), most=20)


def test_a_large_rule_table_compiles(spark):
    rows = [(f"{a}{b}.c{a}", False) for a in range(100) for b in "abcdefghij"] + [(f"*.w{a}", False) for a in range(500)]
    rules = domains.SuffixRules.of(rows)
    df = spark.createDataFrame([("x.y.7c.c7",), ("x.y.w9",), ("x.y.c7",)], "host string")
    assert [r[0] for r in df.select(domains.registrable(F.col("host"), rules)).collect()] == ["y.7c.c7", "x.y.w9", "y.c7"]
