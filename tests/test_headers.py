import pytest
from pyspark.sql import functions as F

from hopglass.functions.net import with_ip_facts
from hopglass.functions.similarity import indel_ratio, lcs_length
from hopglass.operators import headers

RECEIVED = [
    "from edge.example.ac.in (edge.example.ac.in [198.51.100.9]) by mx.example.ac.in with ESMTPS id 4; Tue, 4 Aug 2026 10:00:30 +0530",
    "from out.sender.net (out.sender.net [203.0.113.44]) by mx.example.ac.in with ESMTPS id 3; Tue, 4 Aug 2026 10:00:20 +0530",
    "from relay.sender.net ([192.0.2.10]) by out.sender.net with ESMTP id 2; Tue, 4 Aug 2026 04:30:10 GMT (comment)",
    "from desk (desk [10.0.0.5]) by relay.sender.net with SMTP id 1; Tue, 4 Aug 2026 04:30:00",
]


@pytest.fixture(scope="module")
def hops(spark):
    rows = [(1, i, "Received", v) for i, v in enumerate(RECEIVED)]
    return headers.parse_hops(spark.createDataFrame(rows, "case_id long, pos int, name string, value string"))


def test_hops_in_transmission_order(hops):
    h = {r.seq: r for r in hops.collect()}
    assert [h[i].from_ip for i in range(4)] == ["10.0.0.5", "192.0.2.10", "203.0.113.44", "198.51.100.9"]
    assert h[0].protocol == "SMTP" and h[3].by_host == "mx.example.ac.in" and h[1].from_host == "relay.sender.net"
    stamps = [r.ts for r in hops.orderBy("seq").collect()]
    assert [int((b - a).total_seconds()) for a, b in zip(stamps, stamps[1:])] == [10, 10, 10]


def test_boundary_and_forged_hop(hops):
    t = {r.seq: r.trust for r in headers.with_trust(hops).collect()}
    assert t == {0: "UNVERIFIED", 1: "UNVERIFIED", 2: "BOUNDARY", 3: "TRUSTED"}
    f = headers.relay_facts(hops).first()
    assert f.injected_hops == [0] and f.origin_ip == "203.0.113.44" and f.claimed_ip == "10.0.0.5"
    assert headers.timestamp_regressions(hops).count() == 0


@pytest.mark.parametrize("ip,clean,public", [
    ("10.0.0.5", "10.0.0.5", False), ("127.0.0.1", "127.0.0.1", False), ("169.254.1.1", "169.254.1.1", False), ("100.64.1.1", "100.64.1.1", False),
    ("203.0.113.9", "203.0.113.9", True), ("192.0.2.1", "192.0.2.1", True), ("8.8.8.8", "8.8.8.8", True), ("not an ip", None, False), (None, None, False),
    ("IPv6:2001:DB8::1", "2001:db8::1", True), ("fe80::1", "fe80::1", False), ("2002:a00:5::1", "2002:a00:5::1", False), ("64:ff9b::a00:5", "64:ff9b::a00:5", False),
    ("172.31.0.1", "172.31.0.1", False), ("172.32.0.1", "172.32.0.1", True), ("192.88.99.1", "192.88.99.1", False), ("999.1.1.1", None, False)])
def test_addresses(spark, ip, clean, public):
    r = with_ip_facts(spark.createDataFrame([(ip,)], "raw string"), "raw").first()
    assert (r.ip, r.public) == (clean, public)


def test_fake_reply_needs_missing_thread_headers(spark):
    m = spark.createDataFrame([(1, "Re: hi"), (2, "RE[3]: hi"), (3, "Regarding"), (4, "fwd: x")], "case_id long, subject string")
    h = spark.createDataFrame([(2, "References"), (4, "X-Other")], "case_id long, name string")
    assert sorted(r.case_id for r in headers.fake_replies(m, h).collect()) == [1, 4]


def test_lcs_against_table():
    import random
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd-") for _ in range(rnd.randrange(0, 14))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]
    assert indel_ratio("", "") == 100.0
