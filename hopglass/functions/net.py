"""IP expressions (H03, H04).  IPv4 is arithmetic in the JVM; only values with a
colon are sent to the IPv6 helper."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import fixed_values as fx
from .text import settled

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """IPv4 text as BIGINT, NULL for anything else."""
    o = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")
    return F.when(ip.rlike(IPV4), o(1) * 16777216 + o(2) * 65536 + o(3) * 256 + o(4))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def usable_cidrs(cidrs: Iterable[str]) -> tuple[list[str], list[str]]:
    """The CIDRs (either family) that can be read, and the others."""
    good, bad = [], []
    for c in cidrs:
        try:
            ipaddress.ip_network(c, strict=False)
            good.append(c)
        except ValueError:
            bad.append(c)
    return good, bad


def _shift(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(bits).cast("int"))


def _with_key(df: DataFrame, ip: str, out: str) -> DataFrame:
    """As ``with_address_key``, by projections alone: they are compiled, and as each step's columns are named more than once
    (or cheap), none is merged into the next."""
    text = F.col(ip)
    df = df.withColumns({"_v6": F.when(text.contains(":") & text.rlike(IPV6_SHAPE), text), "_v4": F.when(~text.contains(":"), ipv4_number(text))})
    v6 = F.col("_v6")
    dotted = ipv4_number(F.substring_index(v6, ":", -1))
    low = F.concat(F.lower(F.hex(_shift(dotted, 16))), F.lit(":"), F.lower(F.hex(dotted.bitwiseAND(65535))))
    df = df.withColumn("_v6", F.when(v6.contains("."), F.concat(F.regexp_extract(v6, "^(.*:)", 1), low)).otherwise(v6))
    some = lambda i: F.array_remove(F.split(F.split_part(v6, F.lit("::"), F.lit(i)), ":"), "")
    df = df.withColumns({"_left": F.when(v6.contains("::"), some(1)), "_right": F.when(v6.contains("::"), some(2))})
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size("_left") - F.size("_right"), F.lit(0)))
    df = df.withColumn("_groups", F.when(F.col("_left").isNotNull(), F.concat("_left", gap, "_right")).when(v6.isNotNull(), F.split(v6, ":")))
    half = lambda start: F.conv(F.concat(*(F.lpad(F.get("_groups", F.lit(i)), 4, "0") for i in range(start, start + 4))), 16, -10).cast("bigint")
    key = lambda family, hi, lo: F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))
    found = F.when(F.col("_v4").isNotNull(), key(4, F.col("_v4"), F.lit(0).cast("bigint"))).when(F.size("_groups") == 8, key(6, half(0), half(4)))
    return df.withColumn(out, found).drop("_v6", "_v4", "_left", "_right", "_groups")


def with_address_key(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds struct(family, hi, lo) of canonical address text, 128 bits as two signed longs (IPv4: the number in ``hi``); NULL for
    anything else.  Only JVM functions; each step is a column of its own, so nothing is evaluated twice."""
    return settled(_with_key(df, ip, out), **{out: F.col(out)})


#: Canonical text of an IPv6 address, its last 32 bits dotted or not.
IPV6_SHAPE = r"^[0-9a-f:]*:[0-9a-f]*$|^[0-9a-f:]*:(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"


def prefix_bits(family: Column, hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """The first ``bits`` bits of a key, as two longs."""
    zero = F.lit(0).cast("bigint")
    first = (F.when(family == 4, _shift(hi, 32 - bits)).when(bits == 0, zero).when(bits <= 64, _shift(hi, 64 - bits)).otherwise(hi))
    return first, F.when((family == 6) & (bits > 64), _shift(lo, 128 - bits)).otherwise(zero)


def signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def number_key(number: int, family: int) -> tuple[int, int]:
    """(hi, lo) as in ``address_key``."""
    return (number, 0) if family == 4 else (signed(number >> 64), signed(number & (1 << 64) - 1))


def in_networks(key: Column, cidrs: Iterable[str]) -> Column:
    """Membership of an address key in a fixed list of networks of either family; false for no address."""
    out = F.lit(False)
    for c in cidrs:
        net = ipaddress.ip_network(c, strict=False)
        if net.version == 4:
            out = out | ((key["family"] == 4) & key["hi"].between(*cidr_bounds(c)))
            continue
        hi, lo = number_key(int(net.network_address), 6)
        mine, own = (prefix_bits(F.lit(6), h, low, F.lit(net.prefixlen)) for h, low in ((key["hi"], key["lo"]), (F.lit(hi).cast("bigint"), F.lit(lo).cast("bigint"))))
        out = out | ((key["family"] == 6) & (mine[0] == own[0]) & (mine[1] == own[1]))
    return F.coalesce(out, F.lit(False))


def with_routability(df: DataFrame, ip: str) -> DataFrame:
    """Adds ``unroutable`` (cannot appear in public transit; IPv4 inside IPv6 - mapped, 6to4, NAT64 - is judged as IPv4) and
    ``public`` where they are missing; ``ip`` is canonical text."""
    if {"unroutable", "public"} <= set(df.columns):
        return df
    key = F.col("_key")
    hi, lo = key["hi"], key["lo"]
    low = lambda x: x.bitwiseAND(0xFFFFFFFF)
    inner = (F.when(key["family"] == 4, hi).when((hi == 0) & (_shift(lo, 32) == 0xFFFF), low(lo)).when(_shift(hi, 48) == 0x2002, low(_shift(hi, 16)))
             .when((hi == 0x64FF9B << 32) & (_shift(lo, 32) == 0), low(lo)))
    df = _with_key(df, ip, "_key").withColumn("_inner", inner)
    v4 = F.lit(False)
    for c in fx.UNROUTABLE_V4:
        v4 = v4 | F.col("_inner").between(*cidr_bounds(c))
    bad = F.coalesce(F.when(F.col("_inner").isNotNull(), v4).otherwise(in_networks(key, fx.UNROUTABLE_V6)), F.lit(False))
    df = df.withColumns({"_bad": bad, "_known": key.isNotNull()})
    return settled(df, unroutable=F.col("_bad"), public=F.col("_known") & ~F.col("_bad")).drop("_key", "_inner", "_known", "_bad")


def _prefixes(first: int, last: int, width: int):
    """Aligned prefixes (bits, first address) that make up a range: 2 * width at most."""
    while first <= last:
        size = first & -first if first else 1 << width
        while first + size - 1 > last:
            size >>= 1
        yield width - size.bit_length() + 1, first
        first += size


def _sortable(number: int) -> tuple[int, int]:
    """128 bits as two longs that sort as the number does."""
    return (number >> 64) - (1 << 63), (number & (1 << 64) - 1) - (1 << 63)


_PREFIX = T.StructType([T.StructField("family", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType())])
_NETWORK = T.StructType([T.StructField("parts", T.ArrayType(_PREFIX)), T.StructField("specific", T.ArrayType(T.LongType()))])


def _network(first: str, last: str):
    """Prefixes of a range of addresses of one family (or of a CIDR), and its size and start as a sort key; None if it cannot be read."""
    try:
        if "/" in first:
            net = ipaddress.ip_network(first, strict=False)
            a, b, version = int(net.network_address), int(net.broadcast_address), net.version
        else:
            x, y = ipaddress.ip_address(first), ipaddress.ip_address(last)
            if x.version != y.version or x > y:
                return None
            a, b, version = int(x), int(y), x.version
    except ValueError:
        return None
    width = 32 if version == 4 else 128
    parts = []
    for bits, start in _prefixes(a, b, width):
        top = start >> width - bits
        p1, p2 = (top, 0) if width == 32 or bits <= 64 else (start >> 64, top & (1 << bits - 64) - 1)
        parts.append({"family": version, "bits": bits, "p1": signed(p1), "p2": signed(p2)})
    return {"parts": parts, "specific": [*_sortable(b - a), *_sortable(a)]}


@F.pandas_udf(_NETWORK)
def network_parts(first: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [_network(a.strip(), (b or a).strip()) if a is not None else None for a, b in zip(first, last, strict=True)]
    return pd.DataFrame([f or {"parts": None, "specific": None} for f in found], columns=["parts", "specific"])


def _canonical(text: str) -> str | None:
    try:
        return str(ipaddress.IPv6Address(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _ipv6(s: pd.Series) -> pd.Series:
    known = {v: _canonical(v) for v in s.dropna().unique()}
    return pd.Series([known.get(v) for v in s], dtype=object)


def with_ip_facts(df, raw: str, ip: str = "ip"):
    """Adds ``ip`` (canonical text or NULL), ``unroutable``, ``public``."""
    df = df.withColumn("_v", F.regexp_replace(F.lower(F.trim(F.col(raw))), "^ipv6:", ""))
    v = F.col("_v")
    df = df.withColumn("_v6", _ipv6(F.when(v.contains(":"), v)))
    df = df.withColumn(ip, F.when(v.contains(":"), F.col("_v6")).when(v.rlike(IPV4), v))
    return with_routability(df.drop("_v6", "_v", "unroutable", "public"), ip)
