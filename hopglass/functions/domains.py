"""Domain expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as fx
from .text import nfkc


def domain_of(addr: Column) -> Column:
    """Part after the last @, trimmed and lower-cased; NULL without an @."""
    return F.when(addr.contains("@"), F.lower(F.trim(F.substring_index(addr, "@", -1))))


def _clean(host: Column) -> Column:
    return F.btrim(F.lower(host), F.lit(". "))


class _Node:
    """A place in the character trie of reversed rules."""
    __slots__ = ("below", "ends", "wild", "except_")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.ends, self.wild, self.except_ = False, False, []

    def at(self, path: str) -> _Node:
        node = self
        for c in path:
            node = node.below.setdefault(c, _Node())
        return node

    def pattern(self) -> str:
        """Exceptions first, then longer rules, then a wildcard, then the rule that ends here."""
        ways = [rf"(?=\.{re.escape(x)}(?:\.|$))" for x in sorted(self.except_)]
        ways += [re.escape(c) + self.below[c].pattern() for c in sorted(self.below)]
        ways += [LABEL] if self.wild else []
        ways += [r"(?![^.])"] if self.ends else []
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


LABEL = r"[^.:\s]+"


def _trie_pattern(rules: list[str]) -> str:
    """Pattern over a reversed host: its public suffix (without backing down to a shorter one) and one label more."""
    root = _Node()
    for rule in rules:
        labels = rule.lstrip("!").split(".")[::-1]
        path = ".".join(x[::-1] for x in labels)
        if rule.startswith("!"):
            root.at(".".join(x[::-1] for x in labels[:-1])).except_.append(labels[-1][::-1])
        elif labels[-1] == "*":
            root.at(path[:-1]).wild = True
        else:
            root.at(path).ends = True
    trie = root.pattern() + "|" if root.below else ""
    return rf"^((?>{trie}{LABEL})\.{LABEL})(?![^.])"


@dataclass(frozen=True)
class SuffixRules:
    """Public-suffix rules compiled to patterns, so that lanes need neither a join nor Python per host."""
    every: str
    public: str

    @staticmethod
    def of(rules: Iterable[tuple[str, bool]]) -> SuffixRules:
        """From (rule, private): ``co.uk``, ``*.ck`` (any one label more), ``!www.ck`` (not one after all)."""
        rows = [(r.strip().strip(".").lower(), bool(private)) for r, private in rules if r and r.strip().strip(".")]
        return SuffixRules(_trie_pattern([r for r, _ in rows]), _trie_pattern([r for r, private in rows if not private]))


#: Rules that may be compiled; the public list holds about 10,000.  A larger table is joined (``registrable_by_table``).
MAX_RULES = 100_000


def suffix_rules(table: DataFrame, most: int = MAX_RULES) -> SuffixRules:
    """Compiled rules of a table (rule string, private boolean), whose size is checked before it reaches the driver."""
    rows = table.select("rule", F.coalesce("private", F.lit(False))).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} suffix rules: join them with registrable_by_table")
    return SuffixRules.of([tuple(r) for r in rows])


@cache
def built_in_rules() -> SuffixRules:
    """For a call without a table: a starter set only."""
    return SuffixRules.of([(r, False) for r in fx.TWO_LABEL_SUFFIXES] + [(r, True) for r in fx.PRIVATE_SUFFIXES])


def registrable(host: Column, rules: SuffixRules | None = None, private: bool = True) -> Column:
    """eTLD+1; NULL for a bare suffix or an address.  Hosts without a listed suffix use their last label.
    A single regular expression, so the host is evaluated once."""
    rules = rules or built_in_rules()
    back = F.reverse(_clean(host))
    found = F.regexp_extract(back, rules.every if private else rules.public, 1)
    return F.nullif(F.when(~back.rlike(r"^[0-9]+(?:\.|$)"), F.reverse(found)), F.lit(""))


def registrable_by_table(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """eTLD+1 against a rule table of any size (column ``rule``): every distinct host is expanded to its endings, joined, and
    an exception or else the rule of most labels wins.  Hosts without a listed suffix use their last label."""
    h = hosts.select(_clean(F.col(host)).alias("host")).filter(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    cand = h.select("host", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("i", "ending"))
    rule = F.lower(F.btrim("rule", F.lit(" .")))
    kind = F.when(rule.startswith("!"), 1).when(rule.startswith("*."), -1).otherwise(0)
    known = rules.select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("ending"), kind.alias("shift")).distinct()
    # 1-based label at which the suffix starts: one label on for an exception, one back for a wildcard
    j = cand.join(known, "ending", "left").withColumn("i", F.col("i") + 1)
    longest = j.groupBy("host").agg(F.min(F.when((F.col("shift") <= 0) & (F.col("i") + F.col("shift") >= 1), F.col("i") + F.col("shift"))).alias("rule_at"),
                                    F.min(F.when(F.col("shift") == 1, F.col("i") + 1)).alias("except_at"), F.max("i").alias("last"))
    at = F.coalesce("except_at", "rule_at", "last") - 1
    org = F.when((at >= 1) & ~F.element_at(labels, -1).rlike("^[0-9]+$"), F.concat_ws(".", F.slice(labels, F.greatest(at, F.lit(1)), F.size(labels))))
    return longest.select("host", org.alias("org_domain"))


def same_org(a: Column, b: Column, rules: SuffixRules | None = None, private: bool = True) -> Column:
    """Identical, or the same organisational domain; false when either is missing."""
    return F.coalesce((F.lower(a) == F.lower(b)) | (registrable(a, rules, private) == registrable(b, rules, private)), F.lit(False))


def suffix_related(a: Column, b: Column) -> Column:
    """Equal, or one is a subdomain of the other."""
    a, b = F.lower(a), F.lower(b)
    return F.coalesce((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)), F.lit(False))


def skeleton(host: Column) -> Column:
    """NFKC, lower case, look-alikes and digits folded to Latin letters."""
    return F.translate(F.lower(nfkc(host)), fx.DOMAIN_CONFUSABLE_FROM, fx.DOMAIN_CONFUSABLE_TO)


def tokens(skel: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(F.split(skel, r"[.\-]"), lambda t: F.length(t) >= least))


def parts(skel: Column) -> Column:
    return F.array_distinct(F.filter(F.split(skel, r"[.\-_]"), lambda t: t != ""))
