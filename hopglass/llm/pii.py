"""Operator 1: personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans (email, ip, card, phone) come from fixed patterns and checks.  High-recall generators, one per kind, propose further
and overlapping spans (written-out addresses, dotted quads with brackets, long digit groups, numbers without a country code).
Each candidate is described by small whole numbers: its format (digits, groups, separators, checks) and its context (neighbouring
characters, words before it).  Boosted trees learn from all candidates of the corpus which look like base spans: an aggregate
counts candidates by (kind, features), a table whose size the feature ranges bound, and the trees are fitted to those counts.
Per kind, the threshold is the lowest score at which, among the candidates of held-out documents, the share of base spans is
PRECISION; candidates at or above it that touch no base span are added.  Base spans always stay.

Positions are code points, ends exclusive.  A null text is empty and has no spans.  Repeated rows are handled each; columns with
any other names are left alone.  Without candidates no trees are grown and only base spans are found; an empty table gives no rows.

Patterns keep their meaning where they are made possessive or may start at the head of a run only: within a run of the first
class every start has the same continuation, so this only spares time on long runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table_cut

KINDS = ["email", "ip", "card", "phone"]
#: Trees, their depth and step, and the share of base spans that a threshold must show on held-out documents.
TREES, DEPTH, STEP, PRECISION = 20, 3, 0.3, 0.95
SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"

# Fixed patterns of the base kinds.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before the pattern is worth a search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\[?\.\]?[0-9]++){2,4}+",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20.-]{0,2}[0-9]){11,22}+",
    "phone": r"(?:(?<![0-9+])|\G)\+?\(?[0-9]{1,4}+(?:[\x20()./-]{1,3}[0-9]{2,8}+){1,5}+",
}
GENERATOR_NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\[?\.", "card": r"[0-9](?:[\x20.-]{0,2}[0-9]){11}", "phone": r"[0-9][\x20()./-]{1,3}[0-9]{2}"}
#: Words that stand before personal data of the kinds, in four languages.
CUES = r"(?:mail|contact|write|escrib|correo|ip|host|server|adress|address|card|visa|carte|tarjeta|karte|tel|phone|call|fax|mobil|llam|appel|ruf)[^\n]{0,12}$"


def walked(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Matches of the pattern that pass, with their places: one walk along the gaps between matches and the matches."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), hit.alias("hit")))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("pos"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def small_parts(hit: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(hit, r"[\[\]]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def luhn(hit: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits(hit)), F.lit(False))


CHECKS = {"email": lambda h: F.lit(True), "ip": small_parts, "card": lambda h: F.length(digits(h)).between(13, 19) & luhn(h), "phone": lambda h: F.length(digits(h)).between(9, 15)}


def base_spans(text: Column, kind: str) -> Column:
    return F.when(text.rlike(NEEDS[kind]), walked(text, BASE[kind], CHECKS[kind])).otherwise(F.array().cast(SPANS))


def plainer(hit: Column) -> Column:
    """Without country-code sign and square brackets, so that written-out forms resemble plain ones."""
    return F.regexp_replace(hit, r"[+\[\]]", "")


#: Features: name, number of values, value of a candidate (hit, start, end) of the text.
FEATURES: list[tuple[str, int, Callable]] = [
    ("digits", 24, lambda t, c: F.least(F.length(digits(c["hit"])), F.lit(23))),
    ("groups", 8, lambda t, c: F.least(F.size(F.split(plainer(c["hit"]), r"[^0-9A-Za-z]+")), F.lit(7))),
    ("letters", 4, lambda t, c: F.least(F.length(F.regexp_replace(c["hit"], "[^A-Za-z]", "")).cast("int"), F.lit(3))),
    ("marks", 6, lambda t, c: F.least(F.length(F.regexp_replace(plainer(c["hit"]), r"[A-Za-z0-9\x20]", "")), F.lit(5))),
    ("spaces", 4, lambda t, c: F.least(F.length(F.regexp_replace(c["hit"], r"[^\x20]", "")), F.lit(3))),
    ("checksum", 2, lambda t, c: luhn(c["hit"]).cast("int")),
    ("bytes", 2, lambda t, c: small_parts(c["hit"]).cast("int")),
    ("suffix", 2, lambda t, c: c["hit"].rlike(r"(?:\.|[\])]\x20?)[A-Za-z]{2,}$").cast("int")),
    ("joined_before", 2, lambda t, c: F.when(c["start"] > 0, t.substr(c["start"].cast("int"), F.lit(1)).rlike(r"[\p{L}\p{N}_]")).otherwise(False).cast("int")),
    ("joined_after", 2, lambda t, c: t.substr((c["end"] + 1).cast("int"), F.lit(1)).rlike(r"[\p{L}\p{N}_]").cast("int")),
    ("cue", 2, lambda t, c: F.lower(t.substr(F.greatest(c["start"] - 23, F.lit(1)).cast("int"), (c["start"] - F.greatest(c["start"] - 24, F.lit(0))).cast("int"))).rlike(CUES).cast("int")),
]
NAMES = ["kind", *(name for name, _, _ in FEATURES)]


def candidates(text: Column, kind: str, base: Column) -> Column:
    """Candidates of the kind: start, end, whether a base span, and the features."""
    found = F.when(text.rlike(GENERATOR_NEEDS[kind]), walked(text, GENERATORS[kind], lambda h: F.lit(True))).otherwise(F.array().cast(SPANS))
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.exists(base, lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])).cast("int").alias("is_base"),
                                                 F.lit(KINDS.index(kind)).alias("kind"), *(F.coalesce(value(text, c).cast("int"), F.lit(0)).alias(name) for name, _, value in FEATURES)))


def proposed(rows: DataFrame, text: str, into: str = "") -> DataFrame:
    """rows with the columns base_<kind> (spans) and candidates, their names preceded by ``into``."""
    rows = rows.withColumns({f"{into}base_{k}": base_spans(F.col(text), k) for k in KINDS})
    return rows.withColumn(f"{into}candidates", F.concat(*(candidates(F.col(text), k, F.col(f"{into}base_{k}")) for k in KINDS)))


# ---------------------------------------------------------------- boosted trees over counted cells

def grow(cells: list[tuple], gradient: list[float], weight: list[float], rows: list[int], depth: int):
    """A tree as (feature, bound, tree below the bound, tree from it) or a leaf value; splits by the usual second-order gain."""
    g, h = sum(gradient[i] for i in rows), sum(weight[i] for i in rows)
    leaf, best = g / (h + 1), (1e-6, None, None)
    if depth:
        for f in range(len(NAMES)):
            by: dict[int, list[float]] = {}
            for i in rows:
                sums = by.setdefault(cells[i][f], [0.0, 0.0])
                sums[0] += gradient[i]
                sums[1] += weight[i]
            gl = hl = 0.0
            for value, following in zip(sorted(by), sorted(by)[1:], strict=False):
                gl, hl = gl + by[value][0], hl + by[value][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = gain, f, following
    _, f, bound = best
    if f is None:
        return leaf
    return f, bound, grow(cells, gradient, weight, [i for i in rows if cells[i][f] < bound], depth - 1), grow(cells, gradient, weight, [i for i in rows if cells[i][f] >= bound], depth - 1)


def value_of(tree, cell: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] < tree[1] else tree[3]
    return tree


def boosted(cells: list[tuple], n: list[int], positive: list[int]) -> list:
    """Trees by Newton boosting of the logistic loss; cells with n candidates, ``positive`` of which are base spans."""
    trees, margin = [], [0.0] * len(cells)
    for _ in range(TREES if cells else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = grow(cells, [k - c * q for k, c, q in zip(positive, n, p, strict=True)], [c * q * (1 - q) for c, q in zip(n, p, strict=True)], [i for i in range(len(cells)) if n[i]], DEPTH)
        trees.append(tree)
        margin = [m + STEP * value_of(tree, c) for m, c in zip(margin, cells, strict=True)]
    return trees


def margin_of(trees: list, cell: tuple) -> float:
    return sum(STEP * value_of(t, cell) for t in trees)


class Selector:
    """Trees and a threshold per kind (None adds nothing)."""

    def __init__(self, trees: list, thresholds: dict[str, float | None]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fitted(cls, proposals: DataFrame, doc_id: str = "doc_id", column: str = "candidates") -> Selector:
        """From the counts of all candidates by features; a quarter of the documents, by hash, is held out for the thresholds."""
        one = proposals.select(F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(4)) == 0, F.lit(False)).alias("held"), F.explode(column).alias("c"))
        counted = one.groupBy("held", *(F.col(f"c.{n}").alias(n) for n in NAMES)).agg(F.count("*").alias("n"), F.sum("c.is_base").alias("positive")).collect()  # bounded by the features' ranges
        counted.sort(key=lambda r: tuple(r))
        learn = [r for r in counted if not r["held"]]
        trees = boosted([tuple(r[n] for n in NAMES) for r in learn], [r["n"] for r in learn], [r["positive"] for r in learn])
        thresholds: dict[str, float | None] = dict.fromkeys(KINDS)
        for k, kind in enumerate(KINDS):
            scored = sorted(((margin_of(trees, tuple(r[n] for n in NAMES)), r["n"], r["positive"]) for r in counted if r["held"] and r["kind"] == k), reverse=True)
            n = positive = 0
            for i, (m, count, hits) in enumerate(scored):
                n, positive = n + count, positive + hits
                if (i + 1 == len(scored) or scored[i + 1][0] < m) and positive >= PRECISION * n:
                    thresholds[kind] = m
        return cls(trees, thresholds)

    def _tree(self, tree, c: Column) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(c[NAMES[tree[0]]] < tree[1], self._tree(tree[2], c)).otherwise(self._tree(tree[3], c))

    def chosen(self, c: Column) -> Column:
        """Whether a candidate reaches its kind's threshold."""
        margin = reduce(lambda a, b: a + b, (F.lit(STEP) * self._tree(t, c) for t in self.trees), F.lit(0.0))
        bound = reduce(lambda a, k: F.when(c["kind"] == KINDS.index(k), F.lit(self.thresholds[k] - 1e-9)).otherwise(a), [k for k in KINDS if self.thresholds[k] is not None], F.lit(float("inf")))
        return margin >= bound

    def spans(self, into: str = "") -> Column:
        """All spans (kind number, start, end), by kind as listed and then start."""
        base = {k: F.col(f"{into}base_{k}") for k in KINDS}
        touches = lambda c: reduce(lambda a, b: a | b, (F.exists(base[k], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) for k in KINDS))
        span = lambda kind: lambda x: F.struct((x["kind"] if kind is None else F.lit(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        own = [F.transform(base[k], span(i)) for i, k in enumerate(KINDS)]
        if not self.trees or not any(t is not None for t in self.thresholds.values()):
            return F.concat(*own)
        added = F.filter(F.col(f"{into}candidates"), lambda c: self.chosen(c) & ~touches(c))
        return F.array_sort(F.concat(*own, F.transform(added, span(None))))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts of base spans, base_sha256, spans, and the number of spans added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = table_cut(proposed(rows, "text").drop("text"))
    selector = Selector.fitted(rows)
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    base = written(Selector([], {}).spans())
    rows = rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), written(selector.spans()).alias("spans"), selector.spans().alias("all"))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", (F.size("all") - sum(F.col(f"n_{k}") for k in KINDS)).alias("n_added"))


def covered(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = text.substr((acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), F.concat(acc["out"], between, F.element_at(names, s["kind"] + 1)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], text.substr((acc["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, zero, step, rest)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text`` and ``n_chars`` set to the new length; the other columns as they are."""
    whole = docs.select(F.struct("*").alias("__row"))
    rows = proposed(whole.withColumn("__text", F.coalesce("__row.text", F.lit(""))), "__text", "__")
    selector = Selector.fitted(rows.select(F.col("__row.doc_id").alias("__doc_id"), "__candidates"), "__doc_id", "__candidates")
    rows = rows.withColumn("__new", covered(F.col("__text"), selector.spans("__")))
    changed = {"text": F.when(F.col("__row.text").isNotNull(), F.col("__new")), "n_chars": F.when(F.col("__row.text").isNotNull(), F.length("__new").cast("long")).otherwise(F.col("__row.n_chars"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
