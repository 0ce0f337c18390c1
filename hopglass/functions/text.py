"""Text expressions (C01-C04) that stay inside the JVM; NFKC is the only UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import fixed_values as fx

_W = "A-Za-z0-9_"
# \b in java.util.regex depends on the runtime; the patterns mean ASCII words.
_ASCII_BOUNDARY = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"


def _ways(group: str) -> tuple[list[str], str]:
    """What the alternatives of a leading group say, each up to the group's end, and what follows it."""
    at = depth = 0
    begins = [3 if group.startswith("(?:") else 1]
    while at < len(group):
        c = group[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = group.index("]", at + 2)
        elif c == "|" and depth == 1:
            begins.append(at + 1)
        depth += {"(": 1, ")": -1}.get(c, 0)
        at += 1
        if depth == 0:
            break
    return [group[i : at - 1] for i in begins], group[at:]


def _first_letters(rest: str) -> str | None:
    """The ASCII letters and digits (as in a character class) with one of which every match begins; None if they are not plain to see."""
    if rest.startswith(("(?:", "(")) and not re.match(r"\(\?[^:]", rest):
        ways, after = _ways(rest)
        found = [_first_letters(w) for w in ways]
        letters = None if None in found else "".join(found)
    elif item := re.match(r"\\d|\[([A-Za-z0-9-]+)\]|[A-Za-z0-9]", rest):
        letters, after = "0-9" if item[0] == r"\d" else item[1] or item[0], rest[item.end() :]
    else:
        return None
    if letters is None or re.match(r"\*|\{[0,]", after):
        return None
    if after.startswith("?"):
        more = _first_letters(after[1:])
        return None if more is None else letters + more
    return letters


@cache
def rx(pattern: str, ignore_case: bool = True) -> str:
    """Java form of a pattern: ASCII word boundaries, optional case folding.  Where only certain letters can follow a boundary at the
    start, they are looked for first, as the look behind costs most."""
    head = ""
    if pattern.startswith(r"\b") and (letters := _first_letters(pattern[2:])):
        head, pattern = f"(?=[{letters}])(?<![{_W}])", pattern[2:]
    return ("(?i)" if ignore_case else "") + head + pattern.replace(r"\b", _ASCII_BOUNDARY)


def matches(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(rx(pattern)), F.lit(False))


def settled(df, **cols: Column):
    """Add columns behind a one-element explode.  Filters and later stages then read
    finished values instead of having the expressions copied into them."""
    pack = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, pack.alias("_s")).select(*rest, "_s.*")


def any_of(col: Column, literals: list[str]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(col, F.lit(x))
    return out


def matches_folded(col: Column, pattern: str) -> Column:
    """``matches`` on lower-case text: plain substring tests decide most rows before
    the regular expression is tried."""
    return any_of(col, fx.NEEDS[pattern]) & matches(col, pattern) if pattern in fx.NEEDS else matches(col, pattern)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


#: Characters that the compatibility fold leaves alone, alone and next to each other: ASCII, letters of western Europe, basic
#: Cyrillic, dashes and quotation marks.
STABLE = r"\x00-\x7F\u00A1\u00A7\u00AB\u00BB\u00BF-\u00FF\u0400-\u045F\u2013\u2014\u2018-\u201E"
#: All others, spelled out: a class negated over many ranges takes the regular expressions of Java ten times as long.
UNSTABLE = r"\u0080-\u00A0\u00A2-\u00A6\u00A8-\u00AA\u00AC-\u00BA\u00BC-\u00BE\u0100-\u03FF\u0460-\u2012\u2015-\u2017\u201F-\x{10FFFF}"


def nfkc(col: Column) -> Column:
    """Compatibility fold.  Texts of STABLE characters never leave the JVM: they reach the UDF as
    NULL and are taken from the input column.  Pass a plain column: the input is
    named more than once."""
    needs = F.when((F.length(col) != F.octet_length(col)) & col.rlike(f"[{UNSTABLE}]"), col)
    return F.coalesce(_nfkc(needs), col)


def strip_invisible(col: Column) -> Column:
    return F.regexp_replace(col, f"[{fx.INVISIBLE}]", "")


def fold_confusables(col: Column) -> Column:
    return F.translate(col, fx.TEXT_CONFUSABLE_FROM, fx.TEXT_CONFUSABLE_TO)


def canonical(col: Column) -> Column:
    """NFKC, no invisibles, look-alikes to Latin, lower case."""
    return F.lower(fold_confusables(strip_invisible(nfkc(F.coalesce(col, F.lit(""))))))


def strip_zero_width(col: Column) -> Column:
    return F.regexp_replace(col, f"[{fx.ZERO_WIDTH}]", "")


def normalized(col: Column) -> Column:
    return strip_zero_width(nfkc(F.coalesce(col, F.lit(""))))


def mixed_script_words(col: Column) -> Column:
    """Tokens whose letters come from two or more of Latin, Cyrillic, Greek.

    Text without Cyrillic or Greek letters is settled by one scan and never
    tokenised."""
    script = lambda w, name: w.rlike(rf"[\p{{L}}&&\p{{Is{name}}}]").cast("int")
    mixed = lambda w: script(w, "Latin") + script(w, "Cyrillic") + script(w, "Greek") > 1
    words = F.filter(F.split(col, r"\s+"), mixed)
    return F.when(col.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), words).otherwise(F.array().cast("array<string>"))


def invisible_runs(col: Column) -> Column:
    """Runs of invisible characters between two word characters."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_count(col, F.lit(f"(?<={word})[{fx.INVISIBLE}]+(?={word})"))


def with_obfuscation_report(df, text: str, out: str = "report"):
    """Mixed-script words and invisible runs of a text column."""
    df = df.withColumn("_mixed", mixed_script_words(F.col(text))).withColumn("_runs", invisible_runs(F.col(text)))
    report = F.struct(F.col("_mixed").alias("mixed_script_words"), F.size("_mixed").alias("mixed_script_count"),
                      F.col("_runs").alias("invisible_runs"), ((F.size("_mixed") > 0) | (F.col("_runs") >= 1)).alias("obfuscated"))
    return df.withColumn(out, report).drop("_mixed", "_runs")


def strip_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, fx.TAG_PATTERN, " "), r"\s+", " "))


def hidden_text(html: Column) -> Column:
    """Inner text of elements whose style or attribute hides them."""
    marked = F.when(any_of(F.lower(html), fx.HIDDEN_MARKERS), html)
    inner = F.regexp_extract_all(marked, F.lit(rx(fx.HIDDEN_ELEMENT_PATTERN)), F.lit(2))
    parts = F.filter(F.transform(inner, strip_tags), lambda p: p != "")
    return F.coalesce(F.trim(F.array_join(parts, " ")), F.lit(""))
