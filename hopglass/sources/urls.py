"""URL extraction, un-wrapping and flags (S07-S11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.text import rx

# Hosts of link-rewriting products and the query parameters that carry the target.
REWRITER_PARAMETERS = [
    (r"(^|\.)safelinks\.protection\.outlook\.com$", ["url"]),
    (r"(^|\.)linkprotect\.cudasvc\.com$", ["a"]),
    (r"\.zscaler\.(net|com)$", ["url"]),
    (r"(^|\.)clicktime\.symantec\.com$", ["u"]),
    (r"(^|\.)clean\.mx$|(^|\.)inky\.com$", ["url", "u"]),
]
ANY_REWRITER = (r"safelinks\.protection\.outlook\.com|cudasvc\.com|zscaler\.|clicktime\.symantec\.com|clean\.mx|inky\.com"
                r"|urldefense\.|secure-web\.cisco\.com|google\.com/url\?")
MAX_LAYERS = 5


def host_of(url: Column) -> Column:
    """Lower-case host; NULL when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _decoded(v: Column) -> Column:
    return F.coalesce(F.try_url_decode(v), v)


def _target(v: Column) -> Column:
    return F.when(v.rlike(r"(?i)^https?://"), v)


def _parameter(url: Column, name: str) -> Column:
    raw = F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    once = _decoded(raw)
    return F.when(once.contains("%"), _target(_decoded(F.regexp_replace(once, r"\+", "%2B")))).otherwise(_target(once))


def unwrap_once(url: Column) -> Column:
    """The real target of one rewriting layer, or the url itself."""
    host = host_of(url)
    out = F.when(host.rlike(r"(^|\.)urldefense\.proofpoint\.com$"), _target(_decoded(F.translate(
        F.nullif(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1), F.lit("")), "-_", "%/"))))
    for pattern, names in REWRITER_PARAMETERS:
        out = out.when(host.rlike(pattern), F.coalesce(*[_parameter(url, n) for n in names]))
    out = (out.when(host.rlike(r"(^|\.)google\.com$") & url.rlike(r"(?i)^https?://[^/]+/url(\?|$)"), F.coalesce(_parameter(url, "q"), _parameter(url, "url")))
           .when(host.rlike(r"(^|\.)urldefense\.com$"), _decoded(F.nullif(F.regexp_extract(url, r"/v3/__(.+?)__;", 1), F.lit(""))))
           .when(host.rlike(r"(^|\.)secure-web\.cisco\.com$"), _decoded(F.nullif(F.regexp_extract(url, r"(?i)^https?://[^/]+/[^/]+/(https?%3a%2f%2f[^?#]+)", 1), F.lit("")))))
    return F.coalesce(out, url)


def unwrapped(url: Column, layers: int = MAX_LAYERS) -> Column:
    """Up to ``layers`` layers.  Ordinary links are passed through by one cheap test, and
    the fold keeps the expression at the size of a single layer."""
    layer = lambda u: F.when(u.rlike("(?i)" + ANY_REWRITER), unwrap_once(u)).otherwise(u)
    return F.aggregate(F.array_repeat(F.lit(1), layers), url, lambda u, _: layer(u))


def still_wrapped(url: Column) -> Column:
    """Whether a url that went through ``unwrapped`` hides a further target."""
    return F.coalesce(url.rlike("(?i)" + ANY_REWRITER) & (unwrap_once(url) != url), F.lit(False))


def url_candidates(messages: DataFrame) -> DataFrame:
    """Anchors in document order, then URLs of the text, one row each."""
    html, body = F.coalesce("body_html", F.lit("")), F.coalesce("body_text", F.lit(""))
    part = lambda i: F.regexp_extract_all(html, F.lit(rx(fx.ANCHOR_PATTERN)), F.lit(i))
    anchors = F.transform(F.arrays_zip(part(1).alias("href"), part(2).alias("text")), lambda a: F.struct(
        a["href"].alias("url"), F.trim(F.regexp_replace(F.regexp_replace(a["text"], fx.TAG_PATTERN, ""), r"\s+", " ")).alias("text"), F.lit(True).alias("anchor")))
    plain = F.transform(F.regexp_extract_all(body, F.lit(rx(fx.URL_PATTERN)), F.lit(0)),
                        lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("anchor")))
    # outer, so that no "not empty" predicate is inferred that would match twice
    return (messages.select("case_id", F.posexplode_outer(F.concat(anchors, plain)).alias("pos", "c")).filter(F.col("c").isNotNull())
            .select("case_id", "pos", "c.url", "c.text", "c.anchor"))


def extract_urls(messages: DataFrame, layers: int = MAX_LAYERS) -> DataFrame:
    """The URL table of messages; the first occurrence of a URL wins.  ``still_wrapped`` marks a URL that more than
    ``layers`` rewriting services have wrapped."""
    df = url_candidates(messages).withColumn("url", unwrapped(F.col("url"), layers))
    df = df.filter(~F.col("anchor") | F.lower("url").startswith("http"))
    shown = F.regexp_extract_all("text", F.lit(rx(fx.URL_PATTERN)), F.lit(0))
    host = host_of(F.col("url"))
    other = F.exists(shown, lambda t: host_of(t).isNotNull() & host.isNotNull() & (host_of(t) != host))
    df = df.withColumn("mismatched_anchor", F.coalesce(F.col("anchor") & other, F.lit(False)))
    df = df.withColumn("url", F.regexp_replace(F.trim("url"), r"[.,;:)\]]+$", "")).filter(F.col("url") != "")
    first = F.min_by(F.struct(F.nullif("text", F.lit("")).alias("display_text"), "mismatched_anchor", "pos"), "pos")
    once = df.groupBy("case_id", "url").agg(first.alias("f")).select("case_id", "f.pos", "url", host_of(F.col("url")).alias("domain"), "f.display_text", "f.mismatched_anchor")
    once = once.withColumn("still_wrapped", still_wrapped(F.col("url")))
    return once.withColumn("is_shortened", F.coalesce(F.col("domain").isin(fx.SHORTENERS), F.lit(False)))
