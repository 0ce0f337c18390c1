"""Sender footprint lane (F01-F06) over breach and registration tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fx
from ..functions.domains import domain_of
from .evidence import emit, row
from .lookup import join_facts


def disposable(addr: Column) -> Column:
    """sender domain is a disposable-mail provider."""
    return F.coalesce(domain_of(addr).isin(fx.DISPOSABLE_DOMAINS), F.lit(False))


def breach_platforms(breaches: DataFrame) -> DataFrame:
    """breach names as platforms: aggregator dumps dropped, names compared
    without case, the first spelling kept."""
    name = F.trim("name")
    bulk = "|".join(re.escape(a).replace(r"\ ", " ").replace(r"\#", "#") for a in fx.BREACH_AGGREGATORS)
    return (breaches.select("email", name.alias("name"), "seq").filter((F.col("name") != "") & ~F.lower("name").rlike(bulk))
            .groupBy("email", F.lower("name").alias("key")).agg(F.min_by("name", "seq").alias("platform"))
            .select("email", "platform"))


def breach_summary(breaches: DataFrame, as_of_year: int) -> DataFrame:
    """number of breaches, first, last and years in use."""
    s = breaches.groupBy("email").agg(F.count("*").alias("breach_count"), F.min("breach_date").alias("earliest"), F.max("breach_date").alias("latest"))
    return s.withColumn("age_years", F.greatest(F.lit(0), F.lit(as_of_year) - F.year("earliest")))


def merged_registrations(registrations: DataFrame, platforms: DataFrame) -> DataFrame:
    """one row per (email, platform); registered beats the rest, then the
    first source.  A breach on a platform counts as a registration."""
    breach = platforms.select("email", "platform", F.lit("registered").alias("status"), F.lit(100).alias("source"), F.lit(0).cast("long").alias("seq"))
    all_rows = registrations.select("email", "platform", "status", F.col("source").cast("int").alias("source"), "seq").unionByName(breach)
    best = F.min_by(F.struct("status", "source"), F.struct(F.col("status") != "registered", F.col("source"), F.col("seq")))
    return all_rows.groupBy("email", "platform").agg(best.alias("b")).select("email", "platform", "b.status", "b.source")


def footprint_facts(breaches: DataFrame, registrations: DataFrame, as_of_year: int) -> DataFrame:
    """F03/F04 folded to one row per address."""
    reg = (merged_registrations(registrations, breach_platforms(breaches)).filter(F.col("status") == "registered")
           .groupBy("email").agg(F.count("*").alias("registered_count")))
    return (reg.join(breach_summary(breaches, as_of_year), "email", "full_outer")
            .select("email", F.coalesce("registered_count", F.lit(0)).alias("registered_count"),
                    F.coalesce("breach_count", F.lit(0)).alias("breach_count"), "earliest", "latest", "age_years"))


def identity_credit() -> Column:
    """credit earned by a footprint, NULL without one."""
    reg, breaches, age = F.col("registered_count"), F.col("breach_count"), F.col("age_years")
    aged = F.coalesce(age >= 2, F.lit(False))
    known = (F.coalesce(reg, F.lit(0)) >= 1) | (F.coalesce(breaches, F.lit(0)) > 0) | aged
    strong = ((F.coalesce(reg, F.lit(0)) >= 3) | (F.coalesce(breaches, F.lit(0)) >= 5)) & aged
    return F.when(known & strong, "established_sender_identity").when(known, "known_footprint_sender")


def footprint_lane(messages: DataFrame, facts: DataFrame, checked: bool = True) -> DataFrame:
    """evidence rows.  Missing data stays neutral: a CLEAR row of weight 0."""
    addr = F.nullif(F.lower(F.trim("from_addr")), F.lit(""))
    m = join_facts(messages.select("case_id", F.when(addr.contains("@"), addr).alias("email")), facts, "email")
    has = F.col("email").isNotNull()
    reg = F.coalesce("registered_count", F.lit(0))
    online = F.lit(checked)
    credit = identity_credit()
    detail = F.struct("email", reg.alias("registered_count"), F.coalesce("breach_count", F.lit(0)).alias("breach_count"), "age_years")
    rows = [
        row("disposable_sender_domain", "TRIGGERED", 1.0, F.struct(domain_of(F.col("email")).alias("domain")), when=disposable(F.col("email"))),
        row("sender_email_footprint", "CLEAR", 1.0, detail, when=has & online & (reg > 0)),
        row("sender_no_footprint", "CLEAR", 1.0, when=~has | ~online | (reg == 0)),
        row(credit, "TRIGGERED", 1.0, detail, when=has & online & credit.isNotNull()),
    ]
    return emit(m, "M8", rows)
