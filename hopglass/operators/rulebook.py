"""Versioned rules as data (S16): built-in versions, or checked tables of a user.

A rule book holds the rules of any number of versions as one small relation keyed by (version, signal), so evidence is
scored under all of them in one pass.  Rows that break the contract become error rows; they never score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fx
from . import dims

#: Why a signal counts; a user's table brings its own.
RATIONALES = """
forged_received_hop | A relay line below our own border names an address that no public relay can have.
reply_to_domain_mismatch | Answers would go to another organisation than the one that seems to write.
private_ip_in_public_chain | Private and reserved addresses do not travel on the public network.
fake_reply | A reply refers to an earlier message, and this one names none.
timestamp_regression | A relay cannot hand a message on before it has got it.
chain_discontinuity | An organisation that handed the message over should not appear on the path again.
rdns_mismatch | The host that was announced has other addresses than the one that connected.
message_id_domain_divergence | The identifier was made by a host of neither the sender nor a relay.
dmarc_fail_strict | The domain asks receivers not to take such mail as its own.
spf_fail_hard | The domain's list of senders leaves this address out; forwarding can cause it too.
arc_authenticated | An intermediary vouches that the mail was authentic before it was forwarded.
dkim_missing | Little alone, but most organisations sign their mail.
dkim_fail | The content was changed after signing, or the signature is not genuine.
dkim_valid_aligned | The sender's own organisation signed exactly this content.
payment_diversion_intent | The text asks for money to be sent elsewhere than usual.
classifier_phishing_high | A model that read the text is very sure.
executive_impersonation | The shown name claims an office that the address does not support.
credential_harvest_intent | The text leads to a place where a secret is to be entered.
gift_card_scam | Codes of gift cards cannot be traced or taken back.
hidden_text_mismatch | What a filter reads is not what a person sees.
obfuscated_text | Letters were chosen so that filters do not find the words.
dangerous_attachment | Opening the file can run a program.
active_svg_attachment | The picture holds a script.
links_no_text | There is a link to follow and nothing else to judge by.
origin_anonymized | The place the message came from was hidden on purpose.
origin_datacenter_hosted | Persons rarely write from rented servers.
obfuscated_url | The address shown is not the address that opens.
provider_withholds_origin | The provider removes the address of the person; no sign of fraud.
brand_lookalike_domain | The domain was chosen to be taken for a well-known one.
domain_age_lt_30d | Domains for fraud are used soon after they were registered.
domain_no_mx | A domain that sends mail usually takes answers.
campaign_infrastructure_reuse | The same hosts or files were seen in other cases.
known_correspondent | The sender has written before and was found genuine.
domain_does_not_resolve | A sender domain without an address is not in regular use.
disposable_sender_domain | The mailbox can be had by anybody for minutes.
sender_email_footprint | Tells where the address is known; informative only.
sender_no_footprint | Nothing public is known of the address; informative only.
established_sender_identity | The address is old and in use at many places.
known_footprint_sender | The address belongs to a real account.
"""


def rationale_of() -> dict[str, str]:
    return dict(tuple(c.strip() for c in line.split(" | ", 1)) for line in RATIONALES.strip().splitlines())


@dataclass(frozen=True)
class RuleBook:
    """``flags``: version, signal, weight, label, rationale, general, identity, is_credit.  ``profiles`` tells which built-in
    version's bands and rounding a version follows."""
    flags: DataFrame
    profiles: dict[str, str]

    @property
    def versions(self) -> list[str]:
        return sorted(self.profiles)

    def by_signal(self) -> DataFrame:
        """signal, ``rules`` (what counts, as a number, see ``weight_of`` and ``role_of``), ``labels`` and ``rationales``: arrays with an
        element for each of ``versions``, null where the version has no rule for the signal."""
        roles = sum((F.when(F.col(c), bit).otherwise(0) for c, bit in ROLE_BITS.items()), F.lit(0))
        columns = {"rules": F.col("weight").cast("long") * 8 + roles, "labels": F.col("label"), "rationales": F.col("rationale")}
        if len(self.versions) == 1:
            return self.flags.filter(F.col("version") == self.versions[0]).select("signal", *[F.array(c).alias(name) for name, c in columns.items()])
        return self.flags.groupBy("signal").agg(*[F.array(*[F.max(F.when(F.col("version") == v, c)) for v in self.versions]).alias(name) for name, c in columns.items()])


ROLE_BITS = {"general": 4, "identity": 2, "is_credit": 1}


def weight_of(rule: Column) -> Column:
    return F.shiftright(rule, 3).cast("int")


def role_of(rule: Column, role: str) -> Column:
    return rule.bitwiseAND(ROLE_BITS[role]) > 0


_FLAGS = "version string, signal string, weight int, label string, rationale string, general boolean, identity boolean, is_credit boolean"


def built_in(spark: SparkSession, versions: list[str]) -> RuleBook:
    why = rationale_of()
    rows = [(v, s, w, label, why[s], s in fx.GENERAL_SUPPRESSORS[v], s in fx.IDENTITY_SUPPRESSORS[v], s in fx.IDENTITY_CREDITS[v])
            for v, s, w, _, label in dims.rule_rows() if v in versions]
    return RuleBook(dims.inline(spark, rows, _FLAGS), {v: v for v in versions})


#: Text columns of a rule table as a user gives it.
COLUMNS = ("version", "signal", "weight", "analyzer", "label", "rationale")
ROLES = ("general", "identity", "credit")
MOST_RULES = 100_000


def check_rules(table: DataFrame, known_signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The sound rows of a rule table (typed), and one error row (version, signal, problem) per fault of the others.

    Faults: an absent column or value, a weight that is no whole number of -100 to 100, an unknown lane, a rule given twice, and
    (with ``known_signals``) a signal that no lane emits."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in table.columns else F.lit(None).cast("string")
    rows = table.select(*[text(c).alias(c) for c in COLUMNS])
    if known_signals is not None:
        rows = rows.join(F.broadcast(known_signals.select("signal").distinct().limit(MOST_RULES).withColumn("_known", F.lit(True))), "signal", "left")
    else:
        rows = rows.withColumn("_known", F.lit(True))
    weight = F.col("weight").try_cast("int")
    faults = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in COLUMNS]
    faults += [F.when(F.col("weight").isNotNull() & ~F.coalesce(F.col("weight").rlike(r"^-?[0-9]+$") & weight.between(-100, 100), F.lit(False)), F.lit("weight is not a whole number of -100 to 100")),
               F.when(~F.col("analyzer").rlike("^M[2-8]$"), F.lit("unknown analyzer")),
               F.when(F.col("signal").isNotNull() & F.col("_known").isNull(), F.lit("no lane emits the signal")),
               F.when(F.col("_times") > 1, F.lit("rule given more than once"))]
    rows = rows.withColumn("_times", F.when(F.col("version").isNotNull() & F.col("signal").isNotNull(), F.count("*").over(Window.partitionBy("version", "signal"))))
    rows = rows.withColumn("_faults", F.filter(F.array(*faults), lambda x: x.isNotNull()))
    good = rows.filter(F.size("_faults") == 0).select(*[weight.alias(c) if c == "weight" else F.col(c) for c in COLUMNS])
    return good, rows.select("version", "signal", F.explode("_faults").alias("problem"))


def from_tables(rules: DataFrame, roles: DataFrame, profiles: dict[str, str], most: int = MOST_RULES) -> RuleBook:
    """Rule book of checked rules and of roles (version, signal, role: ``general``, ``identity`` or ``credit``).  ``profiles`` names for
    each version the built-in one whose bands and rounding hold.  Rule tables are small; their size is checked, since
    they are broadcast to the evidence."""
    good, _ = check_rules(rules)
    if good.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules")
    has = lambda role: F.coalesce(F.max(F.col("role") == role), F.lit(False))
    by = roles.groupBy("version", "signal").agg(has("general").alias("general"), has("identity").alias("identity"), has("credit").alias("is_credit"))
    flags = good.drop("analyzer").join(by, ["version", "signal"], "left").na.fill(False, ["general", "identity", "is_credit"])
    plus = F.col("weight") > 0  # faulty roles take no part, see ``role_problems``
    flags = flags.withColumns({"general": F.col("general") & plus, "identity": F.col("identity") & plus, "is_credit": F.col("is_credit") & (F.col("weight") < 0)})
    return RuleBook(flags.filter(F.col("version").isin(list(profiles))), dict(profiles))


def role_problems(rules: DataFrame, roles: DataFrame) -> DataFrame:
    """Error rows of roles: unknown role, a suppressor that is no rule or no positive one, a credit that is no negative one."""
    known = check_rules(rules)[0].select("version", "signal", "weight")
    j = roles.join(known, ["version", "signal"], "left")
    suppressor = F.col("role").isin("general", "identity")
    problem = (F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role").when(F.col("weight").isNull(), F.concat("role", F.lit(" is not a rule")))
               .when(suppressor & (F.col("weight") <= 0), "suppressor is not a positive signal").when(~suppressor & (F.col("weight") >= 0), "credit is not a negative signal"))
    return j.select("version", "signal", problem.alias("problem")).filter("problem is not null")


def by_profile(book: RuleBook, version: Column, value) -> Column:
    """``value(profile)`` of the profile that the row's version follows."""
    out = None
    for v, profile in book.profiles.items():
        out = F.when(version == v, value(profile)) if out is None else out.when(version == v, value(profile))
    return out
