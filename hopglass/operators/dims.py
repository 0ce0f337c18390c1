"""Dimension tables built from the fixed values.

Each is an inline relation of known, small size, so Catalyst sees its exact
size and picks a broadcast join by itself; nothing here grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fx

LATEST = "1.10.0"
EARLIER = "1.3.0"
VERSIONS = [EARLIER, LATEST]


def rule_rows() -> list[tuple]:
    rows = []
    for line in fx.RULE_TABLE.strip().splitlines():
        signal, weight, lane, versions, label = [c.strip() for c in line.split("|")]
        rows += [(v, signal, int(weight), lane, label) for v in versions.split()]
    return rows


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows: list[tuple], alias: str) -> str:
    """``(VALUES ...) AS alias`` text that Spark SQL and other engines both read."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small literal table with a DDL schema, as a local relation."""
    cols = [c.strip().split(None, 1) for c in schema.split(",")]
    names = [c[0] for c in cols]
    if not rows:
        return spark.createDataFrame([], schema)
    lit = lambda v: "r" + sql_literal(v) if isinstance(v, str) and "\\" in v else sql_literal(v)
    quote = lambda v: sql_literal(v).replace("''", "\\'") if isinstance(v, str) and "\\" not in v else lit(v)
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in cols])


def rules(spark: SparkSession, versions: list[str] | None = None) -> DataFrame:
    keep = versions or VERSIONS
    return inline(spark, [r for r in rule_rows() if r[0] in keep],
                  "version string, signal string, weight int, rule_analyzer string, label string")


def suppressors(spark: SparkSession) -> DataFrame:
    rows = [(v, "general", s) for v in VERSIONS for s in fx.GENERAL_SUPPRESSORS[v]]
    rows += [(v, "identity", s) for v in VERSIONS for s in fx.IDENTITY_SUPPRESSORS[v]]
    return inline(spark, rows, "version string, scope string, signal string")


def identity_credits(spark: SparkSession) -> DataFrame:
    return inline(spark, [(v, s) for v in VERSIONS for s in fx.IDENTITY_CREDITS[v]],
                  "version string, signal string")


def bands(spark: SparkSession) -> DataFrame:
    rows = []
    for v in VERSIONS:
        cuts = fx.BANDS[v]
        for i, (band, lo, bucket) in enumerate(cuts):
            hi = cuts[i + 1][1] - 1 if i + 1 < len(cuts) else 100
            rows.append((v, band, lo, hi, bucket, i))
    return inline(spark, rows, "version string, band string, lo int, hi int, bucket string, rank int")


def rule_problems(rules_df: DataFrame, suppressors_df: DataFrame) -> DataFrame:
    """Validation: rows that break the rule-table contract (empty when sound)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    bad = rules_df.select(
        "version", "signal",
        F.expr("filter(array(%s), x -> x is not null)" % ", ".join(
            f"case when {c} is null or trim(cast({c} as string)) = '' then 'missing {n}' end"
            for c, n in [("weight", "weight"), ("label", "label"), ("rule_analyzer", "analyzer")])).alias("p"))
    bad = bad.select("version", "signal", F.explode("p").alias("problem"))
    known = rules_df.select("version", "signal", "weight")
    orphan = (suppressors_df.join(known, ["version", "signal"], "left")
              .filter(F.col("weight").isNull() | (F.col("weight") <= 0))
              .select("version", "signal",
                      F.when(F.col("weight").isNull(), "suppressor is not a rule")
                      .otherwise("suppressor is not a positive signal").alias("problem")))
    return bad.unionByName(orphan)
