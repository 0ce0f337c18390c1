"""Joins and orderings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(many: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows.  There can be at most
    rows / hot_rows of them, which is what bounds the broadcast below."""
    return many.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")


def join_on_hot_key(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner",
                    salts: int = SALTS) -> DataFrame:
    """Join a skewed side to a side with few rows per key.  Rows of hot keys are
    spread over ``salts`` partitions and only those keys are replicated."""
    flagged = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(0)
    left = many.join(flagged, keys, "left").withColumn("_salt", spread).drop("_hot")
    fan = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(flagged, keys, "left").withColumn("_salt", F.explode(fan)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def global_positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based position of every row in a total order, without one sorting task.

    Range partitioning splits even a single huge key (the order must be unique);
    positions are partition offsets plus the place inside the partition."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    fixed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition: small whatever the data size
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_off") + F.col("_id") - F.shiftleft(F.col("_part"), 33)).drop("_id", "_part", "_off"))


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and maxima (this row included) over a total order, without one task that sees all rows.

    Range partitioning splits even a single huge key (the order must be unique); a partition adds what all earlier ones
    hold, which is one row per partition."""
    sums, maxes = sums or {}, maxes or {}
    ranged = df.withColumns({f"_v_{n}": c for n, c in (sums | maxes).items()}).repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    fixed = cut(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    totals = fixed.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxes])
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    out = fixed.join(F.broadcast(offsets), "_part")
    out = out.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside) for n in sums} | {n: F.greatest(F.col(f"_o_{n}"), F.max(f"_v_{n}").over(inside)) for n in maxes})
    return out.drop("_part", "_id", *[f"_{p}_{n}" for n in sums | maxes for p in "vo"])


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """How many rows of the same key come earlier; exact and safe for hot keys."""
    pos = global_positions(df, [*keys, *order], "_pos")
    first = pos.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return join_on_hot_key(pos, first, keys, hot_keys(pos, keys)).withColumn(out, F.col("_pos") - F.col("_first")).drop("_pos", "_first")
