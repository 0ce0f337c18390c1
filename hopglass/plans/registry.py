"""Named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.domains import SuffixRules, suffix_rules
from ..session import set_method_limit
from .derived import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The given tables and the views derived from them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def suffixes(self) -> SuffixRules:
        return suffix_rules(self.d_suffix_rules)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("d_"):
            return view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register ``fn(src) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Source], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            set_method_limit(spark)
            return fn(Source(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
