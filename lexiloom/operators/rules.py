"""Rules over rows, with the two ways of counting what they exclude. The rules come from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``passed`` and ``failed`` (names, in the rules' order; a null verdict fails) and ``primary``, the first failed."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    names = lambda wanted: F.array_compact(F.array(*[F.when(ok(c) == wanted, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("passed", names(True)).withColumn("failed", names(False)).withColumn("primary", F.get("failed", F.lit(0)))


def exclusions(verdicts: DataFrame) -> DataFrame:
    """``rule, first_failures, failures``: rows that a rule is the first to exclude, and rows that it excludes at all."""
    one = verdicts.select(F.explode("failed").alias("rule"), (F.col("primary") == F.col("rule")).alias("first"))
    return one.groupBy("rule").agg(F.count_if("first").alias("first_failures"), F.count(F.lit(1)).alias("failures"))
