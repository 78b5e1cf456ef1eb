"""Deterministic stratified order, nested subsets, and how close a subset is to the whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.hashing import fnv1a, fnv1a_of, mulberry32
from lexiloom.operators.ranking import positions


def length_bucket(n: Column) -> Column:
    """2, 3, 4 or 5+."""
    return F.when(n >= 5, F.lit("5+")).otherwise(n.cast("string"))


def stratified_order(items: DataFrame, strata: list[str], key: str = "target_id", seed: str = "order-1") -> DataFrame:
    """``items`` with ``stratum``, ``frac``, ``tie`` and ``place``: within a stratum in the order of a seeded digest, strata interleaved by the fraction of each that came before.

    Every prefix has about the strata's shares. Strata may be of any size: positions are found over range partitions. Keys must be unique.
    """
    with_stratum = items.withColumn("stratum", F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata])).withColumn("_u", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key))))
    numbered = positions(with_stratum, [F.col("_u"), F.col(key)], ["stratum"], "_i")
    sizes = with_stratum.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered.join(sizes, "stratum").withColumn("frac", (F.col("_i") - 0.5) / F.col("_n")).withColumn("tie", fnv1a(F.concat(F.lit(f"{seed}|tie|"), F.col(key))))
    out = positions(ranked.drop("_u", "_i", "_n"), [F.col("frac"), F.col("tie"), F.col(key)], name="place")
    return out


#: Most members of a stratum that are shuffled in one task.
SHUFFLED = 1_000_000


def shuffled_order(items: DataFrame, strata: list[str], key: str = "target_id", order: str = "numeric_id", seed: str = "order-1") -> DataFrame:
    """``key, stratum, frac, tie``: as ``stratified_order``, but each stratum in a Fisher-Yates shuffle of its ``order``.

    The shuffle goes through a stratum from its end, so a stratum is one task. For lists of targets; a stratum of more than ``SHUFFLED`` is an error.
    """
    named = items.select(F.col(key).alias("key"), F.col(order).alias("at"), F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]).alias("stratum"))
    too_large = named.groupBy("stratum").count().where(F.col("count") > SHUFFLED).limit(1).collect()
    if too_large:
        raise ValueError(f"stratum {too_large[0].stratum!r} has more than {SHUFFLED} members; use stratified_order")

    def shuffle(group: pd.DataFrame) -> pd.DataFrame:
        stratum = group["stratum"].iloc[0]
        keys = group.sort_values("at")["key"].tolist()
        draw = mulberry32(fnv1a_of(f"{seed}|{stratum}"))
        for i in range(len(keys) - 1, 0, -1):
            j = int(next(draw) * (i + 1))
            keys[i], keys[j] = keys[j], keys[i]
        return pd.DataFrame({"key": keys, "stratum": stratum, "frac": [(i + 0.5) / len(keys) for i in range(len(keys))], "tie": [fnv1a_of(f"{seed}|tie|{k}") for k in keys]})

    return named.groupBy("stratum").applyInPandas(shuffle, "key string, stratum string, frac double, tie bigint").withColumnRenamed("key", key)


def nested_subsets(ordered: DataFrame, sizes: list[int], key: str = "target_id", place: str = "place") -> DataFrame:
    """``size, <key>, place``: the prefixes of an order."""
    return ordered.select(F.explode(F.array(*map(F.lit, sizes))).alias("size"), key, place).where(F.col(place) <= F.col("size"))


def half_width(n: Column) -> Column:
    """Half the width of the 95 % interval of a share over n, in per cent."""
    return F.round(F.lit(98.0) / F.sqrt(n), 1)


def imbalance(whole: DataFrame, subsets: DataFrame, by: str, size: str = "size") -> DataFrame:
    """``size, worst``: for each subset the largest difference of a group's share from its share in the whole."""
    count = lambda d, *k: d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    total = whole.agg(F.count(F.lit(1)).alias("all"))
    full = count(whole, by).crossJoin(total).select(by, (F.col("n") / F.col("all")).alias("p"))  # total is one row
    sizes = subsets.groupBy(size).agg(F.count(F.lit(1)).alias("of"))
    grid = sizes.crossJoin(full)  # subsets by groups: a report's lines
    got = count(subsets, size, by)
    return grid.join(got, [size, by], "left").groupBy(size).agg(F.round(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("of") - F.col("p"))), 6).alias("worst"))
