"""A sample whose categories follow target shares: systematic sampling with unequal probabilities, then repaired floors.

The items are put in one total order: categories in sorted order, within a category by the digest of the key. Each item has an
inclusion probability, its category's target over the category's size (1 at most), as a whole number of 2**-32. Sums of them up to each
item are taken within range partitions and shifted by the partitions' totals. An item is drawn where the running sum passes
a whole number plus the random start. Whole numbers add up the same in any order, so the sample doesn't depend on the partitioning.
A category that ends below its floor gets the next items of its order, by the same two-step counting.

A category may hold any part of the items: range partitions split it. The driver gets one row for each partition
and category that meet, and the quota lines.

Left out are rows with null key or category. What is drawn are distinct pairs of key and category: an item of several categories belongs to the supply of
each of these lines and can be drawn for each. A line is met if as many are drawn for it as it wants. Categories without a line aren't drawn. Repeated rows count once. Of repeated lines with one category
the largest share and minimum hold; null shares and minimums are 0. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

ONE = 1 << 32
SEED = 20_240


def _pairs(items: DataFrame, key: str, category: str) -> DataFrame:
    return items.where(F.col(key).isNotNull() & F.col(category).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(category).cast("bigint").alias("char_count")).distinct()


def lines(items: DataFrame, quota: DataFrame, key: str = "targetId", category: str = "charCount", divisor: int = 4) -> DataFrame:
    """``char_count, share_pm, supply, n, wanted``: each quota line with its supply of distinct keys and what it needs.

    The sample's size n is the number of distinct keys over ``divisor``; a line wants the larger of its minimum and its share of n, rounded up.
    """
    return _lines(_pairs(items, key, category), quota, divisor)


def _lines(some: DataFrame, quota: DataFrame, divisor: int) -> DataFrame:
    n = some.agg(F.floor(F.countDistinct("key") / divisor).alias("n"))
    supply = some.groupBy("char_count").agg(F.count(F.lit(1)).alias("supply"))
    plan = quota.where("char_count is not null").groupBy(F.col("char_count").cast("bigint")).agg(F.coalesce(F.max("share_pm"), F.lit(0)).cast("bigint").alias("share_pm"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("bigint").alias("min_rows"))
    every = plan.join(supply, "char_count", "left").crossJoin(F.broadcast(n))  # n is one row
    wanted = F.greatest("min_rows", F.expr("(share_pm * n + 999) div 1000"))
    return every.select("char_count", "share_pm", F.coalesce("supply", F.lit(0)).alias("supply"), "n", wanted.alias("wanted"))


def _before(df: DataFrame, value: str) -> DataFrame:
    """``part, value-so-far``: the sum of ``value`` in all partitions before each; one row for each partition."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy("part").agg(F.sum(value).alias("s")).select("part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"))


def draw(items: DataFrame, quota: DataFrame, key: str = "targetId", category: str = "charCount", divisor: int = 4, seed: int = SEED) -> DataFrame:
    """``<key>, <category>, how``: the sample; ``how`` is systematic or floor."""
    some = kept(_pairs(items, key, category), "supply")
    return _drawn(some, kept(_lines(some, quota, divisor), "lines"), seed).select(F.col("key").alias(key), F.col("char_count").alias(category), "how")


def _drawn(some: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``key, char_count, how`` of the pairs that are drawn."""
    sizes = plan.select("char_count", F.col("supply").alias("size")).where("size > 0")
    # the share of n over the category's size, in parts of ONE; both fit 63 bits together up to 2**30 items a share
    weighted = F.broadcast(
        plan.join(sizes, "char_count").select(
            "char_count", "wanted", F.least(F.lit(ONE).cast("decimal(38,0)"), F.expr(f"cast(floor(cast(share_pm as decimal(20,0)) * n * {ONE} / (1000 * size)) as decimal(38,0))")).cast("bigint").alias("weight")
        )
    )  # at most the lines of the quota
    ranked = some.join(weighted, "char_count").withColumn("u", F.md5(F.concat(F.lit(f"{seed}|"), F.col("key"))))
    ordered = ranked.repartitionByRange("char_count", "u", "key").sortWithinPartitions("char_count", "u", "key").withColumn("part", F.spark_partition_id())
    inside = kept(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    w = Window.partitionBy("part").orderBy("at")
    sums = inside.withColumn("here", F.sum("weight").over(w))
    start = F.conv(F.substring(F.md5(F.lit(f"start|{seed}")), 1, 8), 16, 10).cast("bigint")  # between 0 and ONE
    placed = sums.join(F.broadcast(_before(inside, "weight")), "part").withColumn("upto", F.col("before") + F.col("here") - start)
    passed = F.expr("shiftright(upto, 32) > shiftright(upto - weight, 32)")  # a whole number lies between
    drawn = kept(placed.select("key", "char_count", "wanted", "part", "at", passed.alias("drawn")), "drawn")
    short = drawn.groupBy("char_count").agg((F.max("wanted") - F.count_if("drawn")).alias("short")).where("short > 0")
    rest = drawn.where(~F.col("drawn")).join(F.broadcast(short), "char_count").withColumn("nth", F.row_number().over(Window.partitionBy("part", "char_count").orderBy("at")))
    counts = rest.groupBy("part", "char_count").agg(F.count(F.lit(1)).alias("k"))
    shift = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("char_count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    floor = rest.join(shift, ["part", "char_count"]).where("nth + before <= short")
    out = drawn.where("drawn").select("key", "char_count", F.lit("systematic").alias("how")).unionByName(floor.select("key", "char_count", F.lit("floor").alias("how")))
    return out


def report(items: DataFrame, quota: DataFrame, key: str = "targetId", category: str = "charCount", divisor: int = 4, seed: int = SEED) -> DataFrame:
    """``char_count, supply, wanted, drawn, met`` of every quota line, from the sample."""
    some = kept(_pairs(items, key, category), "supply")
    plan = kept(_lines(some, quota, divisor), "lines")
    got = _drawn(some, plan, seed).groupBy("char_count").agg(F.count(F.lit(1)).alias("drawn"))
    every = plan.join(got, "char_count", "left").select("char_count", "supply", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    return every.withColumn("met", F.col("drawn") >= F.col("wanted"))


def unmet(items: DataFrame, quota: DataFrame, **more) -> DataFrame:
    """``char_count``: the lines for which the sample has too few."""
    return report(items, quota, **more).where(~F.col("met")).select(F.col("char_count").cast("int").alias("char_count"))
