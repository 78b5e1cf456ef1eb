"""A reproducible sample that keeps its members as data grow: nested hash buckets.

A key belongs for good to one of ``BUCKETS`` buckets, by its digest alone. The buckets have a fixed order, a permutation
computed from the seed, and a sample is a prefix of that order: its list of buckets is only ever appended to. So a sample
is the same for every rerun and partitioning, a larger one contains a smaller one, and keys that arrive later neither push
others out nor change them. Selection is an expression on the key, so it needs no shuffle; only making keys distinct does.

Null keys are left out; the empty string is a key as any other. Repeated rows of a key count once. An empty table gives
no rows. Columns besides the key are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SEED = 20_240


def bucket_of(key: Column, seed: int = SEED) -> Column:
    """The key's bucket, from 0 to BUCKETS - 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def rank_of(bucket: Column, seed: int = SEED) -> Column:
    """The bucket's place in the fixed order: odd factors, sums and shifts to the right are each one to one on 16 bits."""
    r = F.pmod(bucket.cast("bigint") * 40_503 + seed, F.lit(BUCKETS))
    r = r.bitwiseXOR(F.shiftright(r, 7))
    r = F.pmod(r * 30_011 + 977, F.lit(BUCKETS))
    return r.bitwiseXOR(F.shiftright(r, 9)).cast("int")


def sample(df: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """``<key>, bucket, bucket_rank``: the distinct keys in the first ``share`` of the buckets."""
    if not 0 <= share <= 1:
        raise ValueError("share lies between 0 and 1")
    value = F.col(key)
    placed = df.where(value.isNotNull()).select(value.alias(key), bucket_of(value, seed).alias("bucket"))
    taken = placed.select(key, "bucket", rank_of(F.col("bucket"), seed).alias("bucket_rank")).where(F.col("bucket_rank") < round(share * BUCKETS))
    return taken.distinct()


def buckets_for(df: DataFrame, key: str, size: int, at_least: int = 0, seed: int = SEED) -> int:
    """How many buckets of the order hold ``size`` distinct keys, and no fewer than ``at_least``, the number used before.

    The driver gets one count for each bucket, ``BUCKETS`` rows at most.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    counts = dict(keys.groupBy(rank_of(bucket_of(F.col(key), seed), seed).alias("r")).count().collect())
    total = 0
    for r in range(BUCKETS):
        if total >= size:
            return max(r, at_least)
        total += counts.get(r, 0)
    return BUCKETS
