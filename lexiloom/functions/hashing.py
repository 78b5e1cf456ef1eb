"""32-bit hashes as columns, and the generator that goes with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(c: Column) -> Column:
    """FNV-1a of a text's characters, 32 bits."""
    codes = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))


def fnv1a_of(text: str) -> int:
    """The same for a text of the driver, over UTF-16 units."""
    units = text.encode("utf-16-le", "surrogatepass")
    h = 2166136261
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def mulberry32(seed: int):
    """Numbers from 0 to 1, a sequence for each 32-bit seed."""
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296
