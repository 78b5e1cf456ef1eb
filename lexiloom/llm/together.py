"""Items that appear together: packed pair codes, sorted runs, run-length counts, odds ratios.

Each record's distinct items give one 64-bit code for each pair, the smaller item in the high half. A task fills a buffer of
codes, sorts it and emits it as a run of (code, count), so that a frequent pair crosses the shuffle once per run. The runs are
sorted by code within hash partitions, where Spark spills sorted runs and merges them, and equal neighbours are
added up in a stream. Nothing holds the pairs of more than one buffer, also for a record of very many items.

Codes up to 2,147,483,647 are packed as they are. If any is larger, all items are numbered in their order first, by a dictionary table, and
the numbers are packed in their place.

Records without item don't count. Repeated records count once. Null targets and contents are left out; codes of more than 18 digits are none.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ranking import positions
from lexiloom.sources.tables import kept

BUFFER = 2_000_000
#: The largest number that has a half of a code.
LARGEST = (1 << 31) - 1


def glyph_codes(spelling: Column) -> Column:
    """The distinct codes ``B<digits>`` before the first ``;`` of each glyph, ascending."""
    code = F.transform(F.split(spelling, "/"), lambda g: F.regexp_extract(g, r"^B0*([0-9]{1,18})(?:;|$)", 1).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(code, lambda n: n.isNotNull())))


def baskets(rows: DataFrame, by: str = "targetId", content: str = "spelling") -> DataFrame:
    """``items``: the items of each distinct record that has any."""
    records = rows.select(F.col(by).alias("by"), F.col(content).alias("content")).where("by is not null and content is not null").distinct()
    return records.select(glyph_codes(F.col("content")).alias("items")).where(F.size("items") > 0)


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes as distinct codes with their counts."""
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n = np.diff(np.append(start, len(codes))) if counts is None else np.add.reduceat(counts, start)
    return codes[start], n.astype(np.int64)


def pair_counts(items: DataFrame, column: str = "items", buffer: int = BUFFER) -> DataFrame:
    """``code, n``: each pair of items of one record and the number of records that hold it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, n = _runs(np.sort(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        for batch in batches:
            for row in batch.column(0):
                x = row.values.to_numpy().astype(np.int64)
                block = max(1, buffer // max(1, len(x)))
                for k in range(0, len(x) - 1, block):
                    a = np.arange(k, min(k + block, len(x) - 1))
                    left = np.repeat(a, len(x) - 1 - a)
                    right = np.concatenate([np.arange(i + 1, len(x)) for i in a])
                    held.append((x[left] << 32) | x[right])
                    size += len(left)
                    if size >= buffer:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not len(batch):
                continue
            codes, n = _runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            n = n.copy()
            if last is not None:
                if codes[0] == last:
                    n[0] += total
                else:
                    codes, n = np.concatenate([[last], codes]), np.concatenate([[total], n])
            last, total = int(codes[-1]), int(n[-1])
            if len(codes) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(n[:-1])], ["code", "n"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["code", "n"])

    runs = items.select(column).mapInArrow(emit, "code bigint, n bigint")
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(merge, "code bigint, n bigint")


def _numbered(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with numbers from 1 in the place of their items, in the items' order, and ``item, number``. Frequent items are rows of the larger side of the joins, which Spark splits."""
    rows = kept(items.select("items", F.monotonically_increasing_id().alias("row")), "records")
    each = rows.select("row", F.explode("items").alias("item"))
    numbers = kept(positions(each.select("item").distinct(), [F.col("item")], name="number"), "numbers")
    if numbers.count() > LARGEST:
        raise ValueError(f"more than {LARGEST} items")
    return each.join(numbers, "item").groupBy("row").agg(F.array_sort(F.collect_list("number")).alias("items")), numbers


def pairs(rows: DataFrame, by: str = "targetId", content: str = "spelling", largest: int = LARGEST) -> DataFrame:
    """``glyph_a, glyph_b, c, a, b, n, odds_ratio, lift``: records with both, with each, and in all.

    The odds ratio has half a record added to each of its four cells, so it is finite for every pair.
    """
    items = kept(baskets(rows, by, content), "baskets")
    n, most = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.array_max("items")), F.lit(0))).first()
    each = items.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    packed = items
    if most > largest:
        packed, numbers = _numbered(items)
        each = each.join(numbers, "item")
    else:
        each = each.withColumn("number", F.col("item"))
    both = pair_counts(packed).select(F.shiftright("code", 32).alias("no_a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("no_b"), F.col("n").alias("c"))
    with_a = both.join(each.select(F.col("number").alias("no_a"), F.col("item").alias("glyph_a"), F.col("k").alias("a")), "no_a")
    every = with_a.join(each.select(F.col("number").alias("no_b"), F.col("item").alias("glyph_b"), F.col("k").alias("b")), "no_b").withColumn("n", F.lit(n).cast("bigint"))
    c, a, b, n_ = (F.col(x).cast("double") for x in ("c", "a", "b", "n"))
    half = 0.5
    odds = (c + half) * (n_ - a - b + c + half) / ((a - c + half) * (b - c + half))
    return every.select("glyph_a", "glyph_b", "c", "a", "b", "n", odds.alias("odds_ratio"), (c * n_ / (a * b)).alias("lift"))


def found(rows: DataFrame, by: str = "targetId", content: str = "spelling", least: int = 3, per_mille: int = 1, times: int = 3) -> DataFrame:
    """``glyph_a, glyph_b``: pairs in at least ``least`` records and ``per_mille`` of all, ``times`` as often as by chance."""
    found_ = pairs(rows, by, content).where((F.col("c") >= least) & (1000 * F.col("c") >= per_mille * F.col("n")) & (F.col("c") * F.col("n") >= times * F.col("a") * F.col("b")))
    return found_.select("glyph_a", "glyph_b")
