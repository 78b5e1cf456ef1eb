"""Positions in a total order without sorting any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept


def positions(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with each row's position from 1 in ``order``, within groups of the columns ``by``.

    Rows are range partitioned by group and order, so a large group lies in many partitions; they are numbered within partitions and
    shifted by the counts of those before, one row for each partition and group that meet. Order must tell all rows apart
    for the result to be the same every time.
    """
    by = by or []
    keys = [*map(F.col, by), *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = kept(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "positions")
    here = placed.withColumn("_here", F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at")))
    counts = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    # groups that lie in one partition have one row here; only the counts of a group meet in one task
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_part", *by, before.alias("_before"))
    same = here["_part"] == shifts["_part"]
    for b in by:
        same &= here[b].eqNullSafe(shifts[b])
    return here.join(shifts, same).select(*[here[c] for c in df.columns], (F.col("_here") + F.col("_before")).cast("bigint").alias(name))
