"""Long exact spans shared between records, found by compact windows.

For one hash function, the Cartesian tree over a record's token hashes gives every token the window of all spans whose least hash is
that token's. Of the spans of ``least`` tokens, each window holds a run of neighbouring starts; the windows of several hash
functions, joined as intervals over the starts, cut the record into cells whose spans have one signature, the least hash under each function.
Equal spans have equal signatures, so no shared span is lost, whatever the number of functions; more functions only leave less to verify.

1. A cell is one row (record, starts, signature, tokens). Signatures with two owners are found by their least and
   greatest owner, in partial aggregates: a hot signature is one row per task.
2. The cells of such signatures are opened into spans, and the spans' texts compared in full the same way.
3. A record's shared spans grow into runs by a window over that record.

No pairs are built anywhere, and groups are never collected.

Tokens are the pieces between slashes, exactly as written. Rows with null owner or text are left out on both sides; the empty text
has one empty token. Repeated rows are told apart by a number given in reading. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

LEAST = 5
HASHES = 3


def windows(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position its node's range in the Cartesian tree of its record (the leftmost of equal hashes is the root).

    ``first`` and ``last`` bound the record of each position. All positions jump at once over ranges that are known to
    hold larger hashes, so a record takes about as many rounds as the logarithm of its length.
    """
    left, right = np.arange(len(h)) - 1, np.arange(len(h)) + 1
    todo = np.flatnonzero(left >= first)
    while len(todo):
        todo = todo[h[left[todo]] > h[todo]]
        left[todo] = left[left[todo]]
        todo = todo[left[todo] >= first[todo]]
    todo = np.flatnonzero(right <= last)
    while len(todo):
        todo = todo[h[right[todo]] >= h[todo]]
        right[todo] = right[right[todo]]
        todo = todo[right[todo] <= last[todo]]
    return np.maximum(left + 1, first), np.minimum(right - 1, last)


def cells_of(tokens: np.ndarray, sizes: np.ndarray, least: int, hashes: int) -> tuple[np.ndarray, ...]:
    """``record, low, high, signature`` of the cells of some records, given the 64-bit hashes of all their tokens in a row."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    record = np.repeat(np.arange(len(sizes)), sizes)
    first, last = starts[record], ends[record] - 1
    signature = np.zeros(len(tokens), np.uint64)
    new = np.zeros(len(tokens) + 1, bool)
    at = np.arange(len(tokens))
    with np.errstate(over="ignore"):
        for j in range(1, hashes + 1):
            h = (tokens ^ np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            low, high = windows(h, first, last)
            # the starts of the spans of ``least`` tokens whose least hash is at each position: one interval, empty if low > high
            a, b = np.maximum(low, at - least + 1), np.minimum(at, high - least + 1)
            some = np.flatnonzero(b >= a)
            new[a[some]] = True
            mine = np.zeros(len(tokens), np.uint64)
            size = b[some] - a[some] + 1
            mine[np.repeat(a[some] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(h[some], size)
            signature = (signature ^ mine) * np.uint64(0x94D049BB133111EB)
            signature ^= signature >> np.uint64(29)
    valid = at <= last - least + 1
    low = np.flatnonzero(valid & (new[:-1] | (at == first)))
    stop = np.append(low[1:], len(tokens))
    high = np.minimum(stop - 1, last[low] - least + 1) if len(low) else low
    return record[low], low - starts[record[low]], high - starts[record[low]], signature[low]


def cells(rows: DataFrame, key: str, owner: str, text: str, least: int = LEAST, hashes: int = HASHES) -> DataFrame:
    """``row, key, owner, low, signature, tokens``: the cells of every row; kept in the shared folder."""
    some = rows.select(F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(text).cast("string").alias("text")).where("owner is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        known: dict[str, int] = {}
        for batch in batches:
            pieces = [t.split("/") for t in batch.column(2).to_pylist()]
            flat = [w for p in pieces for w in p]
            for w in set(flat) - known.keys():
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            tokens = np.array([known[w] for w in flat], np.uint64)
            which, low, high, signature = cells_of(tokens, np.array([len(p) for p in pieces], np.int64), least, hashes)
            if len(known) > 1_000_000:
                known.clear()
            take = pa.array(which)
            passage = pa.array([pieces[i][a : b + least] for i, a, b in zip(which, low, high)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(which + row), batch.column(0).take(take), batch.column(1).take(take), pa.array(low.astype(np.int32)), pa.array(signature.view(np.int64)), passage], ["row", "key", "owner", "low", "signature", "tokens"])
            row += len(batch)

    schema = f"row bigint, key {some.schema['key'].dataType.simpleString()}, owner string, low int, signature bigint, tokens array<string>"
    return kept(some.mapInArrow(cut, schema), "cells")


def _with_two_owners(df: DataFrame, by: str) -> DataFrame:
    """``df``'s rows whose ``by`` has two different owners."""
    several = df.groupBy(by).agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select(by)
    return df.join(several, by, "left_semi")


def runs(rows: DataFrame, key: str = "row_no", owner: str = "targetId", text: str = "spelling", least: int = LEAST, hashes: int = HASHES) -> DataFrame:
    """``<key>, first_glyph, last_glyph``: each longest run of neighbouring tokens of a row that are shared with another owner."""
    likely = _with_two_owners(cells(rows, key, owner, text, least, hashes), "signature")
    starts = F.explode(F.sequence(F.lit(0), F.size("tokens") - least)).alias("k")
    spans = likely.select("row", "key", "owner", "low", "tokens", starts).select("row", "key", "owner", (F.col("low") + F.col("k")).alias("start"), F.array_join(F.slice("tokens", F.col("k") + 1, F.lit(least)), "/").alias("span"))
    shared = _with_two_owners(kept(spans, "spans"), "span").select("row", "key", "start")
    in_row = Window.partitionBy("row").orderBy("start")
    opens = F.coalesce((F.col("start") > F.lag("start").over(in_row) + least).cast("int"), F.lit(1))
    numbered = shared.withColumn("opens", opens).withColumn("run", F.sum("opens").over(in_row))
    merged = numbered.groupBy("row", "run").agg(F.first("key").alias(key), (F.min("start") + 1).alias("first_glyph"), (F.max("start") + least).alias("last_glyph"))
    return merged.select(key, F.col("first_glyph").cast("int"), F.col("last_glyph").cast("int"))


def shares(rows: DataFrame, key: str = "row_no", owner: str = "targetId", text: str = "spelling", least: int = LEAST, hashes: int = HASHES) -> DataFrame:
    """``<key>, glyphs, shared_glyphs``: of each row with owner and text its tokens and how many are shared elsewhere. Keys must be unique."""
    found = runs(rows, key, owner, text, least, hashes).groupBy(key).agg(F.sum(F.col("last_glyph") - F.col("first_glyph") + 1).alias("shared_glyphs"))
    every = rows.where(F.col(owner).isNotNull() & F.col(text).isNotNull()).select(key, F.size(F.split(text, "/")).alias("glyphs"))
    return every.join(found, key, "left").select(key, "glyphs", F.coalesce("shared_glyphs", F.lit(0)).cast("bigint").alias("shared_glyphs"))
