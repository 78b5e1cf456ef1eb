"""Held-out passages inside a corpus: a broadcast hash set of normalised n-grams, scanned over every text.

Words are runs of letters and digits, in lower case; everything else only separates them. The items' words are numbered and their n-grams hashed
into a sorted array that each worker holds. A text's words become the items' word numbers (0 for words of no item), so
that most windows fall away without hashing: only those without a 0 are hashed, looked up, and compared word by word with
the n-gram they hit. Windows of one item that overlap or touch grow into one span.

What is broadcast is bounded: items are cut into segments (overlapping by n - 1 words, so no window is lost) that are dealt
into blocks of about ``block_words`` words, of 16 bytes each. One block, and so one scan, serves up to ten million words of held-out text. With more, the texts pass
through one scan for each block and carry the hits with them; after every ``AT_ONCE`` scans they are written to the shared folder, so that no task holds
more blocks than that. Spans are joined over the borders of segments and blocks. Leaked spans are cut out in the same scan, row by row: texts aren't shuffled, and rows need no key.

Null and empty texts and items, and items of less than n words, have no spans. Repeated rows give repeated spans; a null
key is kept as null. Further columns are ignored, also if they're named like a result's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

N = 12
BLOCK_WORDS = 10_000_000
SEGMENT = 10_000
#: Blocks that the texts pass before they are written.
AT_ONCE = 2
#: Texts, and windows of them, that a worker holds at once.
TEXTS, WINDOWS = 1_000, 500_000
WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """``text`` in lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


class Grams:
    """The n-grams of some segments of items, for looking up."""

    def __init__(self, segments: list[tuple[int, list[str]]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        rows = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32) for _, words in segments]
        self.factor = np.random.default_rng(12).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        self.flat = np.concatenate([np.zeros(0, np.int32), *rows])
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        windows = [(int(s), max(0, len(r) - n + 1), i) for s, r, (i, _) in zip(starts, rows, segments)]
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + k) for s, k, _ in windows)])
        owner = np.repeat(np.array([i for _, _, i in windows], np.int64), [k for _, k, _ in windows])
        key = np.concatenate([np.zeros(0, np.uint64), *(self.hashed(self.flat[part[:, None] + np.arange(n)]) for part in np.array_split(at, len(at) // WINDOWS + 1))])
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.owner = key[order], at[order], owner[order]

    def hashed(self, windows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (windows.astype(np.uint64) * self.factor).sum(axis=1, dtype=np.uint64)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, item) of each window of ``ids`` that is an n-gram of the item."""
        n = self.n
        if len(ids) < n or not len(self.key):
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        every = np.flatnonzero(known[n:] - known[:-n] == n)
        for k in range(0, len(every), WINDOWS):
            at = every[k : k + WINDOWS]
            windows = ids[at[:, None] + np.arange(n)]
            key = self.hashed(windows)
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):
                    if (self.flat[self.at[j] : self.at[j] + n] == windows[i]).all():
                        yield int(at[i]), int(self.owner[j])


def _blocks(items: DataFrame, item: str, text: str, n: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' words by block; an item of many words lies in several segments."""
    rows = items.select(F.col(item).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 5 / block_words))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                for s in range(0, max(1, len(words) - n + 1), SEGMENT):
                    for x, y in zip(out, (i, s, words[s : s + SEGMENT + n - 1])):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string()))], ["item", "start", "words"])

    segments = rows.mapInArrow(cut, "item bigint, start bigint, words array<string>").withColumn("block", F.pmod(F.xxhash64("item", "start"), F.lit(blocks)))
    segments = kept(segments, "segments") if blocks > 1 else segments
    for b in range(blocks):  # one block at a time is on the driver
        yield [(r.item, r.words) for r in segments.where(F.col("block") == b).toLocalIterator()]


HITS = "array<struct<item:bigint,a:int,b:int>>"


def _grown(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits (item, first word, word behind) with those of one item that overlap or touch as one."""
    out: list[tuple[int, int, int]] = []
    for item, a, b in sorted(hits):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(out[-1][2], b))
        else:
            out.append((item, a, b))
    return out


def _places(text: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Hits as (item, start, stop, words), in characters."""
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer(lowered(text))]
    return [(item, at[a][0], at[b - 1][1], b - a) for item, a, b in hits]


def _scanned(docs: DataFrame, items: DataFrame, text: str, key: str, item: str, item_text: str, n: int, block_words: int, finish: Callable, schema: str) -> DataFrame:
    """Every row of ``docs`` with the hits of all items, given to ``finish`` batch by batch: (keys, texts, hits) to a batch of ``schema``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.array().cast(HITS).alias("hits"))
    carried = f"key {rows.schema['key'].dataType.simpleString()}, text string, hits {HITS}"
    blocks = iter(_blocks(items, item, item_text, n, block_words))
    segments, count = next(blocks), 0
    while segments is not None:
        following, count = next(blocks, None), count + 1
        grams = spark.sparkContext.broadcast(Grams(segments, n))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams, last=following is None) -> Iterator[pa.RecordBatch]:
            of = grams.value.number.get
            for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, len(b), TEXTS)):
                texts, hits = batch.column(1).to_pylist(), [[(h["item"], h["a"], h["b"]) for h in hs] for hs in batch.column(2).to_pylist()]
                flat: list[int] = []
                first = []
                for t in texts:
                    first.append(len(flat))
                    flat += [of(w, 0) for w in words_of(t or "")]
                    flat.append(0)
                starts = np.array(first)
                changed = set()
                for at, who in grams.value.hits(np.array(flat, np.int32)):
                    row = int(np.searchsorted(starts, at, "right")) - 1
                    pos, own = at - first[row], hits[row]
                    changed.add(row)
                    if own and own[-1][0] == who and own[-1][1] <= pos <= own[-1][2]:
                        own[-1] = (who, own[-1][1], max(own[-1][2], pos + n))
                    else:
                        own.append((who, pos, pos + n))
                for row in changed:
                    hits[row] = _grown(hits[row])
                if last:
                    yield finish(batch.column(0), texts, hits)
                else:
                    packed = pa.array([[dict(zip(("item", "a", "b"), h)) for h in hs] for hs in hits], pa.list_(pa.struct([("item", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["key", "text", "hits"])

        rows = rows.mapInArrow(scan, schema if following is None else carried)
        if following is not None and count % AT_ONCE == 0:
            rows = kept(rows, "scanned")
        segments = following
    return rows


def spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``<key>, item_id, start, stop, words``: each longest run of words of a text that windows of n words of an item cover without a gap.

    ``start`` and ``stop`` count characters of the text from 0; ``words`` is the length of the run.
    """

    def finish(keys: pa.Array, texts: list, hits: list) -> pa.RecordBatch:
        rows, out = [], [[], [], [], []]
        for row, own in enumerate(hits):
            for found_ in _places(texts[row], own):
                rows.append(row)
                for column, x in zip(out, found_):
                    column.append(x)
        cols = [keys.take(pa.array(rows, pa.int32()))] + [pa.array(x, pa.int64() if k == 0 else pa.int32()) for k, x in enumerate(out)]
        return pa.RecordBatch.from_arrays(cols, ["key", "item_id", "start", "stop", "words"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, item_id bigint, start int, stop int, words int"
    return _scanned(docs, items, text, key, item, item_text, n, block_words, finish, schema).withColumnRenamed("key", key)


def found(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", **more) -> DataFrame:
    """``<key>, item_id``: each text with each item that it holds, whole or in part."""
    return spans(docs, items, key=key, item=item, **more).select(key, F.col("item_id").alias(item)).distinct()


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``<key>, text, items, removed``: every row without the leaked spans, the items it leaked and the characters taken out.

    Rows without a leak come through as they are (a null text stays null), and so do rows with null or repeated keys, each for itself.
    """

    def finish(keys: pa.Array, texts: list, hits: list) -> pa.RecordBatch:
        removed = []
        for row, own in enumerate(hits):
            t = texts[row]
            if own:
                out, at = [], 0
                for start, stop in sorted((s, e) for _, s, e, _ in _places(t, own)):
                    out.append(t[at : max(at, start)])
                    at = max(at, stop)
                texts[row] = "".join(out) + t[at:]
            removed.append(None if t is None else len(t) - len(texts[row]))
        who = [sorted({i for i, _, _ in own}) for own in hits]
        return pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string()), pa.array(who, pa.list_(pa.int64())), pa.array(removed, pa.int32())], ["key", "text", "items", "removed"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, text string, items array<bigint>, removed int"
    return _scanned(docs, items, text, key, item, item_text, n, block_words, finish, schema).withColumnRenamed("key", key)
