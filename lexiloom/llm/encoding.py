"""Encoding a corpus with a public byte-level BPE tokenizer through a distinct-word table.

1. Every text is cut into words by the tokenizer's own splitting rule, in the JVM, and the words are counted:
   equal words meet in partial aggregates, so what is shuffled is the vocabulary, not the corpus.
2. Each distinct word is encoded once. The table word -> ids is kept in the shared folder.
3. Words that hold at least ``1 / hot_words`` of all occurrences are broadcast. There are at most ``hot_words`` of them,
   whatever the size of the corpus, since their shares add up to one at most. So are short numbers, of which there are
   few by their length.
4. Each text is cut again and the ids of its hot words are put in place. What remains, its rare words, goes through a
   shuffle join with the table, by word, and comes back to its gap by position. A rare word has less than ``1 / hot_words``
   of the occurrences, so no key of that join is hot. A gap whose word isn't in the table is an error.

The JVM, Python and the tokenizer's library know different versions of Unicode. A text with a character that they don't class alike
(``disputed``, such as a letter newer than the JVM) is encoded whole by the library where it stands, so the words of all others are in the table.

Decoding joins every id with the table id -> piece and reads the pieces in order of position as UTF-8. That table is fixed and small, so it is
broadcast; a row's lists are shuffled once, as arrays, before they are taken apart, and its pieces come together where they are.

Null and empty texts have an empty list of ids. Rows with a null or repeated key keep their own lists: rows are told apart
by a number given when they are cut, not by the key. Further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

#: Folder of the tokenizer files, a parameter of every function here.
TOKENIZERS = os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers")
#: The largest number of words to broadcast for being frequent (about 100 bytes each).
HOT_WORDS = 1_000_000
#: Numbers of up to five digits are broadcast too, with or without a space before them: 222,220 words at most.
SHORT_NUMBER = "^ ?[0-9]{1,5}$"
#: Texts that a worker cuts before it hands on their ids.
TEXTS_AT_ONCE = 256

# The published splitting rule of this tokenizer family, with white space as in Unicode's White_Space.
# Contractions come after letters and numbers, which can't begin with an apostrophe: the words are the same, found sooner.
SPLIT_JVM = r"(?U) ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
WHITE_ASCII = r"\t-\r "
WHITE = WHITE_ASCII + r"\x85\xa0  -     　"


def _rule(letter: str, number: str, other: str, white: str) -> str:
    return f" ?{letter}+| ?{number}+|'(?:[stmd]|re|ve|ll)| ?{other}+|[{white}]+(?![^{white}])|[{white}]+"


@cache
def splitters():
    """Three equal ways to cut a text: for ASCII, for texts whose only numbers are decimal digits, and for any.

    The re module is several times as fast as regex, but knows no categories: its \\w without digits and underscore are
    the letters and the numbers that are no decimal digits, hence the check for such numbers.
    """
    import regex

    ascii_rule = re.compile(_rule("[A-Za-z]", "[0-9]", rf"[^{WHITE_ASCII}A-Za-z0-9]", WHITE_ASCII))
    plain_rule = re.compile(_rule(r"[^\W\d_]", r"\d", rf"(?:_|[^\w{WHITE}])", WHITE))
    odd_number = regex.compile(r"[\p{Nl}\p{No}]")
    full_rule = regex.compile(_rule(r"\p{L}", r"\p{N}", rf"[^{WHITE}\p{{L}}\p{{N}}]", WHITE))
    return ascii_rule.findall, plain_rule.findall, odd_number.search, full_rule.findall


def split_words(text: str) -> list[str]:
    """The words of ``text``; joined they are the text again."""
    in_ascii, plain, odd, full = splitters()
    if text.isascii():
        return in_ascii(text)
    return full(text) if odd(text) else plain(text)


@cache
def _classes() -> tuple[list[tuple[set[str], set[str], set[str]]], set[str]]:
    """Letters, numbers and white space as the tokenizer's library, regex and re have them, and the numbers for which re isn't asked."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    library = lambda rule: set(bytes(tiktoken.Encoding("bytes", pat_str=rule, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
    white = set(re.findall(f"[{WHITE}]", every))
    ours = [
        (library(r"\p{L}"), library(r"\p{N}"), library(r"\s")),
        (set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every)), white),
        (set(re.findall(r"[^\W\d_]", every)), set(re.findall(r"\d", every)), white),
    ]
    return ours, set(regex.findall(r"[\p{Nl}\p{No}]", every))


def disputed(spark: SparkSession) -> np.ndarray:
    """The characters that the executors' JVM, Python and the tokenizer's library don't class alike (some ten thousand), as a truth value for each code point."""

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"s": ["".join(chr(c) for c in range(k << 12, k + 1 << 12) if not 0xD800 <= c < 0xE000) for k in batch.column(0).to_pylist()]})

    only = [F.regexp_replace("s", rf"(?U){other}+", "") for other in (r"\P{L}", r"\P{N}", r"\S")]
    rows = [set("".join(x)) for x in zip(*spark.range(0, 0x110000 >> 12, 1, 2).mapInArrow(chars, "s string").select(*only).collect())]
    (library, full, plain), odd = _classes()
    out: set[str] = set()
    for k in range(3):
        out |= (library[k] ^ rows[k]) | (library[k] ^ full[k]) | ((library[k] ^ plain[k]) - odd)
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in out]] = True
    return table


@cache
def encoder(path: str):
    """The tokenizer of a file of ranks, without special tokens; cached by worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    rule = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("public", pat_str=rule, mergeable_ranks=ranks, special_tokens={})


def _lists(values: list) -> pa.Array:
    """A column of lists of int from sequences of int."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int32, len(values)), out=ends[1:])
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def word_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``word, n, ids``: each distinct word of the corpus, the number of its occurrences and its ids."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(SPLIT_JVM), F.lit(0))).alias("word"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path).encode_ordinary
        for batch in batches:
            ids = _lists([one(w) for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["word", "n", "ids"])

    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return kept(counted.mapInArrow(encode, "word string, n bigint, ids array<int>"), "words")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", hot_words: int = HOT_WORDS) -> DataFrame:
    """``<key>, ids`` of each row of ``docs``; see the module for the method and the odd cases."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = docs.schema["key"].dataType.simpleString()
    path = f"{tokenizers}/{name}.tiktoken"
    words = word_table(docs, "text", path)
    apart = spark.sparkContext.broadcast(disputed(spark))
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = (F.col("n") * F.lit(hot_words) >= F.lit(total)) | F.col("word").rlike(SHORT_NUMBER)
    known, lists = [], []
    for r in words.where(hot).select("word", "ids").toLocalIterator():
        known.append(r.word)
        lists.append(r.ids)
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(known)})
    held = spark.sparkContext.broadcast((np.fromiter(chain.from_iterable(lists), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, of = TaskContext.get().partitionId(), 0, number.value.get
        flat_ids, ends = held.value
        size = np.append(np.diff(ends), 0)  # the last is for words without a number, -1
        differs = apart.value
        for whole_batch in batches:
            for batch in (whole_batch.slice(k, TEXTS_AT_ONCE) for k in range(0, len(whole_batch), TEXTS_AT_ONCE)):
                words: list[str] = []
                starts = []
                alone: list[int] = []  # where a text stands as one word, as it is encoded whole
                for t in batch.column(1).to_pylist():
                    starts.append(len(words))
                    if t and (t.isascii() or not differs[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()):
                        words += split_words(t)
                    elif t:
                        alone.append(len(words))
                        words.append(t)
                numbers = np.fromiter(map(of, words, repeat(-1)), np.int64, len(words))
                all_ids, all_ends, all_size = flat_ids, ends, size
                if alone:
                    lists = [encoder(path).encode_ordinary(words[i]) for i in alone]
                    numbers[alone] = len(ends) - 1 + np.arange(len(alone))
                    all_ids = np.concatenate([flat_ids, np.fromiter(chain.from_iterable(lists), np.int32)])
                    all_ends = np.append(ends, ends[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64))
                    all_size = np.append(np.diff(all_ends), 0)
                gap = np.flatnonzero(numbers < 0)
                sizes = all_size[numbers]
                before = np.concatenate([[0], np.cumsum(sizes)])
                # the ids of all words in a row: from each word's first id on, as many as it has
                ids = all_ids[np.repeat(all_ends[numbers] - before[:-1], sizes) + np.arange(before[-1])]
                first = np.array(starts)
                edges = np.sort(np.concatenate([first, gap]), kind="stable")
                gap_ends = np.append(np.searchsorted(gap, first), len(gap)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(np.append(before[edges], before[-1]).astype(np.int32)), pa.array(ids))
                nested = pa.ListArray.from_arrays(pa.array(gap_ends + np.arange(len(first) + 1, dtype=np.int32)), runs)
                gaps = pa.ListArray.from_arrays(pa.array(gap_ends), pa.array([words[i] for i in gap], pa.string()))
                rows = pa.array(np.arange(row, row + len(batch)) + (part << 40))
                row += len(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, nested, gaps], ["key", "row", "runs", "gaps"])

    placed = kept(docs.mapInArrow(place, f"key {key_type}, row bigint, runs array<array<int>>, gaps array<string>"), "placed")
    whole = placed.where(F.size("gaps") == 0).select("key", F.col("runs")[0].alias("ids"))
    open_ = placed.where(F.size("gaps") > 0)
    known_ids = F.coalesce("ids", F.raise_error(F.concat(F.lit("a word without ids: "), "word")).cast("array<int>"))
    rare = (
        open_.select("row", F.posexplode("gaps").alias("pos", "word"))
        .join(words.where(~hot).select("word", "ids"), "word", "left")
        .select("row", "pos", known_ids.alias("ids"))
        .groupBy("row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("fill"))
    )
    filled = open_.select("key", "row", "runs").join(rare, "row").select("key", F.flatten(F.zip_with("runs", "fill", lambda a, b: F.when(b.isNull(), a).otherwise(F.concat(a, b)))).alias("ids"))
    return whole.unionByName(filled).select(F.col("key").alias(key), "ids")


def pieces(spark: SparkSession, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``id, piece`` (in hex) of the vocabulary: 50,256 rows, a bound that the tokenizer sets."""
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        rows = [(int(rank), base64.b64decode(piece).hex()) for piece, rank in map(bytes.split, f)]
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": [p for _, p in rows]}))


def decode(ids: DataFrame, key: str = "doc_id", column: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``<key>, text`` from lists of ids, by a join of every id with its piece.

    An empty list gives the empty text and a null list a null text; an id that isn't in the vocabulary is
    an error of the input and makes the text null. Rows with null or repeated keys are decoded each for itself.
    """
    rows = ids.select(F.col(key).alias("key"), F.col(column).alias("ids"), F.monotonically_increasing_id().alias("row"))
    placed = kept(rows, "ids").repartition("row")  # numbers are stored, so they stay the same whatever is computed again
    each = placed.select("row", "key", F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("pos", "id"))
    met = each.join(F.broadcast(pieces(ids.sparkSession, tokenizers, name)), "id", "left")
    one = met.groupBy("row").agg(F.first("key").alias("key"), F.first("none").alias("none"), F.bool_or(F.col("pos").isNotNull() & F.col("piece").isNull()).alias("bad"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    return one.select(F.col("key").alias(key), F.when(~F.col("none") & ~F.col("bad"), text).alias("text"))
