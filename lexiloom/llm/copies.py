"""Records that are the same but for their formatting: canonical bytes, radix partitioning, tries.

A record's canonical bytes hold its key and its content: texts in folded case without anything but letters and digits, JSON
value by value with an object's fields in sorted order. Then

1. every partition collapses its own records in a trie whose terminals count, so that a group of copies, however large, leaves
   one head for each partition (more only where a trie is flushed at ``LOCAL`` bytes), and every row keeps just the number of its head;
2. a head is filed under its first 4, 16, 64, ... bytes, each as a number of 64 bits, and one job adds up the bytes under each of these prefixes.
   A prefix that holds more than ``fits`` bytes is split by further bytes: a head's bucket is its shortest prefix that isn't. Long common
   beginnings take no more jobs than short ones. Split prefixes are marked in a bit table of fixed size (``BITS``), which is all that the driver
   gets and broadcasts. Two prefixes may share a bit; then one is split further than it needs to be, for all its strings alike, so copies still meet;
3. each bucket's heads go through one trie, whose terminals give the smallest ord and the sum of the counts;
4. rows get the result through their head's number. A group that holds a third of all rows is spread over as many heads as
   there are partitions, so no key of that join is hot beyond one partition's rows.

Left out are rows with null ord, with a key without letter or digit, or without a text value that has one (null and empty
included). JSON may be nested to any depth. Repeated rows are copies; if they repeat the ord too they
count, but no row is a copy of its own ord. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

#: Bytes of canonical strings that a bucket holds, and about what a partition's trie takes before it is flushed.
FITS = 16 << 20
LOCAL = 64 << 20
#: The lengths of the prefixes by which heads are filed, as far as the longest row can have them, and the bits of the table of split prefixes (4 MB).
DEPTHS = [4**k for k in range(1, 16)]
BITS = 1 << 25
#: What a node of a trie takes beside its bytes.
NODE = 200

_OTHER = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """The letters and digits of ``text`` in folded case."""
    return _OTHER.sub("", text.casefold())


def _number(digits: str) -> str:
    """One writing of a JSON number for each value."""
    mantissa, _, power = digits.lower().partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    exponent = int(power or 0) - len(part)
    number = (whole + part).lstrip("0")
    short = number.rstrip("0")
    return f"{sign}{short}e{exponent + len(number) - len(short)}" if short else "0"


class _Pairs(list):
    """The fields of an object, repeated names included."""


class _Number(str):
    """A number as it is written."""


def _refuse(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def content(text: str) -> str | None:
    """The canonical form of a content; None if it has no text value with a letter or digit."""
    some = False

    def atom(v) -> str:
        nonlocal some
        if isinstance(v, _Number):
            return "#" + _number(v)
        if isinstance(v, str):
            b = bare(v)
            some |= bool(b)
            return '"' + b
        return f"~{v}"

    def put(v) -> str:
        if isinstance(v, _Pairs):
            return "{" + ",".join(sorted(f"{bare(k)}:{put(x)}" for k, x in v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(put, v)) + "]"
        return atom(v)

    try:
        form = put(_DECODER.decode(text))
    except RecursionError:
        some = False
        if (form := _deep(text, atom)) is None:
            some = False
            form = atom(text)
    except ValueError:
        some = False
        form = atom(text)
    return form if some else None


_SCALAR = re.compile(r"[ \t\n\r]*+(?:([\[\]{},:\"])|(true|false|null)|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(\Z))")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str, atom: Callable[[object], str]) -> str | None:
    """The form of JSON of any depth, with the open lists and objects on a stack instead of in calls; None if it isn't valid."""
    # a frame: whether it is an object, its parts, and the part where its open field begins
    frames: list[tuple[bool, list[list[str]]]] = []
    parts: list[str] = []  # of the value being built
    at, want = 0, "value"
    while (m := _SCALAR.match(text, at)) is not None:
        at = m.end()
        mark = m[1]
        if m[4] is not None:
            return "".join(parts) if want == "end" else None
        if want in ("value", "value or ]"):
            if mark == "[":
                frames.append((False, [parts]))
                parts.append("[")
                want = "value or ]"
                continue
            if mark == "{":
                frames.append((True, [parts]))
                want = "name or }"
                continue
            if mark == "]" and want == "value or ]":
                parts.append("]")
                frames.pop()
            elif mark == '"':
                try:
                    value, at = scanstring(text, at, True)
                except ValueError:
                    return None
                parts.append(atom(value))
            elif mark is not None:
                return None
            else:
                parts.append(atom(_WORDS[m[2]] if m[2] else _Number(m[3])))
        elif want in ("name", "name or }"):
            if mark == "}" and want == "name or }":
                parts = frames.pop()[1][0]
                parts.append("{}")
            elif mark == '"':
                try:
                    name, at = scanstring(text, at, True)
                except ValueError:
                    return None
                if (m := _SCALAR.match(text, at)) is None or m[1] != ":":
                    return None
                at = m.end()
                parts = [bare(name), ":"]
                frames[-1][1].append(parts)
                want = "value"
                continue
            else:
                return None
        elif want == "more":
            is_object, held = frames[-1]
            if mark == ",":
                if not is_object:
                    parts.append(",")
                want = "name" if is_object else "value"
                continue
            if mark != ("}" if is_object else "]"):
                return None
            frames.pop()
            if is_object:
                parts = held[0]
                parts.append("{" + ",".join(sorted(map("".join, held[1:]))) + "}")
            else:
                parts.append("]")
        else:
            return None
        want = "more" if frames else "end"
    return None


def canon(key: str | None, value: str | None) -> bytes | None:
    """The canonical bytes of a record, None if it is left out."""
    if key is None or value is None or not (k := bare(key)) or (c := content(value)) is None:
        return None
    return f"{k}|{c}".encode("utf-8", "surrogatepass")


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Byte strings by edges of any length; a terminal is a list that belongs to its string. ``bytes`` is about what it takes."""

    def __init__(self):
        self.root: list = [b"", None, {}]  # edge, terminal, nodes below by their first byte
        self.bytes = 0

    def terminal(self, s: bytes) -> list:
        node, i, n = self.root, 0, len(s)
        while i < n:
            below = node[2].get(s[i])
            if below is None:
                below = node[2][s[i]] = [s[i:], None, {}]
                self.bytes += n - i + NODE
                i = n
            elif s.startswith(below[0], i):
                i += len(below[0])
            else:
                edge = below[0]
                k = _shared(edge, s[i : i + len(edge)])
                below[0] = edge[k:]
                below = node[2][s[i]] = [edge[:k], None, {edge[k]: below}]
                self.bytes += NODE
                i += k
            node = below
        if node[1] is None:
            node[1] = []
        return node[1]

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        stack = [(b"", self.root)]
        while stack:
            s, (edge, found, below) = stack.pop()
            s += edge
            if found is not None:
                yield s, found
            stack += [(s, node) for node in below.values()]


def prefixes(s: bytes) -> list[int]:
    """The numbers of the prefixes by which a string is filed, up to the first that is the whole string."""
    out = []
    for depth in DEPTHS:
        out.append(int.from_bytes(hashlib.blake2b(s[:depth], digest_size=8, salt=depth.to_bytes(4, "big")).digest(), "big", signed=True))
        if depth >= len(s):
            break
    return out


def heads(rows: DataFrame, ord_: str, key: str, value: str, local: int = LOCAL) -> DataFrame:
    """``ord, head`` of every row, and ``head, canon, first, n, prefixes`` of every head; kept in the shared folder."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sys.set_int_max_str_digits(0)  # exponents of any length
        names = ["ord", "head", "canon", "first", "n", "prefixes"]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        head = TaskContext.get().partitionId() << 40
        trie = Trie()

        def flush(trie: Trie) -> Iterator[pa.RecordBatch]:
            group: list = []
            size = 0
            for s, (h, first, n) in trie.terminals():
                group.append((None, h, s, first, n, prefixes(s)))
                size += len(s) + NODE
                if size >= 4 << 20:
                    yield batch_of(group)
                    group, size = [], 0
            if group:
                yield batch_of(group)

        def batch_of(group: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*group), kinds)], names)

        for batch in batches:
            out = []
            for o, k, v in zip(*(c.to_pylist() for c in batch.columns)):
                s = canon(k, v)
                if s is None:
                    continue
                t = trie.terminal(s)
                if t:
                    t[1] = min(t[1], o)
                    t[2] += 1
                else:
                    t += (head, o, 1)
                    head += 1
                out.append((o, t[0], None, None, None, None))
                if trie.bytes >= local:
                    yield from flush(trie)
                    trie = Trie()
            if out:
                yield batch_of(out)
        yield from flush(trie)

    some = rows.select(F.col(ord_).cast("bigint"), F.col(key).cast("string"), F.col(value).cast("string")).where(F.col(ord_).isNotNull())
    return kept(some.mapInArrow(collapse, "ord bigint, head bigint, canon binary, first bigint, n bigint, prefixes array<bigint>"), "heads")


def split_prefixes(head_rows: DataFrame, fits: int = FITS) -> np.ndarray:
    """The bit table of the prefixes that hold more than ``fits`` bytes. A whole string isn't split, however often it comes."""
    each = head_rows.where("canon is not null").select((F.length("canon") + F.lit(NODE)).cast("bigint").alias("bytes"), F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("prefix"))
    full = each.groupBy("prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > fits)
    bit = F.pmod("prefix", F.lit(BITS)) + 1  # Spark's bitmaps count from 1
    bitmaps = full.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    size = 4096  # bytes of one of them
    table = np.zeros(BITS // 8, np.uint8)
    for r in bitmaps.toLocalIterator():
        k = (r["at"] - 1) * size
        table[k : k + size] |= np.frombuffer(r["bits"], np.uint8)
    return table


def bucket_of(numbers: list[int], table: np.ndarray) -> int:
    """The shortest prefix that isn't split, or the whole string."""
    for p in numbers[:-1]:
        bit = p % BITS
        if not table[bit >> 3] >> (bit & 7) & 1:
            return p
    return numbers[-1]


def groups(head_rows: DataFrame, fits: int = FITS) -> DataFrame:
    """``head, kept_ord, copies`` of every head: its group's smallest ord and number of rows."""
    only = head_rows.where("canon is not null").select("prefixes", "head", "canon", "first", "n")
    split = head_rows.sparkSession.sparkContext.broadcast(split_prefixes(head_rows, fits))  # of fixed size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = pa.array([bucket_of(p, split.value) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b, *batch.columns[1:]], ["bucket", "head", "canon", "first", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(trie: Trie) -> Iterator[pa.RecordBatch]:
            h, f, n = [], [], []
            for _, members in trie.terminals():
                first, total = min(m[1] for m in members), sum(m[2] for m in members)
                h += [m[0] for m in members]
                f += [first] * len(members)
                n += [total] * len(members)
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, f, n)], ["head", "kept_ord", "copies"])

        at, trie = None, Trie()
        for batch in batches:
            for b, h, s, f, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at:
                    # buckets come one after the other; small ones share a trie
                    if trie.bytes >= fits // 4:
                        yield from flush(trie)
                        trie = Trie()
                    at = b
                trie.terminal(s).append((h, f, n))
        yield from flush(trie)

    by_bucket = only.mapInArrow(place, "bucket bigint, head bigint, canon binary, first bigint, n bigint").repartition("bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(count, "head bigint, kept_ord bigint, copies bigint")


def copies(rows: DataFrame, ord_: str = "ord", key: str = "targetId", value: str = "candidates", fits: int = FITS) -> DataFrame:
    """``kept_ord, copy_ord``: each set of copies' smallest ord with each other ord."""
    all_heads = heads(rows, ord_, key, value)
    found = groups(all_heads, fits).where("copies > 1").select("head", "kept_ord")
    return all_heads.where("ord is not null").select("ord", "head").join(found, "head").where("ord <> kept_ord").select("kept_ord", F.col("ord").alias("copy_ord")).distinct()


def records(rows: DataFrame, ord_: str = "ord", key: str = "targetId", value: str = "candidates", fits: int = FITS) -> DataFrame:
    """``kept_ord, copies``: one row for each different record, with the number of its rows."""
    return groups(heads(rows, ord_, key, value), fits).select("kept_ord", "copies").distinct()
