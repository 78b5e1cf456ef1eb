"""One form for texts that look the same.

A text is brought to its form in four steps: wide and narrow forms become the usual ones, kinds of space become the space and
invisible characters go; accents are composed (NFC); and look-alike letters are repaired by script, token by token. A token
is a run of letters and marks of the scripts of ``TWINS`` and Latin. Only a token of several scripts is repaired, and its
dominant script is the one in which it can be written whole: a letter without twin tells it; where several are left it is the one that
most letters have, Latin before the others. The token is replaced if that result, or else that of the next script, is a word of the corpus, as stored in any
text (``repairs``); all others are left as they are, so words of one script, such as the Russian ones that consist of look-alikes, stay in it.

Whether two texts look the same doesn't depend on what the corpus holds: with each form comes ``look``, the digest of the form with every letter
in the letter that it looks like. Texts that differ in a look-alike of a word that nobody else writes (identifiers, encoded images) keep
different forms, but have one look.

The look-alikes are single letters of four scripts that have a Latin twin in the public list of confusables and can hardly be told from it in common
fonts, also with accents; and two letters of the Latin script itself. Left as they are: mathematical letters (a reader sees their style), the dotless i, and letters
that only look like another in some fonts.

Null stays null and the empty text stays empty. ASCII texts are in their form already and aren't sent to Python. Repeated rows
and null keys are kept. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

#: The largest number of repairs that is broadcast; beyond it they are joined to the rows.
CHOICES = 200_000
#: Rows of a class that meet in one task when its pairs are listed.
BLOCK = 500

# Letters of other scripts with the Latin letter they look like, and characters that aren't seen.
TWINS = {
    "cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХѴҮӀаеѕіјорсухһԁԛԝѵүӏ", "ABESIJKMHOPCTYXVYIaesijopcyxhdqwvyl")),
    "greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοανιρυγϲϳ", "ABEZHIKMNOPTYXCJoavipuycj")),
    "armenian": dict(zip("ՍՏՕԼսօհոցզյ", "USOLuohngqj")),
    "cherokee": dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏕᏙᏞᏟᏢᏦᏴᎩ", "DRTAJEWMHGZSVLCPKBY")),
}
LATIN = {"ɑ": "a", "ɡ": "g"}
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Where the scripts stand.
BLOCKS = {"greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "cherokee": "Ꭰ-᏿"}
LATIN_LETTERS = "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ"
OTHERS = "".join(BLOCKS.values())
MARKS = "̀-ͯ"
TOKEN_LETTERS = LATIN_LETTERS + MARKS + OTHERS


@cache
def folds() -> dict[str, str]:
    """Each character that is replaced before anything else, with what replaces it ('' for the invisible)."""
    out = {chr(c): "" for c in INVISIBLE} | {chr(c): " " for c in SPACES}
    for c in map(chr, range(0xFF01, 0xFFEF)):
        kind, _, code = unicodedata.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            out[c] = "".join(chr(int(x, 16)) for x in code.split())
    return out


@cache
def scripts() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The Latin twin of each letter, accented ones included; and for each script its letter by Latin twin."""
    twin: dict[str, str] = {}
    own: dict[str, dict[str, str]] = {name: {} for name in ("latin", *TWINS)}
    for name, letters in TWINS.items():
        for c in map(chr, (*range(0x370, 0x590), *range(0x13A0, 0x1400), *range(0x1F00, 0x2000))):
            whole = unicodedata.normalize("NFD", c)
            if whole[0] in letters:
                latin = unicodedata.normalize("NFC", letters[whole[0]] + whole[1:])
                if len(latin) == 1:
                    twin[c] = latin
                    own[name].setdefault(latin, c)
        for c, latin in letters.items():
            twin[c] = latin
            own[name][latin] = c
    return twin, own


@cache
def script_of(c: str) -> str:
    """latin, cyrillic, greek, armenian, cherokee, or '' for a mark."""
    if unicodedata.category(c).startswith("M"):
        return ""
    return "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "cyrillic" if "Ѐ" <= c <= "ԯ" else "armenian" if "԰" <= c <= "֏" else "cherokee" if "Ꭰ" <= c <= "᏿" else "latin"


def written(token: str, name: str) -> str | None:
    """The token in a script; None if a letter has no twin there."""
    twin, own = scripts()
    letters = []
    for c in token:
        s = script_of(c)
        if s in ("", name):
            letters.append(c)
        else:
            latin = c if s == "latin" else twin.get(c)
            letters.append(latin if name == "latin" else own[name].get(latin))
    return None if None in letters else "".join(letters)


def repairs_of(token: str) -> list[str]:
    """What a token of several scripts is in each of them, the dominant one first; none for others and where it can't be written whole in any."""
    count: dict[str, int] = {}
    for c in token:
        if s := script_of(c):
            count[s] = count.get(s, 0) + 1
    if len(count) < 2:
        return []
    return [w for s in sorted(count, key=lambda s: (-count[s], s != "latin", s)) if (w := written(token, s)) is not None]


def skeleton(text: str) -> str:
    """All letters as what they look like."""
    return unicodedata.normalize("NFC", text.translate(_translation())) if _patterns()[3].search(text) else text


@cache
def _translation() -> dict[int, str]:
    return str.maketrans({**scripts()[0], **LATIN})


@cache
def _patterns():
    return re.compile(f"[{''.join(map(re.escape, folds()))}]"), re.compile(f"[{OTHERS}]"), re.compile(f"[{TOKEN_LETTERS}]+"), re.compile(f"[{OTHERS}{''.join(LATIN)}]")


def folded(text: str) -> str:
    """``text`` after all steps but the repair of look-alike letters."""
    return unicodedata.normalize("NFC", _patterns()[0].sub(lambda m: folds()[m[0]], text))


def canonical(text: str, choice: dict[str, str]) -> str:
    """The form of a text; ``choice`` has the tokens to replace."""
    text = folded(text)
    _, others, token, _ = _patterns()
    if not others.search(text):
        return text
    return unicodedata.normalize("NFC", token.sub(lambda m: choice.get(m[0], m[0]), text))


def look_of(form: str) -> bytes:
    return hashlib.md5(skeleton(form).encode("utf-8", "surrogatepass")).digest()


NOT_ASCII = r"[^\x00-\x7F]"


def repairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, result``: the tokens of several scripts whose result in the dominant script is a word of the corpus; kept in the shared folder.

    The words of all texts are looked up in the results, which are few and are broadcast where they are small, so the vocabulary isn't shuffled.
    """
    one = {c: v for c, v in folds().items() if len(v) == 1}
    gone = "".join(c for c, v in folds().items() if not v)
    clean = F.translate(F.col(text), "".join(one) + gone, "".join(one.values()))
    letters = F.lit(f"[{TOKEN_LETTERS}]+")
    mixed = docs.where(F.col(text).rlike(f"[{OTHERS}]")).select(F.explode(F.array_distinct(F.regexp_extract_all(clean, letters, F.lit(0)))).alias("token"))
    mixed = mixed.where(F.col("token").rlike(f"[{OTHERS}]") & F.col("token").rlike(f"[{LATIN_LETTERS}]|[{BLOCKS['greek']}].*[{BLOCKS['cyrillic']}]|[{BLOCKS['cyrillic']}].*[{BLOCKS['greek']}]|[{BLOCKS['armenian']}{BLOCKS['cherokee']}]")).distinct()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = sorted({unicodedata.normalize("NFC", t) for t in batch.column(0).to_pylist()})
            found = [(t, r, k) for t in tokens for k, r in enumerate(repairs_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["token", "result", "nth"])

    asked = kept(mixed.mapInArrow(repair, "token string, result string, nth int").distinct(), "mixed")
    results = kept(asked.select("result").distinct(), "results")  # a table of known size, so that the join can be planned as a broadcast
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), letters, F.lit(0)))).alias("result"))
    known = words.join(results, "result", "left_semi").distinct()
    return kept(asked.join(known, "result").groupBy("token").agg(F.min_by("result", "nth").alias("result")), "repairs")


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHOICES) -> DataFrame:
    """``<key>, text, look``: every row with its text in the one form, and the digest of what it looks like."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    chosen = repairs(docs)
    other = F.when(F.col("text").rlike(NOT_ASCII), F.col("text"))
    both = "struct<text:string,look:binary>"

    def out(rows: DataFrame, form: Column) -> DataFrame:
        plain = F.struct(F.col("text"), F.unhex(F.md5("text")).alias("look"))
        rows = rows.withColumn("form", form)
        return rows.select(F.col("key").alias(key), F.when(F.col("form.text").isNull(), plain).otherwise(F.col("form")).alias("f")).select(key, "f.text", "f.look")

    def formed(texts: pd.Series, choice_of) -> pd.DataFrame:
        forms = [None if t is None else canonical(t, c) for t, c in zip(texts, choice_of)]
        return pd.DataFrame({"text": pd.Series(forms, dtype=object), "look": pd.Series([None if f is None else look_of(f) for f in forms], dtype=object)})

    if chosen.count() <= limit:
        held = docs.sparkSession.sparkContext.broadcast({r.token: r.result for r in chosen.toLocalIterator()})

        @F.pandas_udf(both)
        def form(texts: pd.Series) -> pd.DataFrame:
            return formed(texts, repeat(held.value))

        return out(docs, form(other))

    @F.pandas_udf(both)
    def form_by(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        return formed(texts, [dict(c) if c is not None else {} for c in own])

    @F.pandas_udf("array<string>")
    def mixed_tokens(texts: pd.Series) -> pd.Series:
        token = _patterns()[2]
        return texts.map(lambda t: [] if t is None else sorted({w for w in token.findall(folded(t)) if not w.isascii()}))

    docs = kept(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    own = (
        docs.select("row", F.explode(mixed_tokens(other)).alias("token"))
        .join(chosen, "token")
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "result"))).alias("own"))
    )
    return out(docs.join(own, "row", "left"), form_by(other, F.col("own")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHOICES) -> DataFrame:
    """``<key>, look, raw``: the rows of non-empty texts that look like a text that is stored differently, with the digests of their look and of their text.

    Rows of one look are one class and those of one ``raw`` in it are word-for-word copies, so a class of any size has one row for each of its rows.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> '' and key is not null")
    forms = normalised(docs.select(F.struct("key", F.md5("text").alias("raw")).alias("id"), "text"), key="id", limit=limit)
    marks = kept(forms.select("id.key", "look", F.unhex("id.raw").alias("raw")), "looks")
    mixed = marks.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    return marks.join(mixed, "look", "left_semi").select(F.col("key").alias(key), "look", "raw")


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_a, doc_b``: each two rows of a class that differ as stored, smaller key first.

    A class is cut into blocks of about ``block`` rows, and each two of its blocks meet for themselves, so that no task lists the pairs of a large class.
    """
    some = kept(classes(docs, key, text).withColumnRenamed(key, "key"), "classes")
    sizes = some.groupBy("look").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = some.join(sizes, "look").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.select("look", "raw", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    a = rows.where("own <= other").select("look", F.col("own").alias("lo"), F.col("other").alias("hi"), F.col("raw").alias("raw_a"), F.col("key").alias("a"))
    b = rows.where("own >= other").select("look", F.col("other").alias("lo"), F.col("own").alias("hi"), F.col("raw").alias("raw_b"), F.col("key").alias("b"))
    met = a.join(b, ["look", "lo", "hi"]).where("raw_a <> raw_b and (lo < hi or a < b) and a <> b")
    return met.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
