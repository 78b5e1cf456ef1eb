"""Spellings of symbol codes: ``B12/B34;B81;;B97`` is two characters, a mark on the second and one on the whole word.

A word is checked by one pattern and cut by array functions, all in the JVM; what isn't a word is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import WHITE

_MARK = r"(?:!?B[0-9]++|!)"
_CHARACTER = rf";?B[0-9]++(?:;{_MARK})*+;?"
#: A word after white space is gone and codes are in upper case without leading zeros.
WORD = rf"^/?{_CHARACTER}(?:/{_CHARACTER})*/?(?:;;;*(?:{_MARK}(?:;+{_MARK})*)?;*)?$"


def code_token(c: Column) -> Column:
    """One code as ``B`` and a number, null for anything else."""
    t = F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")
    return F.when(t.rlike("^(?i)b[0-9]+$"), F.regexp_replace(t, "^(?i)b0*([0-9]+)$", r"B$1"))


def resolve_id(c: Column) -> Column:
    """A number or code as an id; other texts only trimmed."""
    t = F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")
    return F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("B"), F.regexp_replace(t, "^0*([0-9]+)$", "$1"))).otherwise(F.coalesce(code_token(c), t))


def _marks(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.regexp_replace(x, "^!", "")), lambda x: x != ""))


def with_parsed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``chars`` (array of index, base, spelling, indicators), ``word_marks``, ``base`` (array), ``base_key`` and ``canonical``.

    All are null where the column isn't a word. Columns of these names are replaced.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(column), WHITE, ""), "(?i)B0*([0-9]+)", r"B$1")
    word = F.when(~F.contains(plain, F.lit("//")) & plain.rlike(WORD), plain)
    body = F.substring_index(F.col("_word"), ";;", 1)
    tail = F.expr("substring(_word, length(substring_index(_word, ';;', 1)) + 3)")
    some = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")

    def character(p: Column, i: Column) -> Column:
        codes = some(p, ";")
        marks = _marks(F.slice(codes, F.lit(2), F.size(codes)))
        base = F.get(codes, F.lit(0))
        return F.struct(i.alias("index"), base.alias("base"), F.array_join(F.concat(F.array(base), marks), ";").alias("spelling"), marks.alias("indicators"))

    cut = df.withColumn("_word", word).withColumn("chars", F.transform(some(body, "/"), character)).withColumn("word_marks", _marks(some(tail, ";")))
    joined = F.array_join(F.transform("chars", lambda c: c["spelling"]), "/")
    return (
        cut.withColumn("base", F.transform("chars", lambda c: c["base"]))
        .withColumn("base_key", F.array_join("base", "/"))
        .withColumn("canonical", F.when(F.size("word_marks") > 0, F.concat(joined, F.lit(";;"), F.array_join("word_marks", ";"))).otherwise(joined))
        .drop("_word")
    )


def spans(sequence: Column, least: int = 1, full: bool = False) -> Column:
    """All contiguous spans of an array: structs of start, stop (half open) and key (joined by ``/``)."""
    n = F.size(sequence)

    def from_start(s: Column) -> Column:
        stops = F.when(s + least <= n, F.sequence(s + least, n)).otherwise(F.array().cast("array<int>"))
        return F.transform(stops, lambda e: F.struct(s.alias("start"), e.alias("stop"), F.array_join(F.slice(sequence, s + 1, e - s), "/").alias("key")))

    every = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), from_start))
    return every if full else F.filter(every, lambda x: ~((x["start"] == 0) & (x["stop"] == n)))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    """How many elements two arrays share at the end."""
    return common_prefix(F.reverse(a), F.reverse(b))


def is_sense_mark(c: Column) -> Column:
    """Whether a code is one of the two marks for the concrete and the abstract sense."""
    return code_token(c).isin("B97", "B6436")
