"""Lists of guesses out of what a model sent: a JSON list, an object with one, or prose around one.

All are column expressions: plain lists are read as arrays, other JSON as variants, and the bracketed spans of prose are found from the brackets alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import WHITE

_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_SPACE = r"[ \t\r\n]*+"
#: A JSON list of nothing but strings.
PLAIN_LIST = rf"^{_SPACE}\[{_SPACE}(?:{_STRING}{_SPACE}(?:,{_SPACE}{_STRING}{_SPACE})*+)?\]{_SPACE}$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def array_spans(c: Column) -> Column:
    """The outermost balanced ``[...]`` spans of a text, quotes not minded; null has none.

    The text is cut at its brackets, and only these are gone through: a piece belongs to a span if brackets are open before it. An opening bracket that
    is never closed keeps what follows from being a span.
    """
    marks = F.regexp_extract_all(c, F.lit(r"[\[\]]"), F.lit(0))
    sizes = F.transform(F.split(c, r"[\[\]]", -1), lambda x: F.length(x))
    steps = F.arrays_zip(marks.alias("m"), F.slice(sizes, F.lit(2), F.size(marks)).alias("after"))
    start = F.struct(F.lit(0).alias("open"), (F.get(sizes, F.lit(0)) + 1).alias("at"), F.lit(0).alias("since"), F.array().cast("array<struct<a:int,n:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        opens = x["m"] == "["
        shuts = ~opens & (s["open"] == 1)
        found = F.when(shuts, F.array_append(s["found"], F.struct(s["since"].alias("a"), (s["at"] - s["since"] + 1).alias("n")))).otherwise(s["found"])
        depth = F.when(opens, s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0)))
        since = F.when(opens & (s["open"] == 0), s["at"]).otherwise(s["since"])
        return F.struct(depth.alias("open"), (s["at"] + x["after"] + 1).alias("at"), since.alias("since"), found.alias("found"))

    spans = F.transform(F.aggregate(steps, start, step, lambda s: s["found"]), lambda x: F.substring(c, x["a"], x["n"]))
    return F.when(F.instr(c, "[") > 0, spans).otherwise(F.array().cast("array<string>"))


def _texts(values: Column) -> Column:
    """The strings of a list of variants and of the lists in it, trimmed, without empty ones."""
    kind = F.schema_of_variant

    def inner(x: Column) -> Column:
        return F.transform(F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda y: kind(y) == "STRING"), lambda y: F.try_variant_get(y, "$", "string"))

    one = lambda x: F.when(kind(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).when(kind(x).startswith("ARRAY"), inner(x)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.flatten(F.transform(values, one)), _trimmed), lambda x: x != "")


def _listed(text: Column, objects: bool) -> Column:
    """The texts of JSON that is a list or, if asked, an object with a list of candidates; null for anything else."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    values = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    if objects:
        values = values.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.candidates", "array<variant>"))
    return _texts(values)


def candidates(c: Column) -> Column:
    """The guesses of a text column: those of the whole text if it is JSON with a list, else those of its last bracketed span that has any. Whatever can't be read has none."""
    text = _trimmed(c)
    plain = c.rlike(PLAIN_LIST)
    quick = F.filter(F.transform(F.from_json(F.when(plain, c), "array<string>"), _trimmed), lambda x: x != "")
    whole = _listed(F.when(~plain & text.rlike(r"^[\[{]"), text), True)
    spans = F.transform(array_spans(F.when(~plain, text)), lambda s: F.coalesce(_listed(s, False), F.array().cast("array<string>")))
    last = F.get(F.filter(F.reverse(spans), lambda g: F.size(g) > 0), F.lit(0))
    return F.coalesce(quick, whole, last, F.array().cast("array<string>"))


def candidates_of(candidates_: Column, response: Column) -> Column:
    """Of a row the guesses of its list, or of its response where the list is null."""
    return candidates(F.coalesce(candidates_, response))
