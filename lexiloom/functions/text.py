"""Text columns: white space, cleaning, alternatives of a gloss, bracketed tags, normal forms for scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as scripts of the web count it, which is wider than Java's \s.
WHITE = "[\\t-\\r    -     　﻿]"
# Parts of speech whose answers are infinitives.
VERBS = ["action", "verb"]
# Words that are spelled in two ways.
DIALECT_PAIRS = [
    ("centre", "center"), ("theatre", "theater"), ("metre", "meter"), ("behaviour", "behavior"), ("favour", "favor"), ("favourite", "favorite"), ("harbour", "harbor"), ("labour", "labor"),
    ("neighbour", "neighbor"), ("armour", "armor"), ("parlour", "parlor"), ("organise", "organize"), ("realise", "realize"), ("organisation", "organization"), ("sterilisation", "sterilization"),
    ("oesophagus", "esophagus"), ("anaesthesia", "anesthesia"), ("caesarean", "cesarean"), ("diarrhoea", "diarrhea"), ("orthopaedic", "orthopedic"), ("faeces", "feces"), ("defence", "defense"),
    ("licence", "license"), ("counselling", "counseling"), ("traveller", "traveler"), ("jewellery", "jewelry"), ("programme", "program"), ("aluminium", "aluminum"), ("plough", "plow"),
    ("sceptical", "skeptical"), ("storey", "story"), ("grey", "gray"), ("moustache", "mustache"),
]


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as the empty text."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), f"{WHITE}+", " ")
    return F.trim(one)


def clean_text(c: Column) -> Column:
    """Underscores as spaces, then collapsed."""
    return collapse(F.translate(c, "_", " "))


def split_top_level(c: Column) -> Column:
    """The alternatives between ``,`` ``;`` ``|`` outside of brackets. An open bracket keeps the rest together.

    A text without ``(`` is split by a pattern; only others are folded character by character.
    """
    text = F.coalesce(c, F.lit(""))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, ch: Column) -> Column:
        cut = ch.isin(",", ";", "|") & (s["depth"] == 0)
        depth = F.when(ch == "(", s["depth"] + 1).when(ch == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["cur"], ch)).alias("cur"), F.when(cut, F.array_append(s["parts"], s["cur"])).otherwise(s["parts"]).alias("parts"))

    folded = F.aggregate(F.split(text, ""), start, step, lambda s: F.array_append(s["parts"], s["cur"]))
    return F.when(F.instr(text, "(") > 0, folded).otherwise(F.split(text, "[,;|]"))


def base_answers(gloss: Column) -> Column:
    """The distinct cleaned alternatives of a gloss, in order."""
    return F.array_distinct(F.filter(F.transform(split_top_level(gloss), clean_text), lambda x: x != ""))


def inner_tags(c: Column) -> Column:
    """The bracketed tags of a value, trimmed and in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda t: F.lower(F.regexp_replace(t, f"^{WHITE}+|{WHITE}+$", "")))


def _without_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WHITE}*\([^)]*\){WHITE}*", " "))


def bare_head(c: Column) -> Column:
    """A value without tags and without hyphens that stand alone."""
    s = F.regexp_replace(_without_tags(c), r" +- +", " ")
    s = F.regexp_replace(s, r" +- *$", "")
    return collapse(F.regexp_replace(s, r"^ *- +", ""))


def stray_separator(c: Column) -> Column:
    """Whether a hyphen stands alone beside a space."""
    return _without_tags(c).rlike(r" -( |$)|(^| )- ")


def plural_of(head: Column, tag: Column) -> Column:
    """The plural that a tag stands for; null for other tags and an empty head."""
    return F.when(head == "", None).when(tag == "es", F.concat(head, F.lit("es"))).when(tag.isin("s", "pl", "plural"), F.concat(head, F.lit("s")))


def needs_curation(base: Column) -> Column:
    """Whether any alternative has a stray hyphen or a tag other than a number, s or es."""
    return F.exists(base, lambda b: stray_separator(b) | F.exists(inner_tags(b), lambda t: ~t.rlike(r"^([0-9]+|s|es)$")))


def is_clean(c: Column) -> Column:
    return (F.instr(c, "(") == 0) & ~stray_separator(c)


def dialect_variant(c: Column, pairs: list[tuple[str, str]] = DIALECT_PAIRS) -> Column:
    """The value with each word that has another spelling in that one; null if there is none."""
    both = [x for a, b in pairs for x in ((a, b), (b, a))]
    table = F.create_map(*[F.lit(x) for p in both for x in p])
    words = F.split(collapse(c), " ")
    some = F.exists(words, lambda w: F.try_element_at(table, F.lower(w)).isNotNull())
    return F.when(some, F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " "))


def normalize_answer(c: Column, pos: Column | None = None) -> Column:
    """The form in which answers and guesses are compared; with a verb's part of speech as an infinitive."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['’]", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, f"[^a-z0-9{WHITE[1:-1]}-]", " "), f"{WHITE}+", " "))
    if pos is None:
        return s
    verb = F.lower(F.trim(F.coalesce(pos, F.lit("")))).isin(*VERBS)
    return F.when(verb & (s != "") & ~s.startswith("to "), F.concat(F.lit("to "), s)).otherwise(s)
