"""A lexicon: normalised entries, their parsed spellings, and the key tables of the lookups."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.spelling import resolve_id, with_parsed
from lexiloom.functions.text import clean_text
from lexiloom.operators.answers import answer_key
from lexiloom.sources.tables import kept

FLAGS = {"isChar": "is_char", "isWord": "is_word", "isIndicator": "is_indicator", "isNonPreferred": "is_non_preferred", "isDualForm": "is_dual_form", "isPrimitive": "is_primitive"}


def normalized(raw: DataFrame) -> DataFrame:
    """Raw entries (see sources.snapshot) as rows of a lexicon: id ``B<n>``, texts '' where missing, flags false where missing.

    An id that isn't a whole number is an error. The file's name isn't taken over.
    """
    have = set(raw.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    number = F.when(F.col("id").isNull(), F.raise_error(F.lit("an entry has no whole number as id"))).otherwise(F.col("id").cast("bigint"))
    parts = F.coalesce(F.col("derivationParts"), F.array().cast(raw.schema["derivationParts"].dataType)) if "derivationParts" in have else F.array().cast("array<struct<id:string,code:string,gloss:string,bciAvId:string>>")
    out = raw.select(
        number.alias("numeric_id"), F.col("code").alias("code"), text("gloss").alias("gloss"), text("pos").alias("pos"), text("explanation").alias("explanation"),
        *[(F.coalesce(F.col(k), F.lit(False)) if k in have else F.lit(False)).alias(v) for k, v in FLAGS.items()],
        parts.alias("derivation_parts"), (F.col("ordinal") if "ordinal" in have else number).cast("bigint").alias("ordinal"),
    )
    return out.withColumn("id", F.concat(F.lit("B"), F.col("numeric_id").cast("string")))


class Lexicon:
    """Lookup tables over entries with ``id, numeric_id, ordinal, code, gloss, pos, is_non_preferred``.

    ``indicators`` is a table of codes with group, name and purpose. An entry with a mark that isn't one of them is atomic: it is shown
    and found by its own id only. The set of marks is a reference table of some dozens, checked to have at most ``MARKS``. ``curated`` has the
    reviewed answers (target_id, reviewed, note), which replace those by rule.
    """

    MARKS = 10_000

    def __init__(self, entries: DataFrame, indicators: DataFrame, modifiers: list[dict] | None = None, exceptions: list[tuple[str, str]] | None = None, curated: DataFrame | None = None):
        self.spark = entries.sparkSession
        self.raw = entries
        self.indicators = indicators
        self.modifiers = modifiers or []
        self.exceptions = exceptions or []
        self.curated = curated

    @cached_property
    def reference(self) -> dict[str, tuple[str, str, str]]:
        """Name, group and purpose of each mark."""
        rows = self.indicators.select("code", "name", "group", "purpose").dropDuplicates(["code"]).limit(self.MARKS + 1).collect()
        if len(rows) > self.MARKS:
            raise ValueError(f"more than {self.MARKS} marks")
        return {r.code: (r["name"] or "", r["group"] or "", r["purpose"] or "") for r in sorted(rows)}

    @property
    def marks(self) -> list[str]:
        return list(self.reference)

    def _parsed(self, entries: DataFrame) -> DataFrame:
        known = F.array(*map(F.lit, self.marks)).cast("array<string>")
        strange = F.exists("chars", lambda c: F.exists(c["indicators"], lambda m: ~F.array_contains(known, m)))
        return with_parsed(entries, "code").withColumn("atomic", F.coalesce(strange, F.lit(False)))

    @cached_property
    def entries(self) -> DataFrame:
        """The entries, parsed; with ``atomic``, ``shown`` (display spelling) and ``shown_base``. Parsed once and kept in the shared folder: every lookup reads its columns of it."""
        parsed = self._parsed(self.raw)
        own = lambda c: F.when(F.col("atomic") | F.col("canonical").isNull(), F.col("id")).otherwise(F.col(c))
        return kept(parsed.withColumn("shown", own("canonical")).withColumn("shown_base", own("base_key")), "lexicon")

    @cached_property
    def plain(self) -> DataFrame:
        """``id, numeric_id, ordinal, is_non_preferred, atomic, canonical, base_key`` of the entries: what matches need. Where the entries aren't kept yet only these columns are
        parsed and kept, so their texts are neither joined nor written."""
        columns = ["id", "numeric_id", "ordinal", "is_non_preferred", "atomic", "canonical", "base_key"]
        if "entries" in self.__dict__:
            return self.entries.select(*columns)
        return kept(self._parsed(self.raw.select("id", "numeric_id", "ordinal", "code", "is_non_preferred")).select(*columns), "plain")

    @cached_property
    def words(self) -> DataFrame:
        """The entries whose code is a word."""
        return self.entries.where("canonical is not null")

    @cached_property
    def preferred(self) -> DataFrame:
        return self.entries.where("not is_non_preferred")

    @cached_property
    def base_keys(self) -> DataFrame:
        """``key, helper_id, helper_no, ordinal``: preferred entries by id and, unless atomic, by base sequence."""
        own = F.when(F.col("atomic") | F.col("canonical").isNull(), F.col("id")).otherwise(F.col("base_key"))
        keys = F.array_distinct(F.array("id", own))
        return self.plain.where("not is_non_preferred").select(F.explode(keys).alias("key"), F.col("id").alias("helper_id"), F.col("numeric_id").alias("helper_no"), "ordinal")

    @cached_property
    def spelling_keys(self) -> DataFrame:
        """``key, id``: preferred entries by id and by canonical spelling."""
        keys = F.array_distinct(F.array_compact(F.array("id", "canonical")))
        return self.preferred.select(F.explode(keys).alias("key"), "id", "numeric_id", "ordinal")

    def get(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """``asked`` and the entry of each asked id (``12``, ``B12``, ``b012``); of repeated ids the last entry."""
        last = self.entries.groupBy("id").agg(F.max_by(F.struct("shown", "gloss", "pos", "is_non_preferred"), F.struct("ordinal", "code")).alias("e"))
        return ids.select(F.col(column).cast("string").alias("asked")).withColumn("id", resolve_id(F.col("asked"))).join(last, "id").select("asked", "id", "e.shown", "e.gloss", "e.pos")

    def find_by_spelling(self, spellings: DataFrame, column: str = "spelling") -> DataFrame:
        """``asked, id``: preferred entries of each spelling's canonical form; none for what isn't a word."""
        asked = with_parsed(spellings.select(F.col(column).alias("asked")), "asked").select("asked", F.col("canonical").alias("key"))
        return asked.where("key is not null").join(self.spelling_keys, "key").select("asked", "id", "ordinal")

    def find_by_base(self, spellings: DataFrame, column: str = "spelling") -> DataFrame:
        """``asked, id``: preferred entries with a spelling's base sequence, whatever their marks."""
        asked = with_parsed(spellings.select(F.col(column).alias("asked")), "asked").select("asked", F.col("base_key").alias("key"))
        return asked.where("key is not null").join(self.base_keys, "key").select("asked", F.col("helper_id").alias("id"), "ordinal")

    def derivation(self) -> DataFrame:
        """``id, part_no, part_id, part_code, part_gloss, part_bci`` of every derivation part. It tells the entry's meaning: never show it with a target."""
        one = self.entries.select("id", F.posexplode("derivation_parts").alias("part_no", "p"))
        return one.select("id", "part_no", F.col("p.id").alias("part_id"), F.col("p.code").alias("part_code"), F.col("p.gloss").alias("part_gloss"), F.col("p.bciAvId").alias("part_bci"))

    def sealed(self) -> DataFrame:
        """``targetId, spelling, charCount`` of the words: nothing that tells their meaning."""
        return self.words.select(F.col("id").alias("targetId"), F.col("canonical").alias("spelling"), F.size("chars").alias("charCount"))

    def marks_in(self, chars: str = "chars", word_marks: str = "word_marks") -> Column:
        """The marks of a parsed spelling in order: spelling, scope, char_index, name, group, purpose; '' for unknown ones."""
        known = F.create_map(*[F.lit(x) for code, about in self.reference.items() for x in (code, "\t".join(about))]) if self.reference else None

        def view(m: Column, scope: str, at: Column) -> Column:
            about = F.split(F.coalesce(F.try_element_at(known, m), F.lit("\t\t")) if known is not None else F.lit("\t\t"), "\t")
            return F.struct(m.alias("spelling"), F.lit(scope).alias("scope"), at.cast("int").alias("char_index"), *[F.get(about, F.lit(i)).alias(c) for i, c in enumerate(("name", "group", "purpose"))])

        inner = F.flatten(F.transform(chars, lambda c: F.transform(c["indicators"], lambda m: view(m, "character", c["index"]))))
        return F.concat(inner, F.transform(word_marks, lambda m: view(m, "whole word", F.lit(None))))

    def marks_of(self, words: DataFrame | None = None) -> DataFrame:
        """``id, mark_no, spelling, scope, char_index, name, group, purpose`` of every mark; '' for unknown ones."""
        words = self.words if words is None else words
        return words.select("id", F.posexplode(self.marks_in()).alias("mark_no", "m")).select("id", "mark_no", "m.*")

    @cached_property
    def views(self) -> DataFrame:
        """What is shown of an entry beside a target: ``id, spelling, base_spelling, gloss, pos, indicators, answers, explanation``. Made once and kept in the shared folder.

        The marks are the entry's own; an atomic entry has none, as its marks are parts of a symbol.
        """
        own = F.when(F.col("atomic") | F.col("canonical").isNull(), F.array().cast("array<struct<spelling:string,scope:string,char_index:int,name:string,group:string,purpose:string>>")).otherwise(self.marks_in())
        told = clean_text(F.col("explanation")) if "explanation" in self.entries.columns else F.lit("")
        one = self.entries.select("id", F.col("shown").alias("spelling"), F.col("shown_base").alias("base_spelling"), "gloss", "pos", own.alias("indicators"), told.alias("explanation"))
        answers = answer_key(self.entries.select("id", "pos", "gloss"), self.curated).select(F.col("target_id").alias("id"), "answers")
        return kept(one.join(answers, "id").select("id", "spelling", "base_spelling", "gloss", "pos", "indicators", "answers", "explanation"), "views")

    def answer_keys(self) -> DataFrame:
        """``id, spelling, pos, answers, explanation`` of the words: what a run is scored against."""
        own = self.words.select("id", "canonical")
        return self.views.join(own, "id").select("id", F.col("canonical").alias("spelling"), "pos", "answers", "explanation")
