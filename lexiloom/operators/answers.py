"""Answer keys: the accepted forms of an entry, from its gloss by rule or from a reviewed list, with dialect variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T

_FORM = "array<struct<form:string,reason:string>>"


def _by_rule(base: Column) -> Column:
    def one(b: Column) -> Column:
        head = T.bare_head(b)
        why = F.when(T.stray_separator(b), "separator-clean").otherwise("disambiguator-strip")
        plurals = F.filter(F.transform(T.inner_tags(b), lambda t: F.struct(T.plural_of(head, t).alias("form"), F.lit("inflection").alias("reason"))), lambda x: x["form"].isNotNull())
        return F.when(head == "", F.array().cast(_FORM)).otherwise(F.concat(F.array(F.struct(head.alias("form"), why.alias("reason"))), plurals))

    return F.flatten(F.transform(base, one))


def _by_review(base: Column, reviewed: Column) -> Column:
    both = F.concat(F.filter(base, T.is_clean), reviewed)
    return F.filter(F.transform(both, lambda b: F.struct(T.collapse(b).alias("form"), F.lit("curated").alias("reason"))), lambda x: x["form"] != "")


def _first(forms: Column) -> Column:
    """Of each form the first struct."""
    names = F.transform(forms, lambda x: x["form"])
    return F.filter(forms, lambda x, i: F.array_position(names, x["form"]) == i + 1)


def with_answers(entries: DataFrame, gloss: str = "gloss", reviewed: str | None = None) -> DataFrame:
    """``entries`` with ``base_forms``, ``answers``, ``added`` (form and reason) and ``source`` (rule or curated).

    A reviewed list, also an empty one, replaces the rule; clean alternatives of the gloss stay. Forms are distinct and in order. ``added`` are those that
    aren't alternatives of the gloss.
    """
    out = entries.withColumn("base_forms", T.base_answers(F.col(gloss)))
    if reviewed is None:
        out = out.withColumn("source", F.lit("rule")).withColumn("_raw", _by_rule(F.col("base_forms")))
    else:
        has = F.col(reviewed).isNotNull()
        listed = F.filter(F.coalesce(F.col(reviewed), F.array().cast("array<string>")), lambda x: x.isNotNull())
        out = out.withColumn("source", F.when(has, "curated").otherwise("rule")).withColumn("_raw", F.when(has, _by_review(F.col("base_forms"), listed)).otherwise(_by_rule(F.col("base_forms"))))
    out = out.withColumn("_first", _first(F.col("_raw")))  # a column of its own, as the lambdas would evaluate the expression for every element
    variants = F.filter(F.transform("_first", lambda x: F.struct(T.dialect_variant(x["form"]).alias("form"), F.lit("dialect").alias("reason"))), lambda x: x["form"].isNotNull())
    out = out.withColumn("_all", F.concat("_first", variants)).withColumn("_all", _first(F.col("_all")))
    return (
        out.withColumn("answers", F.transform("_all", lambda x: x["form"]))
        .withColumn("added", F.filter("_all", lambda x: ~F.array_contains(F.col("base_forms"), x["form"])))
        .drop("_raw", "_first", "_all")
    )


def latest_reviews(curation: DataFrame) -> DataFrame:
    """``target_id, reviewed, note``: each target's last review that has answers, by its number."""
    some = curation.where("targetId is not null and answers is not null")
    last = some.groupBy(F.col("targetId").alias("target_id")).agg(F.max_by(F.struct("answers", "note"), "curation_id").alias("r"))
    return last.select("target_id", F.col("r.answers").alias("reviewed"), "r.note")


def answer_key(entries: DataFrame, curation: DataFrame | None = None) -> DataFrame:
    """``target_id, pos, answers, base_forms, added, source, note`` of every entry; ``curation`` has target_id, reviewed, note."""
    if curation is None:
        return with_answers(entries).select(F.col("id").alias("target_id"), "pos", "answers", "base_forms", "added", "source", F.lit(None).cast("string").alias("note"))
    both = entries.join(curation.withColumnRenamed("target_id", "id"), "id", "left")
    return with_answers(both, reviewed="reviewed").select(F.col("id").alias("target_id"), "pos", "answers", "base_forms", "added", "source", "note")


def alias_log(key: DataFrame) -> DataFrame:
    """The entries whose answers were widened or reviewed."""
    return key.where((F.size("added") > 0) | (F.col("source") == "curated"))


def alias_stats(key: DataFrame) -> DataFrame:
    """``changed, forms, reviewed, uncurated``: widened entries, forms added, reviewed entries, and entries that need a review and have none."""
    gap = T.needs_curation(F.col("base_forms")) & (F.col("source") == "rule")
    return key.agg(F.count_if(F.size("added") > 0).alias("changed"), F.coalesce(F.sum(F.size("added")), F.lit(0)).cast("bigint").alias("forms"), F.count_if(F.col("source") == "curated").alias("reviewed"), F.count_if(gap).alias("uncurated"))
