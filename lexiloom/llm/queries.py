"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import canonical, copies, encoding, leaks, lookalikes, nested, passages, quotas, replies, together
from lexiloom.sources.tables import table


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the targets."""
    return nested.sample(table(spark, sf, "set_300"), "targetId", 0.1)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copies(table(spark, sf, "submission"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each different record with the number of its copies."""
    return copies.records(table(spark, sf, "submission"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return passages.runs(table(spark, sf, "set_300"))


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each row's spelling is shared with another target."""
    return passages.shares(table(spark, sf, "set_300"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "submission"), table(spark, sf, "run_record"), table(spark, sf, "canonical_gloss")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return replies.found(*_pairs(spark, sf))


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair with its words by tag."""
    return replies.pairs(*_pairs(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.found(table(spark, sf, "submission"), table(spark, sf, "answer_alias_curation"), table(spark, sf, "canonical_gloss"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return quotas.unmet(table(spark, sf, "set_300"), table(spark, sf, "sample_quota"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each quota line with its supply and what the sample holds."""
    return quotas.report(table(spark, sf, "set_300"), table(spark, sf, "sample_quota"))


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quotas.draw(table(spark, sf, "set_300"), table(spark, sf, "sample_quota"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return together.found(table(spark, sf, "set_300")).select(F.col("glyph_a").cast("int").alias("glyph_a"), F.col("glyph_b").cast("int").alias("glyph_b"))


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of glyphs with its counts, odds ratio and lift."""
    p = together.pairs(table(spark, sf, "set_300"))
    return p.select(F.col("glyph_a").cast("int").alias("glyph_a"), F.col("glyph_b").cast("int").alias("glyph_b"), "c", "a", "b", "n", F.round("odds_ratio", 3).alias("odds_ratio"), F.round("lift", 3).alias("lift"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(table(spark, sf, "documents"))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each document's text after encoding and decoding (null as the empty text)."""
    return encoding.decode(encoding.encode(table(spark, sf, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without its leaked spans."""
    return leaks.cleaned(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.pairs(table(spark, sf, "documents"))


def p10_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in its one form."""
    return lookalikes.normalised(table(spark, sf, "documents")).select("doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_sample, p2_found, p2_records, p3_found, p3_shares, p4_found, p4_coverage, p5_found, p6_found, p6_report, p6_sample, p7_found, p7_pairs, p8_ids, p8_roundtrip, p9_found, p9_clean, p10_found, p10_text)}
