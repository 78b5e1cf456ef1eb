"""Scoring submissions as they arrive: every row is scored against a fixed key; a target that is sent again is scored again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import scoring


def scored_stream(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """The scored rows of a stream of submissions (ord, targetId, candidates, rawResponseText), by a join with the static key. It holds no state."""
    some = submissions.where("targetId is not null and targetId <> ''").withColumn("first_ord", F.col("ord"))
    return scoring.scored(some, answers).withColumnRenamed("first_ord", "ord")


def running_summary(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """``pos, total, top1, top5, mrr`` so far, for output mode complete or update. The state has one row for each part of speech."""
    rows = scored_stream(submissions, answers).withColumn("pos", F.coalesce("pos", F.lit("")))
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return rows.groupBy("pos").agg(F.count(F.lit(1)).alias("total"), mean("top1").alias("top1"), mean("top5").alias("top5"), mean("reciprocal_rank").alias("mrr"))
