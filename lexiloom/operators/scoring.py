"""Scoring ranked guesses against an answer key: last row of a target wins, rank of the first accepted guess, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.candidates import candidates_of
from lexiloom.functions.text import normalize_answer
from lexiloom.sources.tables import kept

TOP = 5


def last_rows(submissions: DataFrame, key: str = "targetId", order: str = "ord") -> DataFrame:
    """Of each target the last row's fields, the first row's order, and how many rows it replaces (``repeats``).

    Rows without a target are left out. Of rows with one target and one order each is kept, if several share the last. Only orders are shuffled by target before
    they are aggregated: the rows come by a join on target and order, so a hot target costs no more.
    """
    some = submissions.where(F.col(key).isNotNull() & (F.col(key) != ""))
    ends = some.groupBy(key).agg(F.max(order).alias("_last"), F.min(order).alias("first_ord"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return some.join(ends.withColumnRenamed("_last", order), [key, order])


def scored(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """``target_id, pos, rank, top1, top5, reciprocal_rank, n_candidates, normalized, accepted, runner, promptVersion`` of submitted targets that have a key.

    ``submissions`` has targetId, candidates, rawResponseText and first_ord, one row for each target, and may have runner and promptVersion; ``answers`` has target_id, pos and
    answers. ``normalized`` are the first guesses and ``accepted`` the answers as they are compared.
    """
    told = [F.col(c) if c in submissions.columns else F.lit(None).cast("string").alias(c) for c in ("runner", "promptVersion")]
    guesses = submissions.withColumn("guesses", candidates_of(F.col("candidates"), F.col("rawResponseText"))).select(F.col("targetId").alias("target_id"), "first_ord", "guesses", *told)
    both = guesses.join(answers.select("target_id", "pos", "answers"), "target_id")
    accepted = F.array_distinct(F.filter(F.transform("answers", lambda a: normalize_answer(a, F.col("pos"))), lambda a: a != ""))
    firsts = F.transform(F.slice("guesses", 1, TOP), lambda g: normalize_answer(g, F.col("pos")))
    place = both.withColumn("_accepted", accepted).withColumn("normalized", firsts).withColumn("_place", F.array_position(F.transform("normalized", lambda g: F.array_contains(F.col("_accepted"), g)), F.lit(True)).cast("int"))
    rank = F.when(F.col("_place") > 0, F.col("_place"))
    return place.select(
        "target_id", "first_ord", "pos", rank.alias("rank"), (F.coalesce(rank, F.lit(0)) == 1).alias("top1"), rank.isNotNull().alias("top5"),
        F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("reciprocal_rank"), F.size("guesses").alias("n_candidates"), "normalized", F.col("_accepted").alias("accepted"), "runner", "promptVersion",
    )


def summary(scores: DataFrame) -> DataFrame:
    """``pos, total, top1, top5, mrr``: one row for all (pos null) and one for each part of speech, in one pass."""
    grouped = scores.select(F.coalesce("pos", F.lit("")).alias("pos"), "top1", "top5", "reciprocal_rank").rollup("pos")
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    return grouped.agg(F.count(F.lit(1)).alias("total"), mean("top1").alias("top1"), mean("top5").alias("top5"), mean("reciprocal_rank").alias("mrr"), F.grouping("pos").alias("_all")).select(F.when(F.col("_all") == 0, F.col("pos")).alias("pos"), "total", "top1", "top5", "mrr")


def missing(universe: DataFrame, submissions: DataFrame) -> DataFrame:
    """Targets of the universe that nobody submitted."""
    return universe.select("target_id").distinct().join(submissions.select(F.col("targetId").alias("target_id")), "target_id", "left_anti")


def extra(universe: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submitted targets that aren't in the universe."""
    some = submissions.where("targetId is not null and targetId <> ''").select(F.col("targetId").alias("target_id")).distinct()
    return some.join(universe.select("target_id"), "target_id", "left_anti")


def coverage(submissions: DataFrame, universe: DataFrame, answers: DataFrame, is_all: bool = True) -> DataFrame:
    """One row: universe, scored, missing, extra, duplicates, malformed, empty and overlong lists among the scored, and whether the run is official.

    The submissions are written once; targets that were sent and those of the universe meet once, and what they say is one aggregate.
    """
    sent = kept(submissions.select("ord", "targetId", "candidates", "rawResponseText"), "sent")
    wanted = universe.select(F.col("target_id").alias("targetId"), F.lit(1).alias("_in")).distinct()
    per = kept(sent.groupBy("targetId").agg(F.count(F.lit(1)).alias("_n"), F.max("ord").alias("ord")), "sent_targets")
    named = F.col("targetId").isNotNull() & (F.col("targetId") != "")
    both = per.join(wanted, "targetId", "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    known, came = F.col("_in").isNotNull(), F.col("_n").isNotNull()
    rows = both.agg(
        count(known).alias("universe_targets"), count(known & ~came).alias("missing"), count(came & ~known & named).alias("extra"),
        total(F.when(named, F.col("_n") - 1)).alias("duplicates"), total(F.when(~named | F.col("targetId").isNull(), F.col("_n"))).alias("malformed"),
    )
    last = sent.join(per.where(named), ["targetId", "ord"]).join(wanted, "targetId", "left_semi").withColumn("first_ord", F.col("ord"))
    got = scored(last, answers).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("n_candidates") == 0).alias("empty_candidates"), F.count_if(F.col("n_candidates") > TOP).alias("overlong_candidates"))
    official = (F.col("missing") == 0) & (F.col("duplicates") == 0) & (F.col("malformed") == 0) & F.lit(is_all)
    one = rows.crossJoin(got)  # two tables of one row
    return one.select("universe_targets", "scored", "empty_candidates", "overlong_candidates", "missing", "extra", "malformed", "duplicates", official.alias("official"))


def runners(submissions: DataFrame) -> DataFrame:
    """``runner, place``: the different runners in order of their first row."""
    first = submissions.where("runner is not null").groupBy("runner").agg(F.min("ord").alias("first_ord"))
    return first.select("runner", F.row_number().over(Window.orderBy("first_ord", "runner")).alias("place"))  # as many rows as runners
