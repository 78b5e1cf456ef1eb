"""Commands: ``score`` a file of submissions, ``context`` of a word or spelling, ``modifiers`` and ``indicators`` build references, ``freeze`` evaluation sets.

    python -m lexiloom.cli score --submission run.jsonl --data DIR [--set 100 | --targets FILE] --out scored
    python -m lexiloom.cli context B12/B34 --source snapshot.json --modifiers m.json --indicators i.json [--reviews r.json] [--limit 8|all] [--json]
    python -m lexiloom.cli modifiers list.json --source snapshot.json --indicators i.json --out m.json
    python -m lexiloom.cli indicators list.json --source snapshot.json --out i.json
    python -m lexiloom.cli freeze --source snapshot.json --modifiers m.json --indicators i.json [--reviews r.json] [--targets ids.jsonl] --out DIR [--sizes 50,100] [--seed order-1] [--made-at TIME]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.spelling import resolve_id
from lexiloom.operators import context, matching
from lexiloom.operators.lexicon import Lexicon, normalized
from lexiloom.plans import builders, report
from lexiloom.sources import sinks, snapshot


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    out = sinks.guarded(a.out, a.data)
    sent = snapshot.read_submissions(spark, a.submission)
    answers = snapshot.read_lines(spark, a.answers or f"{a.data}/answers.jsonl", snapshot.ANSWER).drop("ord").withColumnRenamed("targetId", "target_id")
    if a.targets:
        universe, name = snapshot.read_lines(spark, a.targets, snapshot.TARGET), Path(a.targets).stem
    elif a.set:
        universe, name = snapshot.read_set(spark, f"{a.data}/sets", a.set), a.set
    else:
        universe, name = answers.select(F.col("target_id").alias("targetId")), "all"
    manifest = Path(a.data, "manifest.json")
    known = json.loads(manifest.read_text()) if manifest.exists() else {}
    rows, summary = report.score_report(sent, answers, universe.select(F.col("targetId").alias("target_id")), name, {"manifestSha256": known.get("sha256"), "setSeed": known.get("setSeed"), "kitVersion": known.get("kitVersion")})
    sinks.write_frozen(rows, f"{out}.jsonl")
    sinks.write_json(summary, f"{out}.summary.json")
    print(report.report_text(summary))
    return 0


def show(spark: SparkSession, a: argparse.Namespace) -> int:
    kit = snapshot.load_kit(spark, a.source, a.modifiers, a.indicators, a.reviews)
    limit = float("inf") if a.limit == "all" else float(a.limit)
    asked = spark.createDataFrame([(a.what,)], "spelling string")
    own = matching.targets_of(kit.lexicon).join(asked.select(resolve_id(F.col("spelling")).alias("target_id")), "target_id")
    if own.isEmpty():
        own = matching.targets_from(asked)
        if own.isEmpty():
            print(f"not a word of codes: {a.what!r}", file=sys.stderr)
            return 1
    found = context.build(kit.lexicon, own, limit)
    if a.json:
        print("\n".join(r.j for r in found.select(F.to_json(F.struct("*")).alias("j")).collect()))
    else:
        print("\n".join(r.prompt for r in context.prompt(found).collect()))
    return 0


def _lexicon(spark: SparkSession, source: str, indicators: str | None) -> Lexicon:
    entries = json.loads(Path(indicators).read_text(encoding="utf-8"))["entries"] if indicators else []
    marks = spark.createDataFrame([(e["code"], e.get("group", ""), e.get("name", ""), e.get("purpose", "")) for e in entries], "code string, group string, name string, purpose string")
    return Lexicon(normalized(snapshot.read_snapshot(spark, source)), marks)


def build_modifiers(spark: SparkSession, a: argparse.Namespace) -> int:
    found = builders.modifier_reference(json.loads(Path(a.what).read_text(encoding="utf-8")), _lexicon(spark, a.source, a.indicators))
    sinks.write_json(found, a.out)
    print(f"{found['count']} modifiers in {len(found['categories'])} categories")
    return 0


def build_indicators(spark: SparkSession, a: argparse.Namespace) -> int:
    found, warnings = builders.indicator_reference(json.loads(Path(a.what).read_text(encoding="utf-8")), _lexicon(spark, a.source, None))
    sinks.write_json(found, a.out)
    print(f"{found['count']} indicators in {len(found['groups'])} groups", *[f"Warning: {w}" for w in warnings], sep="\n")
    return 0


def freeze(spark: SparkSession, a: argparse.Namespace) -> int:
    kit = snapshot.load_kit(spark, a.source, a.modifiers, a.indicators, a.reviews)
    ids = snapshot.read_lines(spark, a.targets, snapshot.TARGET).select(F.col("targetId").alias("target_id")) if a.targets else kit.lexicon.words.where("not is_non_preferred").select(F.col("id").alias("target_id"))
    Path(a.out).mkdir(parents=True, exist_ok=True)
    manifest = report.freeze(kit.lexicon, ids, a.source, a.out, [int(x) for x in a.sizes.split(",") if x], a.seed, a.made_at)
    Path(a.out, "CONTRACT.md").write_text(report.contract_text(manifest, report.SCORING_RULES), encoding="utf-8")
    print(f"{manifest['counts']['targets']} targets in {len(manifest['sets'])} sets")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, needed: str, optional: str = "", what: bool = False, **defaults: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if what:
            c.add_argument("what")
        for o in needed.split():
            c.add_argument(f"--{o}", required=True)
        for o in optional.split():
            c.add_argument(f"--{o}", default=defaults.get(o.replace("-", "_")))
        return c

    command("score", score, "submission data out", "set targets answers")
    command("context", show, "source modifiers indicators", "reviews limit", what=True, limit="8").add_argument("--json", action="store_true")
    command("modifiers", build_modifiers, "source out", "indicators", what=True)
    command("indicators", build_indicators, "source out", what=True)
    command("freeze", freeze, "source modifiers indicators out", "reviews targets sizes seed made-at", sizes="50,100,300,1000", seed="order-1")
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.appName("lexiloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
