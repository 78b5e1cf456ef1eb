"""Score reports, from submitted rows to the summary and its text; frozen sets with their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import __version__
from lexiloom.functions.text import clean_text
from lexiloom.operators import answers as A
from lexiloom.operators import sampling, scoring
from lexiloom.operators.lexicon import Lexicon
from lexiloom.sources import sinks
from lexiloom.sources.tables import kept


#: Most different runners, or prompt versions, that a summary lists.
NAMES = 1000


def score_report(submissions: DataFrame, answers: DataFrame, universe: DataFrame, set_name: str = "all", provenance: dict | None = None) -> tuple[DataFrame, dict]:
    """The scored rows in the order of their first submission, and the summary.

    ``submissions`` has ord, targetId, candidates, rawResponseText and may have runner and promptVersion; ``answers`` target_id, pos and answers; ``universe`` target_id.
    The driver gets one row for each part of speech, one of coverage, and the runners and prompt versions; more than ``NAMES`` of either are an error.
    """
    last = scoring.last_rows(submissions).join(universe.select(F.col("target_id").alias("targetId")).distinct(), "targetId", "left_semi")
    rows = kept(scoring.scored(last, answers), "scored")
    parts = {r.pos: {"total": r.total, "top1": r.top1, "top5": r.top5, "mrr": r.mrr} for r in scoring.summary(rows).collect()}
    whole = parts.pop(None, {"total": 0, "top1": 0.0, "top5": 0.0, "mrr": 0.0})
    cover = scoring.coverage(submissions, universe, answers, set_name == "all").first().asDict()
    names = ("universe_targets", "scored", "missing", "extra", "duplicates", "malformed", "empty_candidates", "overlong_candidates")

    def first_seen(column: str) -> list[str]:
        """The values of the scored rows, in the order of their targets' first rows."""
        seen = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("first_ord").alias("o"))
        names = [r[0] for r in seen.orderBy("o", column).select(column).limit(NAMES + 1).collect()]
        if len(names) > NAMES:
            raise ValueError(f"more than {NAMES} values of {column}")
        return names

    summary = {"set": set_name, "official": cover["official"], **(provenance or {}), "runner": first_seen("runner"), "promptVersion": first_seen("promptVersion"), **whole, "byPos": dict(sorted(parts.items())), "coverage": {n: cover[n] for n in names}}
    return rows.orderBy("first_ord").drop("first_ord"), summary


def report_text(summary: dict) -> str:
    """A summary for people."""
    per = lambda x: f"{100 * x:.1f} %"
    c = summary["coverage"]
    lines = [f"Set: {summary['set']} ({c['scored']} of {c['universe_targets']} scored)", f"Runner: {', '.join(summary['runner']) or '-'}", f"top-1 {per(summary['top1'])}, top-5 {per(summary['top5'])}, MRR {summary['mrr']:.4f}"]
    named = {p: s for p, s in summary["byPos"].items() if p}
    if len(named) > 1:
        lines += [f"  {p}: {s['total']}, top-1 {per(s['top1'])}, top-5 {per(s['top5'])}, MRR {s['mrr']:.4f}" for p, s in named.items()]
    lines += [f"Warning: {c[k]} {k.replace('_', ' ')}" for k in ("missing", "extra", "duplicates", "malformed", "empty_candidates", "overlong_candidates") if c[k]]
    lines.append("Official: " + ("yes" if summary["official"] else "no"))
    return "\n".join(lines)


def freeze(lexicon: Lexicon, targets: DataFrame, source: str, folder: str, sizes: list[int], seed: str, made_at: str | None = None, reviews: DataFrame | None = None) -> dict:
    """Writes sealed targets, answers, the log of aliases, nested sets and the manifest into ``folder``; returns the manifest.

    ``targets`` (target_id) are the entries to freeze, chosen by the caller; ``reviews`` are those of the lexicon if not given. These are lists for evaluation, one file each.
    """
    reviews = lexicon.curated if reviews is None else reviews
    own = lexicon.words.join(targets.select(F.col("target_id").alias("id")), "id", "left_semi")
    key = kept(A.answer_key(own, reviews), "key")
    sealed = own.select(F.col("id").alias("targetId"), F.col("canonical").alias("spelling"), F.size("chars").alias("charCount"), "numeric_id").orderBy("numeric_id").drop("numeric_id")
    told = clean_text(F.col("explanation")) if "explanation" in own.columns else F.lit("")
    items = own.select(F.col("id").alias("target_id"), "numeric_id", "pos", sampling.length_bucket(F.size("chars")).alias("length"))
    ranked = sampling.shuffled_order(items, ["pos", "length"], seed=seed)
    from lexiloom.operators.ranking import positions

    placed = kept(positions(ranked, [F.col("frac"), F.col("tie"), F.col("target_id")], name="place"), "placed")
    sinks.write_frozen(sealed, f"{folder}/targets.jsonl")
    sinks.write_frozen(own.select("id", "canonical", "numeric_id", told.alias("explanation")).join(key.select(F.col("target_id").alias("id"), "pos", "answers"), "id").orderBy("numeric_id").select(F.col("id").alias("targetId"), F.col("canonical").alias("spelling"), "pos", "answers", "explanation"), f"{folder}/answers.jsonl")
    sinks.write_frozen(A.alias_log(key).select(F.col("target_id").alias("targetId"), "source", F.col("base_forms").alias("base"), "answers", "added", "note"), f"{folder}/answer-aliases.jsonl")
    sets = []
    total = own.count()
    by_id = sealed.withColumnRenamed("targetId", "target_id")
    for label, size in [*[(str(n), n) for n in sizes], ("all", total)]:
        members = placed.where(F.col("place") <= size).join(by_id, "target_id").orderBy("place").select(F.col("target_id").alias("targetId"), "spelling", "charCount")
        sinks.write_frozen(members, f"{folder}/set-{label}.jsonl")
        sets.append({"label": label, "count": min(size, total)})
    stats = A.alias_stats(key).first().asDict()
    manifest = {"sourceFile": source, "sha256": sinks.file_sha256(source), "kitVersion": __version__, "generatedAt": made_at, "counts": {"entries": lexicon.entries.count(), "targets": total}, "sets": sets, "setSeed": seed, "aliases": stats}
    sinks.write_json(manifest, f"{folder}/manifest.json")
    return manifest


def contract_text(manifest: dict, rules: list[dict]) -> str:
    """The manifest and the rules of scoring (title, rule, why) as Markdown."""
    lines = ["# Contract", "", f"Source `{manifest['sourceFile']}`, sha256 `{manifest['sha256']}`.", "", f"{manifest['counts']['targets']} of {manifest['counts']['entries']} entries are targets.", "", "## Sets", "", "| set | targets | 95 % interval |", "| --- | --- | --- |"]
    lines += [f"| {s['label']} | {s['count']} | " + ("census" if s["label"] == "all" else f"± {98 / max(1, s['count']) ** 0.5:.1f} %") + " |" for s in manifest["sets"]]
    lines += ["", "## Comparing answers", ""] + [f"{i}. **{r['title']}** {r['rule']} {r['why']}" for i, r in enumerate(rules, 1)]
    return "\n".join(lines) + "\n"


SCORING_RULES = [
    {"title": "Case.", "rule": "Values are compared in lower case.", "why": "Capitals carry no meaning here."},
    {"title": "Marks.", "rule": "Apostrophes go; other characters than a-z, 0-9, space and hyphen become spaces.", "why": "Marks are noise around an answer."},
    {"title": "Spaces.", "rule": "Runs of white space are one space.", "why": "Spacing carries no meaning."},
    {"title": "Verbs.", "rule": "For actions and verbs both sides begin with 'to '.", "why": "The list names them in the infinitive."},
]
