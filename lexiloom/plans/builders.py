"""Reference tables out of a caller's lists: modifiers with their glosses, indicators checked against the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators.lexicon import Lexicon
from lexiloom.operators.modifiers import checked, reference_glosses
from lexiloom.sources.snapshot import checked_indicators


def modifier_reference(source: dict, lexicon: Lexicon) -> dict:
    """A modifier reference: ``source`` has entries (spelling or codes, category, tier, gloss and asPrefix), conditionalExceptions and knownGaps.

    A gloss that the source doesn't give is that of the lexicon: of the code's own entry, else of the first entry of the spelling or base. Categories and tiers come in the
    order of their first entry. Repeated sequences and entries without code are errors.
    """
    listed = source.get("entries", [])
    glosses = {r.spelling: r.gloss for r in reference_glosses([{k: v for k, v in m.items() if k != "gloss" or v is not None} for m in listed], lexicon).collect()}  # one row for each entry
    by_spelling = {m["spelling"]: m for m in checked(listed)}
    order = [m.get("spelling") or "/".join(m["codes"]) for m in listed]
    entries = [{k: by_spelling[s][k] for k in ("spelling", "codes", "category", "tier")} | {"gloss": glosses[s], "asPrefix": by_spelling[s]["asPrefix"]} for s in order]
    tiers: dict[str, list[str]] = {}
    for e in entries:
        tiers.setdefault(e["tier"], []).append(e["spelling"])
    return {"tiers": tiers, "conditionalExceptions": source.get("conditionalExceptions", []), "categories": list(dict.fromkeys(e["category"] for e in entries)), "knownGaps": source.get("knownGaps", []), "count": len(entries), "entries": entries}


def indicator_reference(source: dict, lexicon: Lexicon) -> tuple[dict, list[str]]:
    """An indicator reference of the source's entries and groups, and what the lexicon says otherwise: codes that it lacks, doesn't flag as marks, or doesn't prefer.

    The source holds in any case. Repeated codes and unknown groups are errors.
    """
    found = checked_indicators(source["entries"], source["groups"])
    spark = lexicon.spark
    asked = spark.createDataFrame([(i, e["code"], e.get("name", "")) for i, e in enumerate(source["entries"])], "no int, id string, name string")
    known = lexicon.entries.select("id", "is_indicator", "is_non_preferred").groupBy("id").agg(F.bool_or("is_indicator").alias("flagged"), F.bool_or("is_non_preferred").alias("rejected"))
    said = F.when(F.col("flagged").isNull(), F.array(F.lit("isn't in the lexicon"))).otherwise(F.array_compact(F.array(F.when(~F.col("flagged"), F.lit("isn't flagged as a mark")), F.when(F.col("rejected"), F.lit("isn't preferred")))))
    rows = asked.join(known, "id", "left").select("no", F.explode(F.transform(said, lambda x: F.concat("id", F.lit(" ("), "name", F.lit(") "), x))).alias("w")).orderBy("no", "w").collect()  # at most two for each entry
    return found, [r.w for r in rows]
