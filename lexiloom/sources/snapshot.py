"""Readers of the kit's files: dictionary snapshots, lines of JSON, named sets, reference tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.lexicon import Lexicon, normalized
from lexiloom.operators.modifiers import checked

ENTRY = """id bigint, gloss string, filename string, isChar boolean, pos string, code string, bciAvId string, explanation string,
derivationParts array<struct<id:string,code:string,gloss:string,bciAvId:string>>, isWord boolean, isIndicator boolean, isNonPreferred boolean, isDualForm boolean, isPrimitive boolean"""
LABEL = re.compile(r"[A-Za-z0-9._-]+")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The raw entries of a snapshot, an array or an object with an array ``data``, with ``ordinal``, their place in it.

    One JSON document is one task to read; a snapshot of any size can be given as lines of JSON instead (``read_lines``).
    """
    whole = spark.read.text(path, wholetext=True)
    kinds = whole.select(F.schema_of_variant(F.try_parse_json("value")).alias("k")).first()
    if kinds is None or kinds.k is None:
        raise ValueError(f"{path}: no JSON document")
    if kinds.k.startswith("ARRAY"):
        rows = whole.select(F.from_json("value", f"array<struct<{_struct(ENTRY)}>>", {"mode": "FAILFAST"}).alias("data"))
    elif kinds.k.startswith("OBJECT") and re.search(r"[<, ]data: ?ARRAY", kinds.k):
        rows = whole.select(F.from_json("value", f"struct<data:array<struct<{_struct(ENTRY)}>>>", {"mode": "FAILFAST"})["data"].alias("data"))
    else:
        raise ValueError(f"{path}: neither an array nor an object with an array data")
    return rows.select(F.posexplode("data").alias("ordinal", "e")).select("ordinal", "e.*")


def _struct(ddl: str) -> str:
    return ", ".join(re.sub(r"^(\w+) ", r"\1:", part.strip()) for part in re.split(r",\s*(?![^<]*>)", ddl))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, and its place: splits of a file and lines of a split come in order."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))


def _parsed(lines: DataFrame, schema: str, where: Column) -> DataFrame:
    """``_row`` of each line that isn't blank; a line that is no JSON object is an error that names ``where``."""
    text = F.regexp_replace("value", "\r$", "")
    some = lines.where(F.trim(text) != "").withColumn("_row", F.from_json(text, schema)).withColumn("_v", F.try_parse_json(text))
    message = F.concat(F.lit("not a JSON object in "), where, F.lit(": "), F.substring("value", 1, 200))
    return some.withColumn("_row", F.when(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"), F.col("_row")).otherwise(F.raise_error(message)))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file or directory of JSON lines, with ``ord``, the order of the lines. Blank lines are left out; a line that is no JSON object is an error that names it."""
    return _parsed(_lines(spark, path), schema, F.col("_f")).select(F.struct("_f", "_b", "_m").alias("ord"), "_row.*")


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same with ``ord`` as the number of the line, from 1 over all files; errors name it."""
    from lexiloom.operators.ranking import positions

    lines = positions(_lines(spark, path), [F.col("_f"), F.col("_b"), F.col("_m")], name="ord")
    return _parsed(lines, schema, F.concat(F.lit("line "), F.col("ord").cast("string"), F.lit(" of "), F.col("_f"))).select("ord", "_row.*")


SUBMISSION = "targetId string, candidates string, runner string, promptVersion string, rawResponseText string"
TARGET = "targetId string, spelling string, charCount int"
ANSWER = "targetId string, spelling string, pos string, answers array<string>, explanation string"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submitted rows; ``candidates`` is text: a list as JSON, a text as it is."""
    return read_numbered(spark, path, SUBMISSION)


def set_path(directory: str, label: str) -> str:
    """The file of a named set. Labels with other characters than letters, digits, ``.``, ``_`` and ``-`` are refused, so none leaves the folder."""
    if not LABEL.fullmatch(label) or label in (".", ".."):
        raise ValueError(f"no name of a set: {label!r}")
    return f"{directory}/set-{label}.jsonl"


def read_set(spark: SparkSession, directory: str, label: str) -> DataFrame:
    return read_numbered(spark, set_path(directory, label), TARGET)


def set_labels(data: str) -> list[str]:
    """The names of the sets: those of the manifest, else of the files."""
    manifest = Path(data, "manifest.json")
    if manifest.exists() and (sets := json.loads(manifest.read_text()).get("sets")):
        return [str(s.get("label", s.get("size", s))) if isinstance(s, dict) else str(s) for s in (sets if isinstance(sets, list) else sets.get("subsets", sets.keys() if hasattr(sets, "keys") else []))]
    return sorted(p.stem.removeprefix("set-") for p in Path(data, "sets").glob("set-*.jsonl"))


@dataclass
class Kit:
    """A snapshot with its reference tables."""

    lexicon: Lexicon
    modifiers: dict
    indicators: dict
    source: str
    extra: dict = field(default_factory=dict)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """``target_id, reviewed, note`` of a file of reviewed answers: a JSON object with answers and note by target."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(k, v.get("answers") or [], v.get("note")) for k, v in found.items()], "target_id string, reviewed array<string>, note string")


def load_kit(spark: SparkSession, source: str, modifiers: str, indicators: str, reviews: str | None = None) -> Kit:
    """The lexicon of its files: snapshot, modifier reference and indicator reference (JSON objects with ``entries``), and reviewed answers if there are any."""
    m, i = (json.loads(Path(p).read_text()) for p in (modifiers, indicators))
    rows = [(e["code"], e.get("group", ""), e.get("name", ""), e.get("purpose", "")) for e in i.get("entries", [])]
    marks = spark.createDataFrame(rows, "code string, group string, name string, purpose string")
    exceptions = [tuple(x) for x in m.get("conditionalExceptions", [])]
    return Kit(Lexicon(normalized(read_snapshot(spark, source)), marks, checked(m.get("entries", [])), exceptions, read_reviews(spark, reviews) if reviews else None), m, i, source)


def checked_indicators(entries: list[dict], groups: list[str]) -> dict:
    """An indicator reference; repeated codes and unknown groups are errors."""
    seen = set()
    for e in entries:
        if e["code"] in seen:
            raise ValueError(f"{e['code']} is listed twice")
        if e.get("group") not in groups:
            raise ValueError(f"{e['code']} has the unknown group {e.get('group')!r}")
        seen.add(e["code"])
    return {"count": len(entries), "groups": groups, "entries": entries}
