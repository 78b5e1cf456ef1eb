"""Writers: lines of JSON, the scored rows with their summary, manifests, run records."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KIND = "lexiloom-run-record/1"


def guarded(path: str, frozen: str) -> Path:
    """``path``, unless it lies in the folder of frozen data."""
    out, data = Path(path).resolve(), Path(frozen).resolve()
    if out == data or data in out.parents:
        raise ValueError(f"{path} lies in the frozen folder {frozen}")
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """A directory of JSON lines, written by all executors."""
    df.write.mode("errorifexists").json(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """One file of JSON lines in ``df``'s order, for lists of targets; rows pass the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
            f.write(row.j + "\n")


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def file_sha256(path: str) -> str:
    """The digest of a file's bytes."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def files_sha256(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file of a folder, read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def run_record(ran_at: str, runner: str, prompt_version: str, set_name: str, count: int, snapshot: dict, model: str | None = None, method: list[dict] | None = None, interactions: str | None = None) -> dict:
    """What a run was: the same arguments always give the same record. ``method`` has path and text of each file that made the run."""
    files = [{"path": m["path"], "bytes": len(m["text"].encode()), "sha256": hashlib.sha256(m["text"].encode()).hexdigest(), "source": m["text"]} for m in method or []]
    return {"kind": RUN_KIND, "ranAt": ran_at, "runner": runner, "promptVersion": prompt_version, "set": {"name": set_name, "count": count}, "snapshot": snapshot, "model": model, "method": files, "interactions": interactions}


def run_name(name: str, ran_at: str) -> str:
    """``name`` with the time of the run, without the marks that file names can't have everywhere."""
    day, _, time = ran_at.partition("T")
    head, _, rest = time.partition(".")
    return f"{name}.{day}T{head.replace(':', '')}{rest}"


def record_run(folder: str, name: str, files: list[str], interactions: list[dict], **what) -> dict:
    """Writes ``<name>.<time>.run.json`` and, if there are any, ``.interactions.jsonl`` with target, prompt, response and guesses; returns the record."""
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    base = Path(folder, run_name(name, now))
    lines = [{k: i[k] for k in ("targetId", "prompt", "rawResponseText", "candidates") if k in i} for i in interactions]
    record = run_record(now, method=[{"path": p, "text": Path(p).read_text(encoding="utf-8")} for p in files], interactions=f"{base.name}.interactions.jsonl" if lines else None, **what)
    base.parent.mkdir(parents=True, exist_ok=True)
    write_json(record, f"{base}.run.json")
    if lines:
        Path(f"{base}.interactions.jsonl").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines), encoding="utf-8")
    return record
