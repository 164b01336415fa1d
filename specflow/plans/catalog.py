"""Runs and their steps: directories with metadata, and manifests that are compared by content.

``step`` keeps tables: a step is a name, what it was asked for and the content of its inputs; its rows are committed to a shared file system
in one move under the digest of these. What is there is read, not made again; of two sessions that make the same step, the first to
move wins, and the other reads its rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import moved, on_disk


def sha256(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def create_run(root: str, name: str | None = None) -> Path:
    at = Path(root) / (name or datetime.now().strftime("%Y%m%d_%H%M%S_%f"))
    at.mkdir(parents=True)
    latest = Path(root) / "latest"
    latest.unlink(missing_ok=True)
    latest.symlink_to(at.name)
    return at


def resolve_run(root: str, name: str = "latest") -> Path:
    at = (Path(root) / name).resolve()
    if not at.is_dir():
        raise FileNotFoundError(f"no such run: {name}")
    return at


def create_step(run: Path, name: str, **about) -> Path:
    at = run / name
    at.mkdir(exist_ok=True)
    (at / "meta.json").write_text(json.dumps({"step": name, "at": datetime.now().isoformat(), **about}, indent=1, default=str))
    return at


def list_steps(run: Path) -> list[dict]:
    return [json.loads(p.read_text()) for p in sorted(run.glob("*/meta.json"))]


def list_runs(root: str) -> list[str]:
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and not p.is_symlink())


def manifest(run: Path) -> dict[str, str]:
    return {str(p.relative_to(run)): sha256(p) for p in sorted(run.rglob("*")) if p.is_file()}


def manifest_diff(a: dict[str, str], b: dict[str, str]) -> dict[str, str]:
    return {k: "added" if k not in a else "removed" if k not in b else "changed" for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def digest(rows: DataFrame) -> str:
    """Of a table's columns and rows, in any order, repeated rows counted: sums of two hashes of each row, in one pass."""
    kinds = [f"{c} {k}" for c, k in rows.dtypes]
    plain = [F.to_json(f"`{c}`") if k.startswith("map") else F.col(f"`{c}`") for c, k in rows.dtypes] or [F.lit(0)]
    h = F.xxhash64(*plain)
    sums = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(h, F.hash(*plain)).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(json.dumps([kinds, sums["n"], str(sums["a"]), str(sums["b"])]).encode()).hexdigest()


def step(spark: SparkSession, root: str, name: str, inputs: dict[str, DataFrame], build: Callable[..., DataFrame], **about) -> DataFrame:
    """The rows of ``build(**inputs)``, made unless a step of this name, these options and inputs of this content is committed below
    ``root``, a folder that all machines reach."""
    known = {"step": name, "about": about, "inputs": {k: digest(v) for k, v in sorted(inputs.items())}}
    at = f"{root.rstrip('/')}/{name}/{hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()}"
    files, path = on_disk(spark, at)
    if not files.exists(path):
        made = f"{root.rstrip('/')}/{name}/_making-{uuid.uuid4().hex}"
        build(**inputs).write.parquet(made)
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{made}/_step.json"), False)
        out.write(bytearray(json.dumps({**known, "at": datetime.now().isoformat()}, indent=1, default=str).encode()))
        out.close()
        moved(spark, made, at)
    return spark.read.parquet(at)


def steps(spark: SparkSession, root: str) -> list[dict]:
    """What is committed below ``root``, by name and time."""
    files, path = on_disk(spark, root)
    found = []
    for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}/*/[!_]*/_step.json")) or []:
        stream = files.open(f.getPath())
        found.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    return sorted(found, key=lambda x: (x["step"], x["at"]))
