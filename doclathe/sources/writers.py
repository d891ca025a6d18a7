"""Sinks, artifacts, run manifests."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(df: DataFrame):
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def write_ndjson(df: DataFrame, path: str, max_records: int | None = None, mode: str = "overwrite") -> None:
    """One compact object a line, nulls kept. max_records splits files."""
    w = df.select(_plain(df).alias("value")).write.mode(mode)
    (w.option("maxRecordsPerFile", max_records) if max_records else w).text(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One file that holds an array; rows stream through the driver, a partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w") as f:
        f.write("[\n")
        for r in df.select(_plain(df).alias("j")).toLocalIterator():
            f.write((",\n" if n else "") + "  " + r["j"])
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def print_ndjson(df: DataFrame) -> None:
    for r in df.select(_plain(df).alias("j")).toLocalIterator():
        print(r["j"])


def jsonable(x: Any) -> Any:
    """Sets as sorted lists, so that nothing is lost in an artifact."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(jsonable(v) for v in x)
    return [jsonable(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_artifact(path: str, data: Any) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(jsonable(data), f, indent=2, default=str)


def append(df: DataFrame, target: str, suffix: str = "", fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(target + suffix)


def content_hash(df: DataFrame) -> str:
    """Of the rows, whatever their order or files: the sum of row hashes, taken on the executors."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]).cast("decimal(38,0)")
    r = df.agg(F.count("*"), F.sum(h)).first()
    return hashlib.sha256(f"{r[0]}:{r[1]}".encode()).hexdigest()


class Manifest:
    """What a run read, made and measured."""

    def __init__(self, tool: str = "doclathe", version: str = "0.1", seed: Any = None, config: dict | None = None):
        self.data = {"tool": {"name": tool, "version": version}, "run": {"id": str(uuid.uuid4()), "seed": seed, "startedAt": time.time()}, "config": config or {}, "artifacts": {}, "metrics": {}}

    def artifact(self, name: str, path: str) -> None:
        h, n = hashlib.sha256(), 0
        for p in [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith((".", "_"))):
            with open(p, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
                    n += len(block)
        self.data["artifacts"][name] = {"path": path, "sha256": h.hexdigest(), "bytes": n}

    def metric(self, **values: Any) -> None:
        self.data["metrics"] |= values

    def save(self, path: str) -> None:
        self.data["run"]["finishedAt"] = time.time()
        write_artifact(path, self.data)
