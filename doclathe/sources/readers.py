"""Bindings to tables and files, and sampling."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import ConfigError, FileIOError, SamplingError


def sanitize_uri(uri: str) -> str:
    """A URI for logs, its credentials hidden."""
    return re.sub(r"://[^@/]*@", "://***:***@", uri)


def bind(spark: SparkSession, where: str, fmt: str = "parquet", **options: Any) -> DataFrame:
    """A table of the catalog, or files of any format that Spark reads."""
    return spark.table(where) if fmt == "table" else spark.read.format(fmt).options(**options).load(where)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One `doc` (variant) per non-blank line; a malformed line is an error."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("doc"), F.col("value").alias("json"))


def read_documents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """NDJSON as typed columns."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def load_json(path: str, what: str = "file") -> Any:
    try:
        with open(path) as f:
            return json.load(f)
    except OSError as e:
        raise FileIOError(f"{what} can't be read: {path}") from e
    except ValueError as e:
        raise FileIOError(f"{what} is not JSON: {path}") from e


def load_config(path: str) -> dict[str, Any]:
    """JSON, or YAML where a YAML library is installed, by extension."""
    if not path.endswith((".yaml", ".yml")):
        return load_json(path, "configuration")
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML needs a YAML library; use JSON") from e
    with open(path) as f:
        return yaml.safe_load(f) or {}


def require(config: dict[str, Any], section: str, fields: list[str]) -> None:
    missing = [f for f in fields if config.get(f) in (None, "")]
    if missing:
        raise ConfigError(f"{section}: missing {', '.join(missing)}")


# --- sampling ----------------------------------------------------------------------------------------------------------


def random_sample(df: DataFrame, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by hash: every task keeps its own least n, so only n rows of each are merged."""
    return df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def time_window(df: DataFrame, n: int, key: str, field: str | None, start=None, end=None, seed: int | str = 42) -> DataFrame:
    """Rows with start <= field <= end, then a random sample."""
    if field is None or start is None or end is None:
        raise SamplingError("a time window needs field, start and end")
    return random_sample(df.where(F.col(field).between(start, end)), n, key, seed)


STRATEGIES = {"random": random_sample, "firstN": first_n, "timeWindowed": time_window}


def strategy(name: str):
    if name not in STRATEGIES:
        raise SamplingError(f"unknown sampling strategy: {name}")
    return STRATEGIES[name]


def with_metadata(sample: DataFrame, name: str, order: str) -> DataFrame:
    """A struct __metadata (collection, sampledAt, sampleIndex) on a sample, which is bounded by its size."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    return sample.withColumn("__metadata", F.struct(F.lit(name).alias("collection"), F.current_timestamp().alias("sampledAt"), at.alias("sampleIndex")))


def ids(df: DataFrame, key: str, n: int) -> DataFrame:
    out = df.select(key).orderBy(key).limit(n)
    if out.isEmpty():
        raise SamplingError("the source has no ids")
    return out


# --- saved statistics --------------------------------------------------------------------------------------------------


def load_schema(path: str) -> dict[str, Any]:
    return load_json(path, "generation schema")


def save_schema(schema: dict[str, Any], path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(schema, f, indent=2)


def is_legacy(stats: dict[str, Any]) -> bool:
    """Statistics that list every observed length."""
    return "observedLengths" in stats and "distribution" not in stats


def upgrade(stats: dict[str, Any]) -> dict[str, Any]:
    """Legacy array statistics with the lengths as a frequency map."""
    if not is_legacy(stats):
        return stats
    out: dict[str, int] = {}
    for n in stats["observedLengths"]:
        out[str(n)] = out.get(str(n), 0) + 1
    return {k: v for k, v in stats.items() if k != "observedLengths"} | {"distribution": out}


def load_constraints(spark: SparkSession, path: str) -> DataFrame:
    """path, value, n: the array-length frequency tables of a saved profile, as inference writes it (facts by path) or as a list `arrayStats`."""
    saved = load_json(path, "constraints")
    stats = [upgrade(s) for s in saved.get("arrayStats", [])] or [upgrade(f["array"]) | {"fieldPath": p} for p, f in saved.items() if isinstance(f, dict) and "array" in f]
    rows = [(s["fieldPath"], float(v), int(n)) for s in stats for v, n in s["distribution"].items()]
    return spark.createDataFrame(rows, "path string, value double, n bigint")
