"""The whole workflows: infer, generate, validate, mutate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions import scalar as S
from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.operators import state as St
from doclathe.sources.errors import InferenceError


#: A schema has no more fields of objects than this: they are the driver's.
MOST_FIELDS = 100_000


def facts(df: DataFrame) -> dict[str, dict[str, Any]]:
    """What synthesis needs of each path, from the table's profile state; a row per path (and per distinct length or enum value) comes back."""
    state = St.state_of(df).persist()  # counts, not documents
    try:
        if not St.documents(state):
            raise InferenceError("no documents to infer from")
        return St.facts(state)
    finally:
        state.unpersist()


def dynamic_objects(df: DataFrame, keys: P.KeyConfig | None = None) -> tuple[DataFrame, dict[str, dict[str, Any]]]:
    """(df with objects of made-up keys as maps and all others as structs, per such path its key metadata). What a path is, is decided from the top down."""
    config = keys or P.KeyConfig()
    told = P.object_keys(df, config)
    if told is None:
        return P.reshape(df, set(), {}), {}
    rows, found = P.collapse(told, config)
    dynamic = {path: {"pattern": pattern or "CUSTOM"} for path, pattern in found}
    if dynamic:
        for r in P.dynamic_stats(rows.where(F.col("parent").isin(list(dynamic))), config).collect():
            more = {"confidence": r["confidence"], "confidenceLevel": r["level"], "documentsAnalyzed": r["n_docs"], "uniqueKeysObserved": r["n_keys"], "exampleKeys": r["examples"]}
            dynamic[r["path"]] |= more
            if r["pattern"] in config.patterns and r["pattern"] not in S.KEY_PATTERNS:  # a pattern of one's own
                dynamic[r["path"]]["customPattern"] = config.patterns[r["pattern"]]
    # Keys of maps that aren't dynamic, as many as a static schema has fields.
    maps = {p for p, t in P.field_paths(df.schema) if t == "map"} - set(dynamic)
    names: dict[str, list[str]] = {}
    if maps:
        fields = rows.where(~F.col("parent").isin(list(dynamic) or [""])).select("parent", "key").distinct().limit(MOST_FIELDS + 1).collect()
        if len(fields) > MOST_FIELDS:
            raise InferenceError(f"over {MOST_FIELDS} fields of objects that aren't dynamic; enable dynamic keys, or force their paths")
        for r in sorted(fields):
            names.setdefault(r["parent"], []).append(r["key"])
    return P.reshape(df, set(dynamic), names), dynamic


def infer(df: DataFrame, config: D.SynthesisConfig | None = None, keys: P.KeyConfig | None = None) -> tuple[dict[str, Any], dict[str, dict[str, Any]]]:
    """(generation schema, facts per path) of a table of documents. Objects of made-up keys, as maps or as structs wide with keys, become dynamic; statistics of what is
    below them are those of all their values together."""
    plain, hints = D.normalize(df)
    shaped, dynamic = dynamic_objects(plain, keys)
    f = facts(shaped)
    for path, (fmt, _) in hints.items():
        f.setdefault(path, {}).setdefault("format", fmt)
        f[path]["source"] = D.SOURCE_TYPES[fmt]
    if dynamic:
        for path, d in dynamic.items():
            if counts := f.get(path, {}).get("size", {}).get("distribution"):
                d["distribution"] = counts
        f |= {path: f.get(path, {}) | {"dynamic": d} for path, d in dynamic.items()}
    return D.synthesize(shaped.schema, f, config, dynamic), f


def infer_state(state: DataFrame, schema: T.StructType, config: D.SynthesisConfig | None = None, keys: P.KeyConfig | None = None) -> tuple[dict[str, Any], dict[str, dict[str, Any]]]:
    """The same from a profile state, of a stream for one, of documents of a schema (normalised). Structs are static and maps dynamic, unless their keys are found to be fixed: these are then properties
    of the map's one value schema."""
    f = St.facts(state)
    if not St.documents(state):
        raise InferenceError("no documents to infer from")
    config_ = keys or P.KeyConfig()
    dynamic: dict[str, dict[str, Any]] = {}
    for r in St.keys(state, config_).collect():
        made_up = config_.forced(r["path"]) != "static" and (config_.forced(r["path"]) == "dynamic" or P.promoted(r, config_))
        dynamic[r["path"]] = {
            "pattern": r["pattern"] or "CUSTOM", "confidence": r["confidence"], "confidenceLevel": r["level"], "documentsAnalyzed": r["n_docs"], "uniqueKeysObserved": r["n_keys"], "exampleKeys": r["examples"],
            "distribution": f.get(r["path"], {}).get("size", {}).get("distribution", {}),
        }
        if not made_up and r["n_keys"] < St.KEYS:
            dynamic[r["path"]]["names"] = []
    fixed = [p for p, d in dynamic.items() if "names" in d]
    for r in state.where((F.col("section") == "key") & F.col("path").isin(fixed)).select("path", "item").orderBy("path", "item").collect() if fixed else []:
        dynamic[r["path"]]["names"].append(r["item"])
    return D.synthesize(schema, f, config, dynamic), f | {p: f.get(p, {}) | {"dynamic": d} for p, d in dynamic.items()}


def generate(spark: SparkSession, schema: dict[str, Any], n: int = 100, seed: int | str = 42, registry: S.Registry | None = None) -> DataFrame:
    return D.Generator(schema, seed, registry or S.Registry()).generate(spark, n)


def validate(sample: DataFrame, made: DataFrame, schema: dict[str, Any], key_fields: tuple[str, ...] = (), tolerance: tuple[float, float] = (0.1, 0.2), worst: int = 1000) -> dict[str, Any]:
    """The report: conformance with up to `worst` violations listed (those of the least first key field, or else path, so that no partitioning changes them), array lengths, sizes, uniqueness, and the verdict over all."""
    c = D.conformance(made, schema).first().asDict()
    order = next((k for k in (*key_fields, "_id") if k in made.columns), None)
    broken = made.select(*([F.col(f"`{order}`").alias("__key")] if order else []), F.inline(D.violations(schema, made)))
    listed = broken.orderBy(*broken.columns).limit(worst).select("path", "keyword").collect()
    arrays = [r.asDict() for r in D.compare_arrays(D.array_stats(P.unnest(sample, kinds=("array",))), D.array_stats(P.unnest(made, kinds=("array",))), tolerance[0]).collect()]
    size = [x.select(P.size_proxy(x, "leafFieldCount").alias("size")) for x in (sample, made)]
    sizes = [r.asDict() for r in D.compare_buckets(P.size_buckets(size[0]), P.size_buckets(size[1]), tolerance[1]).collect()]
    fields = [k for k in ("_id", *key_fields) if k.split(".")[0] in made.columns]
    unique = [r.asDict() for r in D.uniqueness(made, fields).collect()] if fields else []
    verdict = c["invalid"] == 0 and all(r["passed"] for r in arrays + sizes) and all(r["duplicates"] == 0 for r in unique)
    return {"schemaConformance": c | {"violations": [tuple(r) for r in listed]}, "arrayLengthComparison": arrays, "documentSizeComparison": sizes, "keyUniqueness": unique, "passed": verdict}


def mutate(target: DataFrame, log: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(target after the log, one row of counts by operation)."""
    ops = log.agg(*[F.count_if(F.col("op") == o).alias(o) for o in ("insert", "update", "delete")], F.count("*").alias("total"))
    return D.apply_log(target, log, key, cols), ops
