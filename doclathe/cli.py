"""infer, generate, validate and mutate from the command line: python -m doclathe.cli VERB ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions.scalar import Registry
from doclathe.operators import documents as D
from doclathe.operators.profile import KeyConfig
from doclathe.plans import api
from doclathe.sources import readers as R
from doclathe.sources import writers as W
from doclathe.sources.errors import EngineError
from doclathe.streaming import live


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="doclathe")
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="verb", required=True)
    i = sub.add_parser("infer")
    i.add_argument("--input", required=True)
    i.add_argument("--format", default="parquet")
    i.add_argument("--strategy", default="firstN", choices=list(R.STRATEGIES))
    i.add_argument("--sample", type=int)
    i.add_argument("--key", default="_id")
    i.add_argument("--schema", default="schema.json")
    i.add_argument("--constraints", default="constraints.json")
    i.add_argument("--config")
    i.add_argument("--key-threshold", type=int)
    i.add_argument("--no-dynamic-keys", action="store_true")
    i.add_argument("--force-static", action="append", default=[])
    i.add_argument("--force-dynamic", action="append", default=[])
    i.add_argument("--min-pattern-match", type=float)
    i.add_argument("--confidence", type=float)
    i.add_argument("--seed", default="42")
    i.add_argument("--time-field")
    i.add_argument("--start")
    i.add_argument("--end")
    i.add_argument("--key-field", action="append", default=[])
    i.add_argument("--required-threshold", type=float, default=0.95)
    i.add_argument("--optional", action="store_true", help="require only keys")
    i.add_argument("--array-policy", default="minmax", choices=["minmax", "percentileClamp"])
    i.add_argument("--percentiles", type=float, nargs=2, default=(1, 99))
    g = sub.add_parser("generate")
    g.add_argument("--schema", required=True)
    g.add_argument("--count", type=int, default=100)
    g.add_argument("--seed", default="42")
    g.add_argument("--output", required=True)
    g.add_argument("--format", default="ndjson", choices=["ndjson", "json", "parquet"])
    g.add_argument("--generators")
    g.add_argument("--split", type=int)
    g.add_argument("--cdc", metavar="RATIOS", help="a change log, for example insert:50,update:40,delete:10")
    g.add_argument("--warm-up", type=int, default=0)
    g.add_argument("--update-mode", default="mixed")
    g.add_argument("--on-delete", default="remove", choices=["remove", "keep", "tombstone"])
    g.add_argument("--cache-size", type=int, default=100_000)
    g.add_argument("--manifest")
    v = sub.add_parser("validate")
    for a in ("--sample", "--generated", "--schema"):
        v.add_argument(a, required=True)
    v.add_argument("--report", default="report.json")
    v.add_argument("--key-field", action="append", default=[])
    v.add_argument("--tolerance", type=float, nargs=2, default=(0.1, 0.2))
    m = sub.add_parser("mutate")
    for a in ("--target", "--key", "--output"):
        m.add_argument(a, required=True)
    m.add_argument("--log", help="apply this log; without it one of updates and deletes is made")
    m.add_argument("--ratios", default="update:80,delete:20")
    m.add_argument("--count", type=int, default=1000)
    m.add_argument("--cache-size", type=int, default=100_000)
    m.add_argument("--seed", default="42")
    return p


def number(seed: str) -> int | str:
    return int(seed) if seed.isdigit() else seed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level, stream=sys.stderr)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.verb == "infer":
            conf = R.load_config(a.config) if a.config else {}
            df = R.bind(spark, a.input, a.format)
            if a.sample and a.strategy == "timeWindowed":
                df = R.time_window(df, a.sample, a.key, a.time_field, a.start, a.end, number(a.seed))
            elif a.sample:
                df = R.random_sample(df, a.sample, a.key, number(a.seed)) if a.strategy == "random" else R.first_n(df, a.sample, a.key)
            told = {"threshold": a.key_threshold, "min_pattern_match": a.min_pattern_match, "confidence_threshold": a.confidence, "force_static": tuple(a.force_static) or None, "force_dynamic": tuple(a.force_dynamic) or None}
            keys = KeyConfig.disabled() if a.no_dynamic_keys else KeyConfig.merged({}, conf.get("dynamicKeys", {}), told)
            made = D.SynthesisConfig(a.required_threshold, not a.optional, tuple(a.key_field), a.array_policy, tuple(a.percentiles))
            schema, facts = api.infer(df, made, keys)
            R.save_schema(schema, a.schema)
            W.write_artifact(a.constraints, facts)
            print(json.dumps({"status": "ok", "fields": len(facts)}))
        elif a.verb == "generate":
            registry, schema = Registry.load(a.generators) if a.generators else Registry(), R.load_schema(a.schema)
            if a.cdc:
                gen = D.Generator(schema, number(a.seed), registry)
                df = live.change_log(spark, a.count, D.parse_ratios(a.cdc), None, gen, a.update_mode, number(a.seed), None, a.on_delete, a.cache_size, a.warm_up)
            else:
                df = api.generate(spark, schema, a.count, number(a.seed), registry)
            {"ndjson": lambda: W.write_ndjson(df, a.output, a.split), "json": lambda: W.write_json_array(df, a.output), "parquet": lambda: df.write.mode("overwrite").parquet(a.output)}[a.format]()
            if a.manifest:
                m = W.Manifest(seed=a.seed, config=vars(a))
                m.artifact("output", a.output)
                m.metric(documents=a.count)
                m.save(a.manifest)
            print(json.dumps({"status": "ok", "count": a.count}))
        elif a.verb == "validate":
            report = api.validate(R.read_documents(spark, a.sample), R.read_documents(spark, a.generated), R.load_schema(a.schema), tuple(a.key_field), tuple(a.tolerance))
            W.write_artifact(a.report, report)
            print(json.dumps({"status": "ok", "passed": report["passed"]}))
            return 0 if report["passed"] else 1
        else:
            target = R.bind(spark, a.target)
            cols = [c for c in target.columns if c != a.key]
            if a.log:
                log = R.bind(spark, a.log)
            else:
                known = R.ids(target, a.key, a.cache_size)
                made = live.change_log(spark, a.count, D.parse_ratios(a.ratios), known, seed=number(a.seed), cache_size=a.cache_size)
                gen = D.Generator({"properties": {c: {"type": next((k for k, t in (("integer", T.IntegralType), ("number", T.NumericType), ("boolean", T.BooleanType)) if isinstance(target.schema[c].dataType, t)), "string")} for c in cols}}, number(a.seed))
                values = [F.when(F.col("op") != "delete", gen._value(p, c, F.col("seq")).cast(target.schema[c].dataType)).alias(c) for c, p in gen.schema["properties"].items()]
                log = made.select("seq", "op", F.col("key").cast(target.schema[a.key].dataType).alias(a.key), *values)
            out, counts = api.mutate(target, log, a.key, cols)
            out.write.mode("overwrite").parquet(a.output)
            print(json.dumps({"status": "ok"} | counts.first().asDict()))
        return 0
    except EngineError as e:
        print(json.dumps(e.response(a.verb)))
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
