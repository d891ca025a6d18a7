"""Normalising, schema synthesis, generation, change logs and validation of documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions import scalar as S
from doclathe.operators import profile as P
from doclathe.operators.rules import Rules, assumed, joined
from doclathe.operators.rules import value_schema as value_json_schema
from doclathe.operators.state import variant_schema

# --- normalising -------------------------------------------------------------------------------------------------------

#: What a hint's format says of the type that a value had before it was made text.
SOURCE_TYPES = {"objectid": "ObjectId", "base64": "Binary", "date-time": "Date", "decimal": "Decimal"}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _plain(col: Column, typ: T.DataType, path: str, hints: dict[str, tuple[str, str]], object_ids: frozenset[str]) -> Column:
    if isinstance(typ, T.BinaryType):
        if path in object_ids:
            hints.setdefault(path, ("objectid", "string"))
            return F.lower(F.hex(col))
        hints.setdefault(path, ("base64", "string"))
        return F.base64(col)
    if isinstance(typ, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        hints.setdefault(path, ("date-time", "string"))
        return F.date_format(col, ISO)
    if isinstance(typ, T.DecimalType):
        hints.setdefault(path, ("decimal", "string"))
        return col.cast("string")
    if isinstance(typ, T.StructType):
        kids = [_plain(col.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name, hints, object_ids).alias(f.name) for f in typ.fields]
        return F.when(col.isNotNull(), F.struct(*kids))
    if isinstance(typ, T.ArrayType):
        return F.transform(col, lambda x: _plain(x, typ.elementType, path + "[]", hints, object_ids))
    if isinstance(typ, T.MapType):
        return F.transform_values(col, lambda _, x: _plain(x, typ.valueType, path + ".*", hints, object_ids))
    return col


def normalize(df: DataFrame, object_ids: tuple[str, ...] = ("_id",)) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """df with dates as ISO text, decimals as text, binary as base64 (or as hexadecimal, for object ids), and
    {path: (format, type)}. Works on streams too; `__metadata` goes."""
    hints: dict[str, tuple[str, str]] = {}
    fields = [f for f in df.schema.fields if f.name != "__metadata"]
    return df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType, f.name, hints, frozenset(object_ids)).alias(f.name) for f in fields]), hints


# --- synthesis ---------------------------------------------------------------------------------------------------------


@dataclass
class SynthesisConfig:
    required_threshold: float = 0.95
    enforce_required: bool = True
    key_fields: tuple[str, ...] = ()
    array_policy: str = "minmax"
    percentiles: tuple[float, float] = (1, 99)


def array_bounds(stats: dict[str, float], policy: str = "minmax", clamp: tuple[float, float] = (1, 99)) -> tuple[int, int]:
    if policy == "minmax":
        return int(stats["min"]), int(stats["max"])
    lo, hi = clamp
    return int(stats["min"] if lo <= 50 else stats["median"]), int(stats["p99"] if hi >= 99 else stats["p90"])


def synthesize(schema: T.StructType, facts: dict[str, dict[str, Any]], config: SynthesisConfig | None = None, dynamic: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """A JSON Schema with `x-gen` hints. facts: per path, of presence, numeric {min,max,is_int}, array {min..p99, distribution}, format,
    enum {values: counts}. dynamic: per path of a map, {pattern, distribution}."""
    config, dynamic = config or SynthesisConfig(), dynamic or {}

    def prop(typ: T.DataType, path: str) -> dict[str, Any]:
        f = facts.get(path, {})
        if isinstance(typ, T.StructType):
            kids = {x.name: prop(x.dataType, f"{path}.{x.name}" if path else x.name) for x in typ.fields}
            need = [x for x in kids if facts.get(f"{path}.{x}" if path else x, {}).get("presence", 1.0) >= config.required_threshold]
            return {"type": "object", "properties": kids, "required": need, "additionalProperties": False}
        if isinstance(typ, T.ArrayType):
            out: dict[str, Any] = {"type": "array", "items": prop(typ.elementType, path + "[]")}
            if "array" in f:
                out["minItems"], out["maxItems"] = array_bounds(f["array"], config.array_policy, config.percentiles)
                out["x-gen"] = {"arrayLen": {k: f["array"][k] for k in ("min", "max", "median", "p90", "p99") if k in f["array"]}}
                if d := f["array"].get("distribution"):
                    out["x-array-length-distribution"] = d
            return out
        if isinstance(typ, T.MapType):
            d = dynamic.get(path, {})
            if "names" in d:  # a map whose keys are fixed
                return {"type": "object", "properties": {k: prop(typ.valueType, path + ".*") for k in d["names"]}, "additionalProperties": False}
            told = {k: v for k, v in d.items() if k not in ("pattern", "distribution")}
            return {"type": "object", "x-dynamic-keys": {"enabled": True, "pattern": d.get("pattern", "CUSTOM"), **told, "countDistribution": d.get("distribution", {"10": 1}), "valueSchema": prop(typ.valueType, path + ".*")}}
        if isinstance(typ, T.VariantType):
            return variant_schema(facts, path, config.required_threshold)
        if isinstance(typ, T.BooleanType):
            return {"type": "boolean"}
        gen: dict[str, Any] = {}
        if isinstance(typ, T.NumericType):
            num = f.get("numeric", {})
            out = {"type": "integer" if num.get("is_int", isinstance(typ, T.IntegralType)) else "number"}
            if num:
                out |= {"minimum": num["min"], "maximum": num["max"]}
                gen["numericRange"] = {"min": num["min"], "max": num["max"]}
        else:
            out = {"type": "string"}
            if fmt := f.get("format"):
                out["format"] = fmt
        if e := f.get("enum"):
            gen["enum"] = e
            out["enum"] = list(e)
        if path in config.key_fields or path == "_id":
            gen["key"] = True
        if source := f.get("source"):
            gen["sourceType"] = source
        if gen:
            out["x-gen"] = gen
        return out

    root = prop(schema, "")
    names = list(root["properties"])
    keep = {"_id", *config.key_fields}
    root["required"] = [n for n in names if n in keep or (config.enforce_required and n in root["required"])]
    return {"$schema": "http://json-schema.org/draft-07/schema#", **root}


# --- generation --------------------------------------------------------------------------------------------------------


@dataclass
class Generator:
    """Compiles a schema once to columns over a row number: a function of seed, row and path only."""

    schema: dict[str, Any]
    seed: int | str = 42
    registry: S.Registry = field(default_factory=S.Registry)
    max_items: int = 10
    max_length: int = 100

    def _value(self, p: dict[str, Any], path: str, row: Column, *more: Column) -> Column:
        typ = p.get("type", "string")
        typ = next((t for t in typ if t != "null"), "string") if isinstance(typ, list) else typ
        seed = S.seed_of(self.seed)
        if own := self.registry.find(path, p.get("x-gen", {}).get("type")):
            return own(seed, row, path, *more)
        if "allOf" in p:
            whole = {k: v for k, v in p.items() if k != "allOf"}
            for x in p["allOf"]:
                whole = whole | x | ({"properties": whole["properties"] | x["properties"]} if "properties" in whole and "properties" in x else {})
            return self._value(whole, path, row, *more)
        if isinstance(p.get("additionalProperties"), dict) and not p.get("properties") and "x-dynamic-keys" not in p and typ == "object":
            p = p | {"x-dynamic-keys": {"pattern": "CUSTOM", "countDistribution": {"3": 1}, "valueSchema": p["additionalProperties"]}}
        if options := p.get("anyOf") or p.get("oneOf"):
            odds = p.get("x-type-probabilities") or [1] * len(options)
            made = [F.to_json(F.struct(self._value(o, path, row, *more).alias("v"))) for o in options]
            u = S.uniform(seed, row, path + "#any", *more)
            run = [sum(odds[: i + 1]) for i in range(len(odds))]
            return reduce(lambda out, i: F.when(u * run[-1] < run[i], made[i]).otherwise(out), reversed(range(len(made) - 1)), made[-1])
        if values := (p.get("x-gen", {}).get("enum") or ({v: 1 for v in p["enum"]} if "enum" in p else None)):
            cast = {"integer": int, "number": float}.get(typ, str)
            return S.ladder([(cast(v), n) for v, n in values.items()], S.uniform(seed, row, path, *more))
        if typ == "boolean":
            return S.uniform(seed, row, path, *more) < 0.5
        if typ == "integer":
            lo, hi = int(p.get("minimum", 0)), int(p.get("maximum", 1000))
            return S.below(hi - lo + 1, seed, row, path, *more) + lo
        if typ == "number":
            lo, hi = float(p.get("minimum", 0)), float(p.get("maximum", 1000))
            return F.least(F.lit(hi), F.round(S.uniform(seed, row, path, *more) * (hi - lo) + lo, 6))
        if typ == "array":
            n = self._length(p, path, row, *more)
            item = p.get("items") or {"type": "string"}
            made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: self._value(item, path + "[]", row, *more, i))
            return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))
        if typ == "object" and (d := expanded(p)) is not None:
            drawn = d.get("countDistribution") or {"10": 1}
            n = S.ladder([(int(k), v) for k, v in sorted(drawn.items(), key=lambda x: int(x[0]))], S.uniform(seed, row, path + "#n", *more))
            make = S.KEYS.get(d.get("pattern", "CUSTOM"), S.KEYS["CUSTOM"])
            span = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
            ks = F.transform(span, lambda i: make(seed, row, path, *more, i))
            vs = F.transform(span, lambda i: self._value(d["valueSchema"], path + ".*", row, *more, i))
            if d.get("customPattern"):
                ks = S.custom_key_list(d["customPattern"], n, seed, row, path, *more)
            return F.map_from_arrays(F.slice(ks, 1, n.cast("int")), F.slice(vs, 1, n.cast("int")))
        if typ == "object":
            kids = [self._value(v, f"{path}.{k}" if path else k, row, *more).alias(k) for k, v in p.get("properties", {}).items()]
            return F.struct(*kids) if kids else F.create_map().cast("map<string,string>")
        if (fmt := p.get("format")) in self.registry.formats:
            return self.registry.formats[fmt](seed, row, path, *more)
        if path == "_id" or path.endswith("._id"):
            return self.registry.formats["objectid"](seed, row, path, *more)
        lo = int(p.get("minLength", 1))
        hi = max(lo, min(int(p.get("maxLength", 24)), max(lo, self.max_length)))
        n = (S.below(hi - lo + 1, seed, row, path + "#n", *more) + lo).cast("int")
        text = F.concat(*[S.digest(seed, row, f"{path}#{i}", *more) for i in range(-(-hi // 32) or 1)])
        return F.substring(text, 1, n)

    def _length(self, p: dict[str, Any], path: str, row: Column, *more: Column) -> Column:
        """By the length distribution, kept within the bounds that validation checks; else even between them."""
        lo, hi = int(p.get("minItems", 0)), int(p.get("maxItems", self.max_items))
        u = S.uniform(S.seed_of(self.seed), row, path + "#n", *more)
        if d := p.get("x-array-length-distribution"):
            drawn = S.ladder([(int(k), v) for k, v in sorted(d.items(), key=lambda x: int(x[0]))], u)
            return F.least(F.greatest(drawn, F.lit(lo)), F.lit(hi))
        return (F.floor(u * (hi - lo + 1)) + lo).cast("int")

    def columns(self, row: Column) -> list[Column]:
        return [self._value(p, k, row).alias(k) for k, p in self.schema.get("properties", {}).items()]

    def generate(self, spark, n: int, partitions: int | None = None) -> DataFrame:
        rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
        return rows.select(*self.columns(F.col("id")))

    def generate_for(self, rows: DataFrame, row: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """A document for each row of a table, made from the number in its column `row`, beside the columns in `keep`: a stand-in for the table in which a row's document is always the same.
        Rows with equal or null numbers get equal documents."""
        return rows.select(*keep, *self.columns(F.coalesce(F.col(row).cast("long"), F.lit(-1))))

    def stream(self, rows: DataFrame, row: str = "value") -> DataFrame:
        """The same over a streaming source of row numbers, such as `rate`."""
        return rows.select(*self.columns(F.col(row)))


def expanded(p: dict[str, Any]) -> dict[str, Any] | None:
    """A dynamic-key annotation with pattern, countDistribution and valueSchema, from any of its layouts: all in one, {enabled, metadata, valueSchema}, or the
    value schema beside it as x-dynamic-key-value-schema. None without one, or if it is disabled."""
    own = p.get("x-dynamic-keys")
    if own is None:
        return None
    meta = own.get("metadata") or own
    if not own.get("enabled", meta.get("enabled", True)):
        return None
    values = own.get("valueSchema") or p.get("x-dynamic-key-value-schema") or {"type": "string"}
    return meta | {"valueSchema": value_json_schema(values)}


def dynamic_annotations(p: Any, path: str = "") -> list[tuple[str, dict[str, Any]]]:
    """(path, annotation) of every enabled dynamic-key object of a schema, wherever schemas nest."""
    out: list[tuple[str, dict[str, Any]]] = []
    if not isinstance(p, dict):
        return out
    if (d := expanded(p)) is not None:
        out += [(path, d), *dynamic_annotations(d["valueSchema"], path + ".*")]
    for k, v in p.get("properties", {}).items():
        out += dynamic_annotations(v, f"{path}.{k}" if path else k)
    out += dynamic_annotations(p.get("items"), path + "[]") + dynamic_annotations(p.get("additionalProperties"), path + ".*")
    for name in ("oneOf", "anyOf", "allOf"):
        for x in p.get(name, []):
            out += dynamic_annotations(x, path)
    return out


def has_dynamic(p: Any) -> int:
    """How many dynamic-key objects a schema holds."""
    if isinstance(p, dict):
        return int("x-dynamic-keys" in p) + sum(has_dynamic(v) for v in p.values())
    return sum(map(has_dynamic, p)) if isinstance(p, list) else 0


def recommended_length(u: Column, lo: int, p50: int, p90: int, p99: int) -> Column:
    """Half of all lengths in min..p50, 40 % in p50..p90, 10 % in p90..p99."""
    span = lambda a, b, x: F.floor(a + x * (b - a + 1)).cast("long")
    return F.when(u < 0.5, span(lo, p50, u / 0.5)).when(u < 0.9, span(p50, p90, (u - 0.5) / 0.4)).otherwise(F.least(F.lit(p99).cast("long"), span(p90, p99, (u - 0.9) / 0.1)))


def weighted_pick(rows: DataFrame, freq: DataFrame, u: str = "u", value: str = "value", n: str = "n") -> DataFrame:
    """rows with a value drawn from a frequency table, null if the table is empty: a range join on its running sums, by the bins of u that a value's range meets.

    A table of up to 4096 values, so of up to 5121 pairs of value and bin, is broadcast; rows of a larger one are shuffled by bin."""
    ranked = P.running(freq.withColumn("__all", F.lit(1)), ["__all"], value, n)
    shares = ranked.select(F.col(value).alias("value"), ((F.col("upto") - F.col(n)) / F.col("total")).alias("__lo"), (F.col("upto") / F.col("total")).alias("__hi"))
    bins = 1024
    s = shares.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") * bins), F.least(F.lit(bins - 1), F.floor(F.col("__hi") * bins)))))
    s = F.broadcast(s) if freq.count() <= 4096 else s
    drawn = (F.floor(F.col(u) * bins) == F.col("__bin")) & (F.col(u) >= F.col("__lo")) & (F.col(u) < F.col("__hi"))
    return rows.join(s, drawn, "left").drop("__bin", "__lo", "__hi")


# --- change logs -------------------------------------------------------------------------------------------------------


def parse_ratios(text: str) -> dict[str, float]:
    """insert:50,update:40,delete:10; what is missing is 0."""
    out = {"insert": 0.0, "update": 0.0, "delete": 0.0}
    for part in text.split(","):
        k, _, v = part.partition(":")
        if k.strip() in out:
            out[k.strip()] = float(v)
    return out


def select_op(u: Column, ratios: dict[str, float], seq: Column | None = None, warm_up: int = 0) -> Column:
    op = S.ladder([(k, v) for k, v in ratios.items() if v > 0], u)
    return op if seq is None or not warm_up else F.when(seq < warm_up, F.lit("insert")).otherwise(op)


def partial_fields(fields: list[str], seed: int | str, row: Column, most: int = 3) -> Column:
    """1 to `most` field names, the first in hash order."""
    ranked = F.array_sort(F.array(*[F.struct(S.digest(seed, row, f).alias("h"), F.lit(f).alias("f")) for f in fields]))
    n = (S.below(min(most, len(fields)), seed, row, "#fields") + 1).cast("int")
    return F.slice(F.transform(ranked, lambda x: x["f"]), 1, n)


MODES = ("regenerate", "partial", "mixed", "increment")


def mutation(gen: Generator, mode: str, row: Column, current: dict[str, Column] | None = None, stamp: Column | None = None) -> Column:
    """map of field to new value (JSON text) of an update: all fields made anew, 1 to 3 of them, either by a coin flip, or, for `increment`, numbers plus
    one; any other mode sets updatedAt. The key is never set."""
    seed = S.seed_of(gen.seed)
    fields = {k: p for k, p in gen.schema.get("properties", {}).items() if k != "_id"}
    js = lambda c: F.to_json(F.struct(c.alias("v")))
    made = {k: js(gen._value(p, k, row)) for k, p in fields.items()}
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in made]), F.array(*made.values()))
    chosen = partial_fields(list(made), seed, row)
    some = F.map_filter(full, lambda k, _: F.array_contains(chosen, k))
    if mode == "regenerate":
        return full
    if mode == "partial":
        return some
    if mode == "mixed":
        return F.when(S.uniform(seed, row, "#coin") < 0.5, full).otherwise(some)
    if mode == "increment" and current:
        numbers = [k for k, p in fields.items() if p.get("type") in ("integer", "number") and k in current]
        if numbers:
            return F.map_from_arrays(F.array(*[F.lit(k) for k in numbers]), F.array(*[js(current[k] + 1) for k in numbers]))
    when = stamp if stamp is not None else F.lit(S.REFERENCE).cast("timestamp")
    return F.create_map(F.lit("updatedAt"), js(F.date_format(when, ISO)))


OPS = ("insert", "update", "delete")


def _set(op: str, present: str | None, c: str) -> Column:
    """Whether an operation sets a column: an insert sets all; an update those that `present` (an array of names) lists or, without it, those that aren't null."""
    told = F.col(c).isNotNull() if present is None else F.coalesce(F.array_contains(present, c), F.col(c).isNotNull())
    return (F.col(op) == "insert") | ((F.col(op) == "update") & told)


def apply_log(target: DataFrame, log: DataFrame, key: str, cols: list[str], seq: str = "seq", op: str = "op", present: str | None = None) -> DataFrame:
    """target after all operations in order. log: key, seq, op and, for an insert, all columns; for an update those that change. present: the name of a column of the log with the
    names of the columns that an update sets, so that null can be set; where it is null or missing, those that aren't null. Operations of any other kind are skipped; updates and deletes of
    keys that aren't there do nothing; an insert of a key that is there replaces its row.

    One aggregation of the log by key: an insert sets every column, so the last operation that set a column is never before the last insert, and after a delete there is no row unless an insert follows."""
    known = log.where(F.col(op).isin(*OPS))
    full = F.when(F.col(op) != "update", F.col(seq))
    folded = known.groupBy(key).agg(F.max_by(op, full).alias("__op"), *[F.max_by(F.struct(F.col(c).alias("v")), F.when(_set(op, present, c), F.col(seq))).alias(f"__{c}") for c in cols])
    j = target.withColumn("__there", F.lit(True)).join(folded, key, "full_outer")
    last = F.col("__op")
    kept = F.coalesce(last == "insert", F.col("__there") & ~F.coalesce(last == "delete", F.lit(False)), F.lit(False))
    return j.where(kept).select(key, *[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)).alias(c) for c in cols])


def log_outcomes(target: DataFrame, log: DataFrame, key: str, cols: list[str], seq: str = "seq", op: str = "op", present: str | None = None) -> DataFrame:
    """key, seq, op, outcome of every operation: inserted, replaced (an insert of a key that was there), modified, matched (an update that changes nothing), deleted, unmatched (an update or delete of
    a key that wasn't there), skipped (of another kind). What was there before an operation follows from the last insert or delete of its key before it, or from the target."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    there = target.select(F.col(key), F.lit(True).alias("__there"), *[F.struct(F.col(c).alias("v")).alias(f"__old_{c}") for c in cols])
    j = log.join(there, key, "left")
    full = F.last(F.when(F.col(op).isin("insert", "delete"), F.col(op) == "insert"), ignorenulls=True).over(before)
    was = F.coalesce(full, "__there", F.lit(False))
    values = [F.coalesce(F.last(F.when(_set(op, present, c), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(before), F.col(f"__old_{c}"))["v"] for c in cols]
    changed = reduce(lambda a, b: a | b, [_set(op, present, c) & ~F.col(c).eqNullSafe(old) for c, old in zip(cols, values, strict=True)], F.lit(False))
    told = j.withColumn("__was", was).withColumn("__changed", changed)
    outcome = (
        F.when(F.coalesce(~F.col(op).isin(*OPS), F.lit(True)), "skipped").when(F.col(op) == "insert", F.when(F.col("__was"), "replaced").otherwise("inserted")).when(~F.col("__was"), "unmatched")
        .when(F.col(op) == "delete", "deleted").when(F.col("__changed"), "modified").otherwise("matched")
    )
    return told.select(key, seq, op, outcome.alias("outcome"))


def insert_rows(target: DataFrame, rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a key is taken by the target or by the first of the rows that bear it."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    marked = ranked.join(target.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    ok = (F.col("__rn") == 1) & F.col("__k").isNull()
    return marked.where(ok).drop("__rn", "__k"), marked.where(~ok).drop("__rn", "__k")


def live_keys(ops: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """key, op: the keys whose last operation isn't a delete."""
    return ops.groupBy(key).agg(F.max_by(op, seq).alias("op")).where("op <> 'delete'")


# --- validation --------------------------------------------------------------------------------------------------------


def violations(schema: dict[str, Any], of: T.StructType | DataFrame | list[str], strict: bool = False) -> Column:
    """array of (path, keyword) for each row, by draft 07; columns that the schema needs and the data lacks are violations of every row.

    of: the table or its schema; of bare column names the types are taken to be those that the schema tells."""
    if isinstance(of, list):
        props = schema.get("properties", {})
        of = T.StructType([T.StructField(c, assumed(props.get(c, {}))) for c in of])
    typ = of.schema if isinstance(of, DataFrame) else of
    row = F.struct(*[F.col(f"`{f.name}`") for f in typ.fields]) if typ.fields else F.struct(F.lit(None).alias("__none"))
    return joined(Rules(strict).of(row, typ, schema, ""))


def violations_of(col: Column, schema: dict[str, Any], typ: T.DataType | None = None, strict: bool = False) -> Column:
    """The same for one column that holds whole documents: a struct, a map, or (by default) a variant."""
    return joined(Rules(strict).of(col, typ or T.VariantType(), schema, ""))


def conformance(df: DataFrame, schema: dict[str, Any], strict: bool = False) -> DataFrame:
    """total, valid, invalid, rate."""
    ok = F.size(violations(schema, df, strict)) == 0
    out = df.select(ok.alias("ok")).agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))
    return out.withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(1.0), 6))


def uniqueness(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, total, unique, duplicates: nulls are left out, values compared as text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    each = df.select(F.inline(parts)).where("v is not null").groupBy("field", "v").agg(F.count("*").alias("c"))
    return each.groupBy("field").agg(F.sum("c").cast("long").alias("total"), F.count("*").alias("unique")).withColumn("duplicates", F.col("total") - F.col("unique"))


def deviation(actual: Column, expected: Column) -> Column:
    return F.when((expected == 0) & (actual == 0), 0.0).when(expected == 0, 1.0).otherwise(F.abs(actual - expected) / expected)


def compare_arrays(sample: DataFrame, made: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Both (path, median, p90, p99) -> path, three deviations, passed. A path that isn't generated fails with 1 each."""
    g = made.select("path", *[F.col(c).alias(f"g_{c}") for c in ("median", "p90", "p99")])
    j = sample.join(g, "path", "left")
    devs = [F.round(F.coalesce(deviation(F.col(f"g_{c}"), F.col(c)), F.lit(1.0)), 6).alias(f"dev_{c}") for c in ("median", "p90", "p99")]
    out = j.select("path", *devs)
    return out.withColumn("passed", (F.col("dev_median") <= tolerance) & (F.col("dev_p90") <= tolerance) & (F.col("dev_p99") <= tolerance))


def compare_buckets(sample: DataFrame, made: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Both (bucket, probability) -> bucket, expected, actual, deviation, passed."""
    j = sample.select("bucket", F.col("probability").alias("expected")).join(made.select("bucket", F.col("probability").alias("actual")), "bucket", "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    return j.withColumn("deviation", F.round(deviation(F.col("actual"), F.col("expected")), 6)).withColumn("passed", F.col("deviation") <= tolerance)


def array_stats(df: DataFrame, by: str = "path", num: str = "num") -> DataFrame:
    rows = df.where("kind = 'array'") if "kind" in df.columns else df
    return P.distribution(P.frequencies(rows.select(by, F.col(num).alias("value")), by, "value"), [by])
