"""Profiling: unnesting to paths, frequency tables, distributions, numeric and array statistics, size proxies,
semantic types and dynamic keys. All scale with the data as DataFrame plans; only results per path reach the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions.scalar import DETECTORS, KEY_PATTERNS, Detector, balanced

RECORD = "array<struct<path:string,kind:string,num:double,str:string>>"
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


# --- unnesting ---------------------------------------------------------------------------------------------------------


def _record(path: str, kind: str, num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("str"))


#: Kinds of records by type; a variant may be of any.
KINDS = ("number", "string", "boolean", "other", "array", "object", "key")


def _records(col: Column, typ: T.DataType, path: str, kinds: frozenset[str] = frozenset(KINDS), objects: bool = False, walked: bool = False) -> Column | None:
    """All records of `kinds` below one value, as one array: leaves by type, arrays by length, then their elements under `path[]`; None if there can be none, so that what
    isn't asked for isn't computed. objects: structs count as objects; walked: variants are left to state.walk()."""
    none = F.array().cast(RECORD)
    below = lambda c, t, p: _records(c, t, p, kinds, objects, walked)
    there = lambda parts: F.when(col.isNull(), none).otherwise(F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else None
    if isinstance(typ, T.StructType):
        fields = [f for f in typ.fields if not f.name.startswith("__")]
        kids = [x for f in fields if (x := below(col.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)) is not None]
        if objects and "object" in kinds and path:
            size = balanced(add, [F.lit(0), *[col.getField(f.name).isNotNull().cast("int") for f in fields]])
            kids.insert(0, F.array(_record(path, "object", size)))
        return there(kids)
    if isinstance(typ, T.ArrayType):
        parts = [F.array(_record(path, "array", F.size(col)))] if "array" in kinds else []
        if below(F.lit(None).cast(typ.elementType), typ.elementType, path + "[]") is not None:
            parts.append(F.flatten(F.transform(col, lambda x: below(x, typ.elementType, path + "[]"))))
        return there(parts)
    if isinstance(typ, T.MapType):
        parts = [F.array(_record(path, "object", F.size(col)))] if "object" in kinds else []
        if "key" in kinds:
            parts.append(F.transform(F.map_keys(col), lambda k: _record(path, "key", text=k)))
        if below(F.lit(None).cast(typ.valueType), typ.valueType, path + ".*") is not None:
            parts.append(F.flatten(F.transform(F.map_values(col), lambda x: below(x, typ.valueType, path + ".*"))))
        return there(parts)
    if isinstance(typ, T.VariantType) and walked:
        return None
    if isinstance(typ, T.NumericType):
        if "number" not in kinds:
            return None
        v = col.cast("double")
        one = _record(path, "number", v)
        return F.when(col.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), none).otherwise(F.array(one))
    if isinstance(typ, T.VariantType):
        raw = F.regexp_extract(F.schema_of_variant(col), r"^[A-Z]+", 0)
        num = F.when(raw.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(col, "$", "double"))
        one = F.struct(F.lit(path).alias("path"), F.when(num.isNotNull(), "number").otherwise(F.lower(raw)).alias("kind"), num.alias("num"), F.when(raw == "STRING", F.try_variant_get(col, "$", "string")).alias("str"))
        return F.when(col.isNull(), none).otherwise(F.array(one))
    kind = "boolean" if isinstance(typ, T.BooleanType) else "string" if isinstance(typ, T.StringType) else "other"
    if kind not in kinds:
        return None
    return F.when(col.isNull(), none).otherwise(F.array(_record(path, kind, text=None if kind == "other" else col)))


def unnest(df: DataFrame, *carry: str, kinds: tuple[str, ...] = KINDS, objects: bool = False, walked: bool = False) -> DataFrame:
    """carried columns, path, kind, num, str: one row per leaf, array, object and key, in one pass over typed columns. kinds: only columns that have such values are read;
    of variants all kinds come. objects, walked: see _records()."""
    cols = [_records(F.col(f"`{f.name}`"), f.dataType, f.name, frozenset(kinds), objects, walked) for f in df.schema.fields if not f.name.startswith("__") and f.name not in carry]
    return df.select(*carry, F.inline(F.concat(F.array().cast(RECORD), *[c for c in cols if c is not None])))


def field_paths(schema: T.DataType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of all fields, depth first."""
    out = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            p = f"{prefix}.{f.name}" if prefix else f.name
            out += [(p, f.dataType.typeName())] + field_paths(f.dataType, p)
    elif isinstance(schema, T.ArrayType):
        out += field_paths(schema.elementType, prefix + "[]")
    elif isinstance(schema, T.MapType):
        out += field_paths(schema.valueType, prefix + ".*")
    return out


def variant_leaves(typ: T.DataType, path: str = "") -> list[str]:
    """Paths, elements and map values included, whose values are variants."""
    if isinstance(typ, T.StructType):
        return [p for f in typ.fields for p in variant_leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(typ, T.ArrayType):
        return variant_leaves(typ.elementType, path + "[]")
    if isinstance(typ, T.MapType):
        return variant_leaves(typ.valueType, path + ".*")
    return [path] if isinstance(typ, T.VariantType) else []


def variant_paths(df: DataFrame, json: str, carry: tuple[str, ...] = (), depth: int = 100) -> DataFrame:
    """The same for JSON text whose keys and types aren't known: level by level. carry, path, typ, value (string)."""
    level = df.select(*carry, F.lit("").alias("path"), F.parse_json(json).alias("v"))
    out = None
    for _ in range(depth):
        level.createOrReplaceTempView("__level")
        nested = level.sparkSession.sql(
            f"SELECT {''.join(c + ', ' for c in carry)} concat(path, CASE WHEN x.key IS NULL THEN '[]' WHEN path = '' THEN x.key ELSE concat('.', x.key) END) AS path, x.value AS v FROM __level, LATERAL variant_explode(v) AS x"
        )
        nested = nested.withColumn("typ", F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0))
        out = nested if out is None else out.unionByName(nested)
        level = nested.where(F.col("typ").isin("OBJECT", "ARRAY")).drop("typ")
        if level.isEmpty():
            break
    return out.select(*carry, "path", json_type("v", "typ").alias("typ"), F.when(~F.col("typ").isin("OBJECT", "ARRAY"), F.expr("cast(v as string)")).alias("value"))


def json_type(v: str, typ: str) -> Column:
    """integer or number by value, never by how it is stored."""
    num = F.expr(f"try_variant_get({v}, '$', 'double')")
    t = F.col(typ)
    return F.when(t.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.when(num == F.floor(num), "integer").otherwise("number")).when(t == "VOID", "null").otherwise(F.lower(t))


# --- distributions -----------------------------------------------------------------------------------------------------


def frequencies(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def running(freq: DataFrame, by: list[str], value: str = "value", n: str = "n", bins: int = 64) -> DataFrame:
    """freq with `upto`, the running count of `n` in the order of `value`, and `total`, per group.

    Values are cut into ranges (numbers at approximate quantiles, text at those of a sample), ranges are summed, and running counts are taken
    inside a range on top of the ranges before it: exact at any number of distinct values, and no group's values meet in one task."""
    if isinstance(freq.schema[value].dataType, T.NumericType):
        cuts = freq.groupBy(*by).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 1000).alias("cuts"))
        f = freq.join(cuts, by).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    else:
        f = freq.join(text_cuts(freq, by, value, bins), by, "left").withColumn("bin", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(value))), F.lit(0))).drop("cuts")
    part = f.groupBy(*by, "bin").agg(F.sum(n).alias("t"))
    span = Window.partitionBy(*by)
    part = part.withColumn("before", F.coalesce(F.sum("t").over(span.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("t").over(span)).drop("t")
    return f.join(part, [*by, "bin"]).withColumn("upto", F.col("before") + F.sum(n).over(Window.partitionBy(*by, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).drop("bin", "before")


def text_cuts(freq: DataFrame, by: list[str], value: str, bins: int, sample: int = 4096, width: int = 256) -> DataFrame:
    """by, cuts: of each group's distinct texts the bins - 1 that cut them into ranges of about the same number, from those of least hash: about `sample` (twice as many at most, but for chance), the first `width`
    characters of each. A text cut short is still a place in the order."""
    size = freq.groupBy(*by).agg(F.count("*").alias("__n"))
    unit = (F.xxhash64(value).cast("double") + 2.0**63) / 2.0**64
    some = freq.join(size, by).where(unit * F.col("__n") <= sample).groupBy(*by).agg(F.array_sort(F.collect_list(F.substring(value, 1, width))).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / bins).cast("int")))
    return some.select(*by, F.array_distinct(F.array_compact(at)).alias("cuts"))


def distribution(freq: DataFrame, by: list[str], value: str = "value", n: str = "n", bins: int = 64, quantiles: dict[str, float] | None = None) -> DataFrame:
    """by, min, max, median, p90, p95, p99, total, unique: discrete percentiles, the first value whose running count reaches total * q."""
    key = by or ["__all"]
    ranked = running(freq if by else freq.withColumn("__all", F.lit(1)), key, value, n, bins)
    reach = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col(value))).cast("double").alias(name) for name, q in (quantiles or QUANTILES).items()]
    out = ranked.groupBy(*key).agg(F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), *reach, F.max("total").cast("long").alias("total"), F.count("*").alias("unique"))
    return out if by else out.drop("__all")


def percentile(freq: DataFrame, q: float, value: str = "value", n: str = "n") -> DataFrame:
    """One row, `value`: the first value whose running count reaches total * q."""
    if not 0 <= q <= 1:
        raise ValueError(f"percentile must be in [0, 1]: {q}")
    return distribution(freq, [], value, n, quantiles={"value": q}).select("value")


def numeric_profile(rows: DataFrame, by: str = "path", num: str = "num", digits: int = 4, percentiles: bool = False) -> DataFrame:
    """Per path: count, min, max, mean, sample deviation (0 for one value), whether all are integers and none negative; percentiles: the discrete ones of distribution() too."""
    v = F.col(num)
    if percentiles:
        values = rows.where(v.isNotNull())
        return numeric_profile(values, by, num, digits).join(distribution(frequencies(values.select(by, v.alias("value")), by, "value"), [by]).select(by, *QUANTILES), by)
    return rows.groupBy(by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), digits).alias("std_dev"),
        F.bool_and(v == F.floor(v)).alias("is_int"), F.bool_and(v >= 0).alias("all_positive"),
    )


def enum_like(distinct: Column, count: Column) -> Column:
    return (distinct <= 50) & ((distinct / count <= 0.1) | (distinct <= 10))


# --- sizes -------------------------------------------------------------------------------------------------------------


def leaf_count(col: Column, typ: T.DataType) -> Column:
    """How many leaves a document has; null is one leaf."""
    if isinstance(typ, T.StructType):
        kids = [leaf_count(col.getField(f.name), f.dataType) for f in typ.fields]
        return F.when(col.isNull(), F.lit(1)).otherwise(balanced(add, kids))
    if isinstance(typ, T.ArrayType):
        return F.when(col.isNull(), F.lit(1)).otherwise(F.aggregate(F.transform(col, lambda x: leaf_count(x, typ.elementType).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))
    if isinstance(typ, T.MapType):
        return leaf_count(F.map_values(col), T.ArrayType(typ.valueType))
    return F.lit(1)


def array_total(col: Column, typ: T.DataType) -> Column:
    """Sum of all array lengths in a document, nested ones too."""
    zero = F.lit(0).cast("long")
    if isinstance(typ, T.StructType):
        kids = [array_total(col.getField(f.name), f.dataType) for f in typ.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        return F.coalesce(balanced(add, [zero, *kids]), zero)
    if isinstance(typ, T.ArrayType):
        inner = F.aggregate(F.transform(col, lambda x: array_total(x, typ.elementType)), zero, lambda a, x: a + x)
        return F.coalesce(F.size(col).cast("long") + inner, zero)
    if isinstance(typ, T.MapType):
        return F.coalesce(F.aggregate(F.transform(F.map_values(col), lambda x: array_total(x, typ.valueType)), zero, lambda a, x: a + x), zero)
    return zero


def size_proxy(df: DataFrame, kind: str) -> Column:
    whole, typ = F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema
    if kind == "leafFieldCount":
        return leaf_count(whole, typ).cast("long")
    if kind == "arrayLengthSum":
        return array_total(whole, typ)
    if kind == "byteSize":
        return F.length(F.to_json(whole, {"ignoreNullFields": "false"})).cast("long")
    raise ValueError(f"unknown size proxy: {kind}")


#: Default buckets, both ends inclusive, the first that fits.
BUCKETS = (("small", 0, 10), ("medium", 11, 100), ("large", 101, 1_000_000))


def size_buckets(sizes: DataFrame, size: str = "size", buckets: tuple[tuple[str, int, int], ...] = BUCKETS) -> DataFrame:
    """bucket, min, max, n, probability: documents outside all buckets count in the denominator only; empty buckets stay."""
    spark = sizes.sparkSession
    which = F.coalesce(*[F.when(F.col(size).between(lo, hi), F.lit(b)) for b, lo, hi in buckets])
    seen = sizes.groupBy(which.alias("bucket")).agg(F.count("*").alias("n"))
    total = seen.agg(F.sum("n").alias("total"))
    named = spark.createDataFrame([(b, float(lo), float(hi)) for b, lo, hi in buckets], "bucket string, min double, max double")
    return named.join(seen, "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", "min", "max", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("probability"))


def auto_buckets(sizes: DataFrame, size: str = "size") -> DataFrame:
    """The same with three buckets over [min, max], cut at 0.33 and 0.67 of the range; shared ends go to the lower one."""
    ends = sizes.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).where("lo is not null")
    a, b = F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * 0.33), F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * 0.67)
    ends = ends.select("lo", a.alias("a"), b.alias("b"), "hi")
    s = sizes.crossJoin(F.broadcast(ends))
    which = F.when(F.col(size) <= F.col("a"), "small").when(F.col(size) <= F.col("b"), "medium").otherwise("large")
    seen = s.groupBy(which.alias("bucket")).agg(F.count("*").alias("n"))
    total = seen.agg(F.sum("n").alias("total"))
    named = ends.select(F.explode(F.array(*[F.struct(F.lit(x).alias("bucket"), F.col(lo).cast("double").alias("min"), F.col(hi).cast("double").alias("max")) for x, lo, hi in (("small", "lo", "a"), ("medium", "a", "b"), ("large", "b", "hi"))])).alias("x")).select("x.*")
    return named.join(seen, "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", "min", "max", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("probability"))


# --- semantic types ----------------------------------------------------------------------------------------------------


def semantic_profile(rows: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, path: str = "path", value: str = "str") -> DataFrame:
    """path, detector, priority, confidence, n (strings at the path), matches, ratio, for the detectors whose gate opens.

    Gates are decided on the driver over the distinct paths, which are as many as the schema has fields."""
    paths = [r[0] for r in rows.where(F.col(value).isNotNull()).select(path).distinct().collect()]
    parts = []
    for d in detectors:
        open_ = [p for p in paths if d.applies(p)]
        if open_:
            parts.append(F.when(F.col(path).isin(open_), F.struct(F.lit(d.name).alias("detector"), F.lit(d.priority).alias("priority"), F.lit(d.confidence).alias("confidence"), d.test(F.col(value)).alias("hit"))))
    if not parts:
        return rows.sparkSession.createDataFrame([], "path string, detector string, priority int, confidence double, n bigint, matches bigint, ratio double")
    each = rows.where(F.col(value).isNotNull()).select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return each.groupBy("path", "x.detector", "x.priority", "x.confidence").agg(F.count("*").alias("n"), F.count_if("x.hit").alias("matches")).withColumn("ratio", F.round(F.col("matches") / F.col("n"), 6))


def semantic_best(profile: DataFrame) -> DataFrame:
    """path, detector, ratio: the detector of highest priority whose ratio is enough."""
    return profile.where("ratio >= confidence").groupBy("path").agg(F.min_by(F.struct("detector", "ratio"), F.struct("priority", "detector")).alias("x")).select("path", "x.detector", "x.ratio")


# --- dynamic keys ------------------------------------------------------------------------------------------------------


@dataclass
class KeyConfig:
    threshold: int = 100
    patterns: dict[str, str] = field(default_factory=lambda: dict(KEY_PATTERNS))
    min_pattern_match: float = 0.8
    confidence_threshold: float = 0.7
    force_static: tuple[str, ...] = ()
    force_dynamic: tuple[str, ...] = ()

    @classmethod
    def disabled(cls) -> KeyConfig:
        return cls(threshold=2**53, min_pattern_match=1.1)

    @classmethod
    def merged(cls, *layers: dict) -> KeyConfig:
        """Later layers win; None is no setting."""
        out = {}
        for layer in layers:
            out |= {k: v for k, v in layer.items() if v is not None}
        return cls(**out).checked()

    def checked(self) -> KeyConfig:
        import re

        from doclathe.sources.errors import ConfigError

        if self.threshold < 2:
            raise ConfigError("threshold must be 2 or more")
        if not (0 <= self.min_pattern_match <= 1 and 0 <= self.confidence_threshold <= 1):
            raise ConfigError("ratios must be in [0, 1]")
        if not self.patterns:
            raise ConfigError("at least one key pattern is needed")
        for name, rx in self.patterns.items():
            try:
                re.compile(rx.replace(r"\z", r"\Z"))
            except re.error as e:
                raise ConfigError(f"pattern {name}: {e}") from e
        if set(self.force_static) & set(self.force_dynamic):
            raise ConfigError("a path can't be forced both ways")
        return self

    def forced(self, path: str) -> str | None:
        """static, dynamic or None; `*` and `?` stand for any text and any character, static wins."""
        from fnmatch import fnmatchcase

        hit = lambda pats: any(fnmatchcase(path, p) or path.startswith(p + ".") for p in pats)
        return "static" if hit(self.force_static) else "dynamic" if any(fnmatchcase(path, p) for p in self.force_dynamic) else None


def key_ratios(keys: DataFrame, config: KeyConfig | None = None, path: str = "path", key: str = "key") -> DataFrame:
    """path, n_keys, pattern, ratio: the best pattern of the distinct keys, the first listed on ties, null if none matches any."""
    config = config or KeyConfig()
    k = keys.select(F.col(path).alias("path"), F.col(key).alias("key")).distinct()
    names = list(config.patterns)
    rates = k.groupBy("path").agg(F.count("*").alias("n_keys"), *[F.avg(F.col("key").rlike(rx).cast("int")).alias(f"r_{i}") for i, rx in enumerate(config.patterns.values())])
    best = F.greatest(*[F.col(f"r_{i}") for i in range(len(names))]) if len(names) > 1 else F.col("r_0")
    which = F.coalesce(*[F.when((F.col(f"r_{i}") == best) & (best > 0), F.lit(n)) for i, n in enumerate(names)])
    return rates.select("path", "n_keys", which.alias("pattern"), F.round(best, 6).alias("ratio"))


def detect(ratios: DataFrame, config: KeyConfig | None = None, docs: str = "n_docs") -> DataFrame:
    """ratios with n_docs -> confidence, level, is_dynamic, one expression over each path's aggregate row."""
    c = config or KeyConfig()
    n, r, d = F.col("n_keys").cast("double"), F.col("ratio"), F.col(docs).cast("double")
    x = n / c.threshold
    boosted = F.least(F.lit(1.0), r + F.when(x > 2, F.least(F.lit(0.1), (x - 2) * 0.02)).otherwise(0.0))
    by_count, by_pattern = n >= c.threshold, r >= c.min_pattern_match
    patterned = F.col("pattern").isNotNull()
    per_doc = n / d
    # Many documents and no pattern: a wide but fixed set of fields must not pass.
    evidence = patterned | (d <= 50) | (n > 500) | ((n >= 100) & (per_doc > 0.05))
    count_only = F.least(F.lit(0.9), c.confidence_threshold + 0.2 * F.log10(F.greatest(x, F.lit(1e-9)))) - F.when(~patterned & (per_doc < 0.1), 0.1).otherwise(0.0)
    conf = F.when(by_count & by_pattern, boosted).when(by_pattern, F.least(F.lit(1.0), r + 0.05)).when(by_count, count_only).otherwise(0.0)
    out = ratios.withColumn("confidence", F.round(conf, 6))
    ok = (by_pattern | (by_count & evidence)) & (F.col("confidence") >= c.confidence_threshold)
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return out.withColumn("level", level).withColumn("is_dynamic", ok)


def promoted(r, config: KeyConfig) -> bool:
    """Whether a path's detection makes its object dynamic: enough keys, or some with a pattern or high confidence."""
    return bool(r["is_dynamic"]) and (r["n_keys"] >= config.threshold or (r["n_keys"] >= min(config.threshold, 10) and (r["pattern"] is not None or r["confidence"] > 0.8)))


def object_keys(df: DataFrame, config: KeyConfig | None = None) -> DataFrame | None:
    """doc, parent, key: the keys of every object in every document (structs: fields that aren't null; maps: entries), parents by path with the keys as they are. config: without those that can't be made up by it:
    structs of too few fields that no map or wider struct is above; None if there are no others."""

    def narrow(typ: T.DataType, path: str) -> list[str]:
        """Paths of structs of too few fields to be dynamic, with nothing but such and arrays above."""
        if isinstance(typ, T.ArrayType):
            return narrow(typ.elementType, path + "[]")
        if not isinstance(typ, T.StructType) or len(typ.fields) >= min(config.threshold, 10) or config.forced(path) == "dynamic":
            return []
        return [path, *[p for f in typ.fields for p in narrow(f.dataType, f"{path}.{f.name}")]]

    few = {p for f in df.schema.fields for p in narrow(f.dataType, f.name)} if config else set()

    def below(col: Column, typ: T.DataType, path: Column, at: str | None = None) -> list[Column]:
        row = lambda k: F.struct(path.alias("parent"), k.alias("key"))
        under = lambda k: F.concat(path, F.lit("."), k)
        if isinstance(typ, T.StructType):
            out = [F.array_compact(F.array(*[F.when(col.getField(f.name).isNotNull(), row(F.lit(f.name))) for f in typ.fields]))] if typ.fields and at not in few else []
            for f in typ.fields:
                out += below(col.getField(f.name), f.dataType, under(F.lit(f.name)), at and f"{at}.{f.name}")
            return out
        if isinstance(typ, T.MapType):
            out = [F.transform(F.map_keys(col), lambda k: row(k))]
            if below(F.lit(None), typ.valueType, path):
                out.append(F.flatten(F.transform(F.map_entries(col), lambda e: F.concat(*below(e["value"], typ.valueType, under(e["key"]))))))
            return out
        if isinstance(typ, T.ArrayType) and below(F.lit(None), typ.elementType, path, at and at + "[]"):
            return [F.flatten(F.transform(col, lambda x: F.concat(*below(x, typ.elementType, F.concat(path, F.lit("[]")), at and at + "[]"))))]
        return []

    empty = F.array().cast("array<struct<parent:string,key:string>>")
    parts = [F.coalesce(x, empty) for f in df.schema.fields for x in below(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), f.name)]
    if config and not parts:
        return None
    each = F.inline(F.concat(*parts)) if parts else F.inline(empty)
    return df.select(F.monotonically_increasing_id().alias("doc"), each)


def dynamic_stats(keys: DataFrame, config: KeyConfig | None = None) -> DataFrame:
    """Of rewritten keys (doc, parent, key): path, n_keys, pattern, ratio, n_docs, confidence, level, is_dynamic, examples (the first ten keys, of a path with over 2000 those of the sample)."""
    from doclathe.operators.state import key_sample

    docs = keys.groupBy(F.col("parent").alias("path")).agg(F.count_distinct("doc").alias("n_docs"))
    some = key_sample(keys, path="parent").groupBy("path").agg(F.slice(F.array_sort(F.collect_list("key")), 1, 10).alias("examples"))  # of 2000 keys a path at most
    return detect(key_ratios(keys, config, "parent", "key").join(docs, "path"), config).join(some, "path")


def common(types: list[T.DataType]) -> T.DataType:
    """A type that holds values of all: the same, the wider number, a struct of all fields, else a variant."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, T.StructType) for t in types):
        names = list(dict.fromkeys(f.name for t in types for f in t.fields))
        return T.StructType([T.StructField(n, common([t[n].dataType for t in types if n in t.names])) for n in names])
    if all(isinstance(t, T.ArrayType) for t in types):
        return T.ArrayType(common([t.elementType for t in types]))
    return T.VariantType()


def conform(col: Column, typ: T.DataType, to: T.DataType) -> Column:
    if typ == to:
        return col
    if isinstance(to, T.VariantType):
        return F.to_variant_object(col) if isinstance(typ, (T.StructType, T.MapType, T.ArrayType)) else col.cast(to)
    if isinstance(to, T.StructType):
        kids = [(conform(col.getField(f.name), typ[f.name].dataType, f.dataType) if f.name in typ.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(col.isNotNull(), F.struct(*kids))
    if isinstance(to, T.ArrayType):
        return F.transform(col, lambda x: conform(x, typ.elementType, to.elementType))
    return col.cast(to)


def reshape(df: DataFrame, dynamic: set[str], names: dict[str, list[str]]) -> DataFrame:
    """df with the objects at `dynamic` paths (`*` for any key above) as maps, and all others as structs; names: the keys of objects that are maps now and won't be."""

    def shaped(col: Column, typ: T.DataType, path: str) -> tuple[Column, T.DataType]:
        if isinstance(typ, T.ArrayType):
            to = shaped(F.lit(None).cast(typ.elementType), typ.elementType, path + "[]")[1]
            return F.transform(col, lambda x: shaped(x, typ.elementType, path + "[]")[0]), T.ArrayType(to)
        if isinstance(typ, T.MapType) and path not in dynamic:
            kids = [(k, shaped(F.try_element_at(col, F.lit(k)), typ.valueType, f"{path}.{k}")) for k in names.get(path, [])]
            return F.when(col.isNotNull(), F.struct(*[c.alias(k) for k, (c, _) in kids])) if kids else F.lit(None).cast("struct<>"), T.StructType([T.StructField(k, of) for k, (_, of) in kids])
        if isinstance(typ, T.MapType):
            to = shaped(F.lit(None).cast(typ.valueType), typ.valueType, path + ".*")[1]
            return F.transform_values(col, lambda _, x: shaped(x, typ.valueType, path + ".*")[0]), T.MapType(T.StringType(), to)
        if isinstance(typ, T.StructType):
            here = path in dynamic
            kids = [(f.name, shaped(col.getField(f.name), f.dataType, f"{path}.*" if here else f"{path}.{f.name}")) for f in typ.fields]
            if not here or not kids:
                return F.when(col.isNotNull(), F.struct(*[c.alias(k) for k, (c, _) in kids])) if kids else col, T.StructType([T.StructField(k, of) for k, (_, of) in kids])
            to = common([of for _, (_, of) in kids])
            entry = [F.when(col.getField(k).isNotNull(), F.struct(F.lit(k).alias("key"), conform(c, of, to).alias("value"))) for k, (c, of) in kids]
            return F.when(col.isNotNull(), F.map_from_entries(F.array_compact(F.array(*entry)))), T.MapType(T.StringType(), to)
        return col, typ

    return df.select(*[shaped(F.col(f"`{f.name}`"), f.dataType, f.name)[0].alias(f.name) for f in df.schema.fields])


def collapse(keys: DataFrame, config: KeyConfig | None = None, depth: int = 100) -> tuple[DataFrame, list[tuple[str, str | None]]]:
    """keys (doc, parent, key, path): object keys of all documents, with the parent's path. Level by level from the top, parents whose
    keys are dynamic become wildcards, and the paths below them are rewritten before the next level is looked at.

    Returns the rewritten keys and [(dynamic path, pattern)]. The list is as long as the schema is wide."""
    config = config or KeyConfig()
    rows, found = keys.withColumn("level", F.size(F.split("parent", r"\."))).persist(), []  # read once a level
    deepest = rows.agg(F.max("level")).first()[0] or 0
    for level in range(1, min(depth, deepest) + 1):
        at = rows.where((F.col("level") == level) & (F.col("parent") != ""))
        docs = at.groupBy(F.col("parent").alias("path")).agg(F.count_distinct("doc").alias("n_docs"))
        seen = detect(key_ratios(at, config, "parent", "key").join(docs, "path"), config).collect()
        new = [(r["path"], r["pattern"]) for r in seen if config.forced(r["path"]) != "static" and (config.forced(r["path"]) == "dynamic" or promoted(r, config))]
        found += new
        for path, _ in new:
            child = F.concat(F.lit(path + ".*"), F.regexp_extract(F.substring(F.col("parent"), len(path) + 2, 10**6), r"^[^.]*(.*)$", 1))
            rows = rows.withColumn("parent", F.when(F.col("parent").startswith(path + ".") & ~F.col("parent").startswith(path + ".*"), child).otherwise(F.col("parent")))
    return rows.drop("level"), found


def value_types(rows: DataFrame, path: str = "path", typ: str = "typ") -> DataFrame:
    """path, typ, n, probability, dominant: how often each JSON type occurs among the values at a path."""
    n = rows.groupBy(F.col(path).alias("path"), F.col(typ).alias("typ")).agg(F.count("*").alias("n"))
    per = n.groupBy("path").agg(F.sum("n").alias("all"), F.max_by("typ", F.struct("n", "typ")).alias("top"))
    return n.join(per, "path").select("path", "typ", "n", F.round(F.col("n") / F.col("all"), 6).alias("probability"), (F.col("typ") == F.col("top")).alias("dominant"))


def value_schema(types: list[dict], facts: dict | None = None) -> dict:
    """JSON Schema of the values at a dynamic path, from its value_types rows and numeric facts {min, max}; several types keep their probabilities."""
    facts = facts or {}
    one = lambda t: {"type": t} | ({"minimum": facts["min"], "maximum": facts["max"]} if t in ("integer", "number") and "min" in facts else {})
    ranked = sorted(types, key=lambda r: (-r["n"], r["typ"]))
    if len(ranked) == 1:
        return one(ranked[0]["typ"])
    return {"anyOf": [one(r["typ"]) for r in ranked], "x-type-probabilities": [r["probability"] for r in ranked]}


def prune(stats: DataFrame, dynamic: DataFrame, path: str = "path") -> DataFrame:
    """stats without the rows nested under a dynamic path (a table as wide as the schema)."""
    d = dynamic.select(F.col("path").alias("__dynamic"))
    return stats.join(d, F.col(path).startswith(F.concat(F.col("__dynamic"), F.lit("."))), "left_anti")


def presence(df: DataFrame) -> DataFrame:
    """field, n, probability, required (0.95 or more) of each column."""
    one = df.agg(F.count("*").alias("__n"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("n"), F.round(F.col(f"`{c}`") / F.col("__n"), 6).alias("probability")) for c in df.columns])
    return one.select(F.inline(parts)).withColumn("required", F.col("probability") >= 0.95)
