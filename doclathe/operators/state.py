"""Profile state: what a profile needs of a set of documents, as a table of counts that can be merged.

A row is (section, path, item, num, n), and n is added when states are merged:

| section | of | item | num |
|---|---|---|---|
| docs | all documents | | |
| field | a top-level column that isn't null | | |
| type | values by JSON type (integer and number by value) | type | |
| number | numbers | | value |
| length | arrays | | elements |
| keys | maps and objects | | entries |
| chars | texts | | characters |
| text | texts of a path with at most TEXTS different ones | text | |
| many | texts of the other paths | | |
| meaning | texts that a semantic detector hits | detector | |
| key | keys of maps and objects, the KEYS of least hash | key | |
| sketch | maps and objects; `sketch` counts their different keys | | |

So all statistics are exact but for the number of keys beyond KEYS, which a theta sketch estimates (within about 3 %). Texts and keys are bounded per path;
numbers and lengths are as many rows as there are different ones, counted before they are shuffled. Nothing but sets of paths reaches the driver.

Variants are walked to any depth: their members have paths as fields have. Objects with made-up keys give one path, `*`, for all.

Defined results: nulls count nowhere but in `docs` (in variants they are of type null); NaN and infinities are no numbers. Empty tables give `docs` with n = 0.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.functions.scalar import DETECTORS, Detector
from doclathe.operators import profile as P

STATE = "section string, path string, item string, num double, n bigint, sketch binary"
TEXTS, KEYS = 50, 2000
_NAMES = ("section", "path", "item", "num")


def _row(section: str, path: Column, item: Column | None = None, num: Column | None = None) -> Column:
    return F.struct(F.lit(section).alias("section"), path.alias("path"), (F.lit(None) if item is None else item).cast("string").alias("item"), (F.lit(None) if num is None else num).cast("double").alias("num"))


# --- values ------------------------------------------------------------------------------------------------------------


def variants(df: DataFrame) -> DataFrame | None:
    """path, v: every variant of typed columns, wherever it is; None if the schema has none."""

    def below(col: Column, typ: T.DataType, path: str) -> list[Column]:
        if isinstance(typ, T.StructType):
            return [x for f in typ.fields for x in below(col.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(typ, (T.ArrayType, T.MapType)):
            inner, mark = (typ.elementType, "[]") if isinstance(typ, T.ArrayType) else (typ.valueType, ".*")
            if not P.variant_leaves(inner):
                return []
            values = col if isinstance(typ, T.ArrayType) else F.map_values(col)
            return [F.flatten(F.transform(values, lambda x: F.concat(*[F.coalesce(y, none) for y in below(x, inner, path + mark)])))]
        return [F.when(col.isNotNull(), F.array(F.struct(F.lit(path).alias("path"), col.alias("v"))))] if isinstance(typ, T.VariantType) else []

    none = F.array().cast("array<struct<path:string,v:variant>>")
    parts = [F.coalesce(x, none) for f in df.schema.fields if not f.name.startswith("__") for x in below(F.col(f"`{f.name}`"), f.dataType, f.name)]
    return df.select(F.inline(F.concat(*parts))) if parts else None


def _typed(level: DataFrame, *more: str) -> DataFrame:
    raw = F.substring(F.schema_of_variant("v"), 1, 3)
    return level.select("path", "v", *more, F.when(raw.isin("BIG", "DEC", "DOU", "FLO"), "number").when(raw == "VOI", "null").when(raw == "STR", "string").when(raw == "BOO", "boolean").when(raw == "OBJ", "object").when(raw == "ARR", "array").otherwise("other").alias("kind"))


def _measures() -> list[Column]:
    """num and str of a typed variant."""
    number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
    size = F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>"))).when(F.col("kind") == "object", F.size(F.try_variant_get("v", "$", "map<string,variant>")))
    text = F.when(F.col("kind").isin("string", "boolean", "other"), F.try_variant_get("v", "$", "string"))
    return [F.coalesce(number, size.cast("double")).alias("num"), text.alias("str")]


def _opened(depth: int) -> Column:
    """Of (path, v) the levels of all that is in the variant, as arrays of (path, v, up, key): the keys of objects, with their paths. The last one is empty unless it is at the depth."""
    record = "array<struct<path:string,v:variant,up:string,key:string>>"
    none = F.array().cast(record)

    def inside(x: Column) -> Column:
        entry = lambda e: F.struct(F.concat_ws(".", x["path"], e["key"]).alias("path"), e["value"].alias("v"), x["path"].alias("up"), e["key"].alias("key"))
        item = lambda y: F.struct(F.concat(x["path"], F.lit("[]")).alias("path"), y.alias("v"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("key"))
        kind = F.substring(F.schema_of_variant(x["v"]), 1, 3)
        return (
            F.when(kind == "OBJ", F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), entry).cast(record))
            .when(kind == "ARR", F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), item).cast(record)).otherwise(none)
        )

    top = F.array(F.array(F.struct(F.col("path"), F.col("v"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("key"))).cast(record))
    last = lambda levels: F.element_at(levels, -1)
    step = lambda levels, _: F.when(F.size(last(levels)) == 0, levels).otherwise(F.concat(levels, F.array(F.flatten(F.transform(last(levels), inside)))))
    down = lambda levels, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), levels, step)
    # Most documents end after few levels; steps of the others are not even looped over.
    first = down(top, min(depth, 8))
    all_ = F.transform(F.array(first), lambda levels: F.when(F.size(last(levels)) == 0, levels).otherwise(down(levels, depth - 8)))[0] if depth > 8 else first
    return all_


def _flat(level: DataFrame, depth: int = 64) -> DataFrame:
    """path, kind, num, str of (path, v) and of all that is in the variants, keys told as they are: each variant is opened once, in its row, however deep it is."""
    each = level.select(F.inline(F.flatten(_opened(depth))))
    told = _typed(each, "up", "key").select("path", "kind", *_measures(), "up", "key")
    value = F.struct("path", "kind", "num", "str")
    key = F.struct(F.col("up").alias("path"), F.lit("key").alias("kind"), F.lit(None).cast("double").alias("num"), F.col("key").alias("str"))
    return told.select(F.inline(F.when(F.col("key").isNull(), F.array(value)).otherwise(F.array(value, key))))


#: An object of so many different keys or more (estimated) may have made-up ones.
WIDE = 8


def walk(level: DataFrame, config: P.KeyConfig | None = None, depth: int = 64) -> DataFrame:
    """path, kind, num, str of (path, v) and of all that is in the variants; keys have kind `key`. One job finds the objects of ten keys or more. Only if there are such, levels are walked one after the other, and a
    job a level tells from the top down which keys are made up: keys are grouped, and paths of objects come back. Beyond `depth` levels values count, but what is in them doesn't."""
    config, flat = config or P.KeyConfig(), _flat(level, depth)
    wide = flat.where("kind = 'key'").groupBy("path").agg(F.approx_count_distinct("str", 0.05).alias("u"))
    return _walk_down(level, config, depth) if config.force_dynamic or not wide.where(F.col("u") >= WIDE).isEmpty() else flat


def _walk_down(level: DataFrame, config: P.KeyConfig, depth: int = 64) -> DataFrame:
    deepest = level.agg(F.max(F.size(F.filter(_opened(depth), lambda x: F.size(x) > 0)) - 1)).first()[0] or 0
    return reduce(DataFrame.unionByName, _levels(level, deepest, lambda opened, inside: _made_up(opened, inside, config)))


def _made_up(keys: DataFrame, inside: DataFrame, config: P.KeyConfig) -> list[str]:
    sizes = keys.groupBy("path").agg(F.approx_count_distinct("key", 0.05).alias("u")).collect()
    wide = [r["path"] for r in sizes if r["u"] >= 8 or config.forced(r["path"]) == "dynamic"]
    if not wide:
        return []
    objects = inside.where((F.col("kind") == "object") & F.col("path").isin(wide)).groupBy("path").agg(F.count("*").alias("n_docs"))
    found = P.detect(P.key_ratios(keys.where(F.col("path").isin(wide)), config).join(objects, "path"), config).collect()
    return [r["path"] for r in found if config.forced(r["path"]) != "static" and (config.forced(r["path"]) == "dynamic" or P.promoted(r, config))]


def _levels(level: DataFrame, deepest: int, made_up) -> list[DataFrame]:
    """Rows of all levels."""
    out = []
    for at in range(deepest + 1):
        typed = _typed(level)
        out.append(typed.select("path", "kind", *_measures()))
        if at == deepest:
            break
        inside = typed.where("kind in ('object', 'array')")
        opened = level.sparkSession.sql("SELECT path, x.key AS key, x.value AS v FROM {inside}, LATERAL variant_explode(v) AS x", inside=inside)
        keys = opened.where("key is not null").select("path", "key")
        out.append(keys.select("path", F.lit("key").alias("kind"), F.lit(None).cast("double").alias("num"), F.col("key").alias("str")))
        found = made_up(keys, inside)
        name = F.when(F.col("path").isin(found), "*").otherwise(F.col("key")) if found else F.col("key")
        level = opened.select(F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", name)).alias("path"), "v")
    return out


def values(df: DataFrame, config: P.KeyConfig | None = None) -> DataFrame:
    """path, kind, num, str: unnest() with structs as objects, and variants walked."""
    typed = P.unnest(df, objects=True, walked=True)
    found = variants(df)
    return typed if found is None else typed.unionByName(walk(found, config))


# --- the state ---------------------------------------------------------------------------------------------------------


def state_of(df: DataFrame, config: P.KeyConfig | None = None, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """The state of a table of documents (normalised): two passes, one that finds paths of many texts and sketches keys, one that counts."""
    config = config or P.KeyConfig()
    typed, loose = P.unnest(df, objects=True, walked=True), variants(df)
    path, kind, num, text = (F.col(c) for c in ("path", "kind", "num", "str"))
    # A row per path. Estimates of texts are within 5 %, so a path said to have twice TEXTS texts has more than TEXTS.
    sketch = F.theta_sketch_agg(F.when(kind == "key", text), 12)

    def told(rows: DataFrame) -> list:
        return rows.where("kind in ('string', 'key')").groupBy("path", "kind").agg(F.approx_count_distinct("str", 0.05).alias("u"), F.count("*").alias("n"), sketch.alias("sketch"), F.theta_sketch_estimate(sketch).alias("keys")).collect()

    rows = typed if loose is None else typed.unionByName(_flat(loose))
    inner = [] if loose is None else [p for p in P.variant_leaves(df.schema) if not p.startswith("__")]
    seen = None if inner and config.force_dynamic else told(rows)
    if inner and (seen is None or any(r["kind"] == "key" and r["u"] >= WIDE and any(r["path"] == p or r["path"].startswith((p + ".", p + "[")) for p in inner) for r in seen)):
        rows = typed.unionByName(_walk_down(loose, config))
        seen = told(rows)
    many = [r["path"] for r in seen if r["kind"] == "string" and r["u"] > 2 * TEXTS]
    is_many = path.isin(many) if many else F.lit(False)
    paths = [r["path"] for r in seen if r["kind"] == "string"]
    # Of many keys only those below a hash that lets about twice as many through as are kept are counted and shuffled.
    limits = {r["path"]: 2.0 * KEYS / r["keys"] for r in seen if r["kind"] == "key" and r["keys"] > 2 * KEYS}
    below = F.coalesce(*[F.when(path == p, F.lit(x)) for p, x in limits.items()], F.lit(1.0))
    parts = [
        F.when(kind != "key", _row("type", path, F.when((kind == "number") & (num == F.floor(num)), "integer").otherwise(kind))),
        F.when(kind == "number", _row("number", path, num=num)),
        F.when(kind == "array", _row("length", path, num=num)),
        F.when(kind == "object", _row("keys", path, num=num)),
        F.when(kind == "string", _row("chars", path, num=F.length(text))),
        F.when(kind == "string", F.when(is_many, _row("many", path)).otherwise(_row("text", path, text))),
        F.when((kind == "key") & (_unit(text) <= below), _row("key", path, text)),
    ]
    for d in detectors:
        if open_ := [p for p in paths if d.applies(p)]:
            parts.append(F.when((kind == "string") & path.isin(open_) & d.test(text), _row("meaning", path, F.lit(d.name))))
    counted = rows.select(F.inline(F.array_compact(F.array(*parts)))).groupBy(*_NAMES).agg(F.count("*").alias("n"))
    present = [F.struct(F.lit("docs").alias("section"), F.lit("").alias("path"), F.count("*").alias("n"))] + [F.struct(F.lit("field").alias("section"), F.lit(f).alias("path"), F.count(f"`{f}`").alias("n")) for f in df.columns if not f.startswith("__")]
    whole = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(present)]).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(present))])))
    whole = whole.select("section", "path", F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("num"), "n")
    sketches = df.sparkSession.createDataFrame([("sketch", r["path"], None, None, r["n"], bytes(r["sketch"])) for r in seen if r["kind"] == "key"], STATE)
    return _bounded(counted.unionByName(whole)).unionByName(sketches)


def _unit(text: Column) -> Column:
    """A hash of a text in [0, 1], in the order of xxhash64()."""
    return (F.xxhash64(text).cast("double") + 2.0**63) / 2.0**64


def key_sample(keys: DataFrame, most: int = KEYS, path: str = "path", key: str = "key") -> DataFrame:
    """path, key, n: of each path the `most` keys of least hash, a uniform sample of the different keys, and all of them where there are no more.

    A sketch (bounded, merged from each task) tells how many keys there are; only keys below the hash that lets about twice as many through as are needed are shuffled."""
    size = keys.groupBy(path).agg(F.theta_sketch_estimate(F.theta_sketch_agg(key, 12)).alias("u")).collect()  # a row per map or object of the schema
    limits = {r[path]: 2.0 * most / r["u"] for r in size if r["u"] > 2 * most}
    below = F.coalesce(*[F.when(F.col(path) == p, F.lit(x)) for p, x in limits.items()], F.lit(1.0))
    few = keys.where(_unit(F.col(key)) <= below).groupBy(F.col(path).alias("path"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy(F.xxhash64("key"), "key")
    return few.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def _bounded(flat: DataFrame) -> DataFrame:
    """Texts of paths with too many become `many`; of keys the sample stays. One pass: rows of these sections meet by path (they are bounded), each other row stands alone."""
    section = F.col("section")
    meet = Window.partitionBy(F.when(section.isin("text", "many"), F.struct(F.lit("text").alias("s"), F.col("path"), F.lit(None).cast("double").alias("x"))).when(section == "key", F.struct(section.alias("s"), F.col("path"), F.lit(None).cast("double").alias("x"))).otherwise(F.struct(F.lit("").alias("s"), F.col("path"), F.coalesce("num", F.lit(0.0)).alias("x"))))
    texts, crowd = F.count_if(section == "text").over(meet), F.count_if(section == "many").over(meet)
    place = F.row_number().over(meet.orderBy(F.xxhash64("item"), "item"))
    told = flat.withColumns({"__texts": texts, "__crowd": crowd, "__place": place}).where((section != "key") | (F.col("__place") <= KEYS))
    over = (section == "text") & ((F.col("__texts") > TEXTS) | (F.col("__crowd") > 0))
    told = told.select(F.when(over, "many").otherwise(section).alias("section"), "path", F.when(~over, F.col("item")).alias("item"), "num", "n")
    return told.groupBy(*_NAMES).agg(F.sum("n").alias("n")).withColumn("sketch", F.lit(None).cast("binary"))


def merge(*states: DataFrame) -> DataFrame:
    """One state of all documents of the given states."""
    both = reduce(DataFrame.unionByName, states)
    flat = both.where("section <> 'sketch'").groupBy(*_NAMES).agg(F.sum("n").alias("n"))
    sketch = both.where("section = 'sketch'").groupBy("path").agg(F.theta_union_agg("sketch", 12).alias("sketch"), F.sum("n").alias("n"))
    return _bounded(flat).unionByName(sketch.select(F.lit("sketch").alias("section"), "path", F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("num"), "n", "sketch"))


# --- what a profile says -----------------------------------------------------------------------------------------------


def documents(state: DataFrame) -> int:
    return state.where("section = 'docs'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def presence(state: DataFrame) -> DataFrame:
    """field, n, probability, required."""
    total = state.where("section = 'docs'").agg(F.sum("n").alias("total"))
    out = state.where("section = 'field'").crossJoin(F.broadcast(total))  # one row
    return out.select(F.col("path").alias("field"), "n", F.round(F.try_divide("n", "total"), 6).alias("probability")).withColumn("required", F.col("probability") >= 0.95)


def types(state: DataFrame) -> DataFrame:
    """path, typ, n, probability, dominant."""
    t = state.where("section = 'type'").select("path", F.col("item").alias("typ"), "n")
    per = t.groupBy("path").agg(F.sum("n").alias("all"), F.max_by("typ", F.struct("n", "typ")).alias("top"))
    return t.join(per, "path").select("path", "typ", "n", F.round(F.col("n") / F.col("all"), 6).alias("probability"), (F.col("typ") == F.col("top")).alias("dominant"))


#: Up to so many different values of a path are put in order in one task; beyond, in ranges.
ONE_TASK = 200_000


def _by_size(state: DataFrame, section: str) -> tuple[DataFrame, DataFrame | None]:
    """(path, value, n) of the paths with few different values, and of those with many, if there are such."""
    f = state.where(F.col("section") == section).select("path", F.col("num").alias("value"), "n")
    large = [r["path"] for r in f.groupBy("path").count().where(F.col("count") > ONE_TASK).collect()]
    return (f, None) if not large else (f.where(~F.col("path").isin(large)), f.where(F.col("path").isin(large)))


def _in_one_task(f: DataFrame, *more: Column) -> DataFrame:
    """P.distribution() of paths with few different values: they meet by path, once. more: aggregates, which may use `mean`, that of the path."""
    path = Window.partitionBy("path")
    upto = F.sum("n").over(path.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = f.withColumns({"upto": upto, "total": F.sum("n").over(path), "mean": F.sum(F.col("value") * F.col("n")).over(path) / F.sum("n").over(path)})
    reach = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value"))).alias(name) for name, q in P.QUANTILES.items()]
    return ranked.groupBy("path").agg(F.min("value").alias("min"), F.max("value").alias("max"), *reach, F.max("total").alias("total"), F.count("*").alias("unique"), *more)


def distribution(state: DataFrame, section: str) -> DataFrame:
    """path, min, max, median, p90, p95, p99, total, unique of the numbers of a section."""
    few, many = _by_size(state, section)
    return _in_one_task(few) if many is None else _in_one_task(few).unionByName(P.distribution(many, ["path"]))


def numeric(state: DataFrame, digits: int = 4) -> DataFrame:
    """path, n, min, max, mean, std_dev (sample; 0 for one value), is_int, all_positive, median, p90, p95, p99."""
    few, many = _by_size(state, "number")
    v, n = F.col("value"), F.col("n")
    # Deviations from the mean, so that no large squares cancel.
    told = [F.max("mean").alias("m"), F.sum(n * (v - F.col("mean")) ** 2).alias("s"), F.bool_and(v == F.floor(v)).alias("is_int"), F.bool_and(v >= 0).alias("all_positive")]
    out = _in_one_task(few, *told)
    if many is not None:
        mean = many.groupBy("path").agg((F.sum(v * n) / F.sum(n)).alias("mean"))
        out = out.unionByName(P.distribution(many, ["path"]).join(many.join(mean, "path").groupBy("path").agg(*told), "path"))
    deviation = F.when(F.col("total") > 1, F.sqrt(F.col("s") / (F.col("total") - 1))).otherwise(0.0)
    return out.select("path", F.col("total").alias("n"), "min", "max", F.round("m", digits).alias("mean"), F.round(deviation, digits).alias("std_dev"), "is_int", "all_positive", *P.QUANTILES)


def enums(state: DataFrame) -> DataFrame:
    """path, value, n of the paths whose texts are like an enumeration."""
    t = state.where("section = 'text'").select("path", F.col("item").alias("value"), "n")
    small = t.groupBy("path").agg(F.count("*").alias("u"), F.sum("n").alias("all")).where(P.enum_like(F.col("u"), F.col("all"))).select("path")
    return t.join(small, "path", "left_semi")


def meanings(state: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """path, detector, ratio: the detector of highest priority whose share of the path's texts is enough."""
    named = state.sparkSession.createDataFrame([(d.name, d.priority, float(d.confidence)) for d in detectors], "detector string, priority int, confidence double")
    total = state.where("section = 'chars'").groupBy("path").agg(F.sum("n").alias("all"))
    hit = state.where("section = 'meaning'").select("path", F.col("item").alias("detector"), F.col("n").alias("matches"))
    return P.semantic_best(hit.join(F.broadcast(named), "detector").join(total, "path").withColumn("ratio", F.round(F.col("matches") / F.col("all"), 6)))


def keys(state: DataFrame, config: P.KeyConfig | None = None) -> DataFrame:
    """path, n_keys, pattern, ratio, n_docs (objects), confidence, level, is_dynamic, examples. n_keys is exact up to KEYS, and estimated beyond; ratios are those of the sample."""
    k = state.where("section = 'key'").select("path", F.col("item").alias("key"))
    ratios = P.key_ratios(k, config).withColumnRenamed("n_keys", "kept")
    some = k.groupBy("path").agg(F.slice(F.array_sort(F.collect_list("key")), 1, 10).alias("examples"))  # of KEYS at most
    est = state.where("section = 'sketch'").select("path", F.theta_sketch_estimate("sketch").alias("est"))
    docs = state.where("section = 'keys'").groupBy("path").agg(F.sum("n").alias("n_docs"))
    j = ratios.join(est, "path").join(docs, "path").withColumn("n_keys", F.when(F.col("kept") < KEYS, F.col("kept")).otherwise(F.greatest("kept", "est")).cast("long")).drop("kept", "est")
    return P.detect(j.select("path", "n_keys", "pattern", "ratio", "n_docs"), config).join(some, "path")


def _discrete(freq: dict[float, int]) -> dict[str, float]:
    """What P.distribution() says of a frequency table at hand."""
    order, total, upto = sorted(freq), sum(freq.values()), 0
    out: dict[str, float] = {"min": order[0], "max": order[-1], "total": total, "unique": len(order)}
    for v in order:
        upto += freq[v]
        for name, q in P.QUANTILES.items():
            if name not in out and upto >= total * q:
                out[name] = v
    return out


def facts(state: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> dict[str, dict[str, Any]]:
    """What synthesis needs of each path: rows per path, different length and enumerated text come to the driver; values of numbers and lengths of texts are aggregated before."""
    out: dict[str, dict[str, Any]] = {}
    at = lambda p: out.setdefault(p, {})
    few = state.where(F.col("section").isin("docs", "field", "type", "length", "keys", "meaning", "text")).select(*_NAMES, "n").collect()
    of = lambda *names: [r for r in few if r["section"] in names]
    total = sum(r["n"] for r in of("docs"))
    for r in of("field"):
        at(r["path"])["presence"] = round(r["n"] / total, 6) if total else None
    for r in numeric(state).collect():
        at(r["path"])["numeric"] = r.asDict()
    for r in state.where("section = 'chars'").groupBy("path").agg(F.min("num").alias("min"), F.max("num").alias("max"), F.sum("n").alias("total")).collect():
        at(r["path"])["chars"] = r.asDict()
    for r in sorted(of("length", "keys"), key=lambda r: r["num"]):
        at(r["path"]).setdefault("array" if r["section"] == "length" else "size", {}).setdefault("distribution", {})[str(int(r["num"]))] = r["n"]
    for p, f in out.items():
        for name in ("array", "size"):
            if name in f:
                f[name] = {"path": p} | _discrete({float(k): n for k, n in f[name]["distribution"].items()}) | f[name]
    hits = {(r["path"], r["item"]): r["n"] for r in of("meaning")}
    for d in sorted(detectors, key=lambda d: (d.priority, d.name), reverse=True):
        for p in {p for p, name in hits if name == d.name}:
            if round(hits[p, d.name] / out[p]["chars"]["total"], 6) >= d.confidence:
                out[p]["format"] = d.format
    all_: dict[str, int] = {}
    for r in of("type"):
        all_[r["path"]] = all_.get(r["path"], 0) + r["n"]
    for r in sorted(of("type"), key=lambda r: (r["n"], r["item"]), reverse=True):
        told = at(r["path"]).setdefault("types", [])
        told.append({"path": r["path"], "typ": r["item"], "n": r["n"], "probability": round(r["n"] / all_[r["path"]], 6), "dominant": not told})
    texts: dict[str, dict[str, int]] = {}
    for r in of("text"):
        texts.setdefault(r["path"], {})[r["item"]] = r["n"]
    for p, values_ in texts.items():
        u, n = len(values_), sum(values_.values())
        if u <= 50 and (u / n <= 0.1 or u <= 10):  # P.enum_like()
            out[p]["enum"] = values_
    return out


def variant_schema(facts: dict[str, dict[str, Any]], path: str, required: float = 0.95) -> dict[str, Any]:
    """JSON Schema of the values at a path of variants, from the facts at it and below it: several types keep their probabilities; objects have properties, and those that at least `required`
    of the objects have are required; arrays and texts have lengths, numbers bounds."""
    f = facts.get(path, {})
    told = {r["typ"]: r for r in f.get("types", [])}
    if not told:
        return {"type": "string"}
    if "integer" in told and "number" in told:  # every integer is a number
        whole, num = told.pop("integer"), told["number"]
        told["number"] = num | {"n": num["n"] + whole["n"], "probability": round(num["probability"] + whole["probability"], 6)}
    ranked = sorted(told.values(), key=lambda r: (-r["n"], r["typ"]))

    def one(r: dict[str, Any]) -> dict[str, Any]:
        typ, out = r["typ"], {"type": r["typ"] if r["typ"] != "other" else "string"}
        if typ in ("integer", "number") and "numeric" in f:
            out |= {"minimum": f["numeric"]["min"], "maximum": f["numeric"]["max"]}
        elif typ == "string":
            if "chars" in f:
                out |= {"minLength": int(f["chars"]["min"]), "maxLength": int(f["chars"]["max"])}
            if "format" in f:
                out["format"] = f["format"]
            if "enum" in f:
                out["enum"] = list(f["enum"])
        elif typ == "array":
            out |= {"minItems": int(f["array"]["min"]), "maxItems": int(f["array"]["max"])}
            if facts.get(path + "[]", {}).get("types"):
                out["items"] = variant_schema(facts, path + "[]", required)
        elif typ == "object":
            names = sorted({p[len(path) + 1 :].split(".")[0].removesuffix("[]") for p in facts if p.startswith(path + ".") and facts[p].get("types")})
            if "*" in names:
                out |= {"x-dynamic-keys": {"enabled": True, "pattern": "CUSTOM", "countDistribution": f.get("size", {}).get("distribution", {"10": 1}), "valueSchema": variant_schema(facts, path + ".*", required)}}
            elif names:
                count = lambda k: sum(t["n"] for t in facts.get(f"{path}.{k}", {}).get("types", []))
                out |= {"properties": {k: variant_schema(facts, f"{path}.{k}", required) for k in names}, "required": [k for k in names if count(k) >= required * r["n"]]}
        return out

    parts = [one(r) for r in ranked]
    return parts[0] if len(parts) == 1 else {"anyOf": parts, "x-type-probabilities": [r["probability"] for r in ranked]}
