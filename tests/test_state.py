"""Profile states, streams, change logs with presence, and JSON Schema by value, against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.operators import state as St
from doclathe.plans import api
from doclathe.sources import errors as E
from doclathe.sources import readers as R
from doclathe.streaming import profile as SP


def texts_of(df, *drop):
    return sorted(repr(tuple(r)) for r in df.drop(*drop).collect())


@pytest.fixture(scope="module")
def mixed(spark):
    """Numbers, texts, arrays, maps with few and with many keys, structs and variants, with nulls everywhere."""
    rng = random.Random(4)
    rows = []
    for i in range(180):
        v = rng.choice([None, "null", "7", "2.5", '"x"', '[1,[2,"y"],null]', '{"a":%d,"b":{"c":[true]}}' % i, '{"a":"s"}', "{}", "[]"])
        rows.append((i, rng.choice([None, "A", "B"]), f"text {i}", rng.choice([None, float("nan"), 1.5, -2.0, 3.0]), rng.choice([None, [], [1, 2]]), {f"{i:08x}-0000-4000-8000-000000000000": 1, "k": None} if i % 3 else None, (i, None) if i % 4 else None, v))
    df = spark.createDataFrame(rows, "id int, kind string, note string, x double, xs array<int>, m map<string,int>, s struct<a:int,b:string>, js string")
    return df.withColumn("v", F.parse_json("js")).drop("js").repartition(3).cache()


def test_batches_merge_to_the_state_of_all(spark, mixed, tmp_path):
    whole = St.state_of(mixed).cache()
    merged = SP.profile(spark, str(tmp_path / "p"), compact=2)
    for i in range(3):
        merged.update(mixed.where(F.col("id") % 3 == i), i)
        merged = SP.profile(spark, str(tmp_path / "p"), compact=2)  # as after a restart
    merged.update(mixed.where(F.col("id") % 3 == 2), 2)
    merged.update(mixed.where(F.col("id") % 3 == 0), 0)  # in a base already
    got = merged.read().cache()
    assert texts_of(got, "sketch") == texts_of(whole, "sketch")
    assert texts_of(St.keys(got)) == texts_of(St.keys(whole))
    # What it says is what the batch operators say of the table.
    typed = P.unnest(mixed.drop("v"))
    batch = P.numeric_profile(typed.where("kind = 'number'"), percentiles=True)
    assert texts_of(St.numeric(whole).where("path not like 'v%' and path not like '%.%' and path not like '%[]'")) == texts_of(batch.where("path not like '%.%' and path not like '%[]'").select(St.numeric(whole).columns))
    assert texts_of(St.presence(whole)) == texts_of(P.presence(mixed))
    lengths = P.distribution(P.frequencies(typed.where("kind = 'array'").select("path", F.col("num").alias("value")), "path", "value"), ["path"])
    assert texts_of(St.distribution(whole, "length").where("path = 'xs'")) == texts_of(lengths)
    assert {(r["path"], r["value"]) for r in St.enums(whole).collect()} >= {("kind", "A"), ("kind", "B")}
    assert whole.where("section = 'many' and path = 'note'").count() == 1, "more than fifty texts are no enumeration"
    assert [r["n"] for r in whole.where("section = 'docs'").collect()] == [180]
    f = St.facts(whole)
    assert {r["typ"] for r in f["v"]["types"]} == {"null", "integer", "number", "string", "array", "object"}
    assert {r["typ"] for r in f["v[][]"]["types"]} == {"integer", "string"}
    with pytest.raises(ValueError):
        SP.profile(spark, str(tmp_path / "none")).read()


def test_state_edges(spark, mixed):
    empty = St.state_of(mixed.limit(0))
    assert [(r["section"], r["n"]) for r in empty.collect() if r["section"] != "field"] == [("docs", 0)]
    assert St.documents(St.merge(empty, St.state_of(mixed.limit(0)))) == 0
    with pytest.raises(E.InferenceError):
        api.infer_state(empty, mixed.schema)


def test_a_stream_has_the_profile_and_schema_of_its_rows(spark, mixed, tmp_path):
    plain = mixed.select("id", "kind", "xs", "m", "v")
    for i in range(2):
        plain.where(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merged = SP.profile(spark, str(tmp_path / "state"), compact=2)
    run = lambda: merged.start(spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
    run()
    plain.where("id < 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on where it ended
    both = plain.unionByName(plain.where("id < 10"))
    assert texts_of(merged.read(), "sketch") == texts_of(St.state_of(both), "sketch")
    schema, _ = api.infer_state(merged.read(), plain.schema)
    assert schema["properties"]["m"]["x-dynamic-keys"]["enabled"] and schema["properties"]["xs"]["maxItems"] == 2
    variants = {x["type"]: x for x in schema["properties"]["v"]["anyOf"]}
    assert {"a", "b"} <= set(variants["object"]["properties"]) and variants["array"]["minItems"] == 0
    assert variants["object"]["properties"]["b"]["properties"]["c"]["items"] == {"type": "boolean"}


def test_many_keys_are_sampled(spark):
    n = 1_000_000
    keys = spark.range(n, numPartitions=4).select(F.lit("m").alias("path"), F.concat(F.lit("k_"), F.col("id").cast("string")).alias("key")).unionByName(spark.range(900).select(F.lit("few").alias("path"), (F.col("id") % 300).cast("string").alias("key")))
    got = St.key_sample(keys).cache()
    assert got.where("path = 'm'").count() == St.KEYS
    assert {(r["key"], r["n"]) for r in got.where("path = 'few'").collect()} == {(str(i), 3) for i in range(300)}
    least = keys.where("path = 'm'").orderBy(F.xxhash64("key")).limit(St.KEYS)
    assert {r["key"] for r in got.where("path = 'm'").collect()} == {r["key"] for r in least.collect()}
    docs = spark.range(30_000, numPartitions=4).select("id", F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.format_string("%s-%08d", F.lit("id"), F.col("id") * 5 + j)), F.array_repeat(F.lit(1), 5)).alias("m"))
    a, b = St.state_of(docs.where("id < 20000")), St.state_of(docs.where("id >= 20000"))
    r = St.keys(St.merge(a, b)).first()
    assert abs(r["n_keys"] / 150_000 - 1) < 0.05 and r["n_docs"] == 30_000 and r["is_dynamic"]


def test_variant_objects_with_made_up_keys(spark):
    rows = [json.dumps({"by": {f"user_{i * 7 + j:06d}": {"n": j, "tags": ["t"] * j} for j in range(3)}, "fixed": {"a": 1, **({"b": 2} if i % 2 else {})}}) for i in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "js string").select(F.parse_json("js").alias("doc"))
    s = St.variant_schema(St.facts(St.state_of(df)), "doc")
    value = s["properties"]["by"]["x-dynamic-keys"]["valueSchema"]
    assert value["required"] == ["n", "tags"] and value["properties"]["n"] == {"type": "integer", "minimum": 0.0, "maximum": 2.0} and value["properties"]["tags"]["maxItems"] == 2
    assert s["properties"]["fixed"]["required"] == ["a"] and set(s["properties"]["fixed"]["properties"]) == {"a", "b"}


def test_sample_and_report_do_not_depend_on_batches(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("t"), (F.col("id") % 50).alias("n"))
    schema = {"type": "object", "required": ["t"], "properties": {"n": {"maximum": 40}, "t": {"type": "string", "maxLength": 2}}}
    for name, cuts in (("a", 1), ("b", 5)):
        sample, report = SP.sample(spark, str(tmp_path / f"s{name}"), 20, "_id", compact=2), SP.report(spark, str(tmp_path / f"r{name}"), schema, "_id", worst=15, compact=2)
        for i in range(cuts):
            part = df.where(F.col("_id") % cuts == i).repartition(3)
            sample.update(part, i)
            report.update(part, i)
        assert texts_of(sample.read()) == texts_of(R.random_sample(df, 20, "_id"))
        got = report.read().collect()
        bad = lambda i: [("/n", "maximum")] * (i % 50 > 40) + [("/t", "maxLength")] * (i % 3 != 0 and i > 99) + [("/t", "required")] * (i % 3 == 0)
        each = [(i, *x) for i in range(300) for x in bad(i)]
        assert sorted((r["key"], r["path"], r["keyword"]) for r in got if r["section"] == "listed") == each[:15]
        assert {(r["path"], r["keyword"]): r["n"] for r in got if r["section"] == "rule"} == {k: sum(x[1:] == k for x in each) for k in {x[1:] for x in each}}
        assert {r["keyword"]: r["n"] for r in got if r["section"] == "docs"} == {"total": 300, "invalid": sum(bool(bad(i)) for i in range(300))}


def test_change_logs_operation_by_operation(spark):
    rng = random.Random(2)
    target = {k: (rng.choice([None, "a"]), k) for k in range(0, 40, 2)}
    log = []
    for seq in range(400):
        op = rng.choice(["insert", "update", "update", "update", "delete", "frob", None])
        log.append((rng.randrange(40), seq, op, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), rng.choice([None, [], ["v"], ["v", "w"]])))
    now, told = dict(target), []
    for k, seq, op, v, w, present in log:
        was = k in now
        if op == "insert":
            now[k], what = (v, w), "replaced" if was else "inserted"
        elif op not in ("update", "delete"):
            what = "skipped"
        elif not was:
            what = "unmatched"
        elif op == "delete":
            what = "deleted"
            del now[k]
        else:
            has = lambda name, x: x is not None if present is None else name in present
            new = (v if has("v", v) else now[k][0], w if has("w", w) else now[k][1])
            what = "modified" if new != now[k] else "matched"
            now[k] = new
        told.append((k, seq, op, what))
    old = spark.createDataFrame([(k, *x) for k, x in target.items()], "k long, v string, w long")
    ops = spark.createDataFrame(log, "k long, seq long, op string, v string, w long, p array<string>").repartition(4)
    got = D.apply_log(old, ops, "k", ["v", "w"], present="p").collect()
    assert {r["k"]: (r["v"], r["w"]) for r in got} == now and len(got) == len(now)
    assert sorted(map(repr, (tuple(r) for r in D.log_outcomes(old, ops, "k", ["v", "w"], present="p").collect()))) == sorted(map(repr, told))


def test_values_compare_as_json_has_it(spark):
    values = [None, True, 1, 1.0, 1.5, "1", "a'b", [1, {"b": 1, "a": [2.0]}], [1, {"a": [2], "b": 1}], {"x": None}, {}, {"it's": 1}, {"x": [None, ""]}, [], [[]], 10, 100.0, {"n": 10}, {"n": 10.0}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, js string").select("i", F.parse_json("js").alias("v"))
    same = lambda a, b: type(a) is not bool and type(b) is not bool and a == b if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not (isinstance(a, bool) and isinstance(b, bool)) else type(a) is type(b) and (len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a.keys() == b.keys() and all(same(a[k], b[k]) for k in a) if isinstance(a, dict) else a == b)
    from doclathe.operators.rules import canonical, equal
    from pyspark.sql import types as T

    got = df.select("i", *[F.coalesce(equal(F.col("v"), T.VariantType(), v), F.lit(False)).alias(f"e{j}") for j, v in enumerate(values)], canonical(F.col("v"), T.VariantType()).alias("text")).collect()
    text = {r["i"]: r["text"] for r in got}
    for r in got:
        for j, v in enumerate(values):
            assert r[f"e{j}"] == same(values[r["i"]], v), (values[r["i"]], v)
            assert (text[r["i"]] == text[j]) == same(values[r["i"]], v), (text[r["i"]], text[j])


def test_references(spark):
    tree = {"$ref": "#/definitions/t"}
    schema = {"definitions": {"t": {"type": "object", "properties": {"v": {"type": "integer"}, "kid": tree}}, "a/b": {"maximum": 3}}, "properties": {"tree": tree, "n": {"$ref": "#/definitions/a~1b", "minimum": 100}}}
    nest = lambda depth, v: {"v": v, **({"kid": nest(depth - 1, v)} if depth else {})}
    docs = [{"tree": nest(2, 1), "n": 3}, {"tree": nest(2, "x"), "n": 4}, {"tree": nest(9, 1)}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, js string").select("i", F.parse_json("js").alias("v"))
    got = {r["i"]: sorted((x["path"], x["keyword"]) for x in r["b"]) for r in df.select("i", D.violations_of(F.col("v"), schema).alias("b")).collect()}
    assert got[0] == [] and got[1] == [("/n", "maximum"), ("/tree/kid/kid/v", "type"), ("/tree/kid/v", "type"), ("/tree/v", "type")]
    assert [k for _, k in got[2]] == ["$ref"], "what is nested too deep doesn't pass unchecked"
    typed = spark.createDataFrame([((1, (2,)), 9)], "tree struct<v:int,kid:struct<v:int>>, n int")
    assert [(x["path"], x["keyword"]) for x in typed.select(D.violations(schema, typed).alias("b")).first()["b"]] == [("/n", "maximum")]
    with pytest.raises(E.ConfigError):
        D.violations_of(F.col("v"), {"$ref": "#/nowhere"})


def test_variants_are_opened_once(spark, tmp_path):
    """Documents of any shape and depth: all of it as level by level, from one scan; what is beyond the depth doesn't count."""
    rng = random.Random(5)

    def some(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {k: some(depth - 1) for k in rng.sample("abcde", rng.randint(0, 3))}
        if depth and kind < 0.7:
            return [some(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 1, -2.5, 1e300, "x", "", "2020-01-01"])

    docs = [some(rng.randint(0, 11)) for _ in range(200)] + [{"a": {"b": [[[[[[[[[{"c": [1, {"d": None}]}]]]]]]]]]}}, [], {}]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(json.dumps(x),) for x in docs], "j string").write.parquet(path)
    df = spark.read.parquet(path).select(F.parse_json("j").alias("doc"))
    level = St.variants(df)
    for depth in (64, 6, 3, 1):
        told = [Counter(tuple(r) for r in x.collect()) for x in (St._flat(level, depth), St._walk_down(level, P.KeyConfig.disabled(), depth))]
        assert told[0] == told[1] and sum(told[0].values()) > 200
    plan = St.state_of(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") <= 3  # typed columns, variants, and the number of documents
