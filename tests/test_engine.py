"""All queries against DuckDB, goldens of the survey's fixtures, partition invariance, the round trip, the command line and the stream."""

import datetime
import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe import cli
from doclathe.functions import scalar as S
from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.plans import api, catalog
from doclathe.sources import errors as E
from doclathe.sources import readers as R
from doclathe.sources import writers as W
from doclathe.streaming import live

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    r = duck.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall())
    assert got == want


# --- goldens -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("freq,want", [({1: 450, 2: 350, 3: 150, 4: 40, 5: 10}, (1, 5, 2, 3, 3, 4, 1000, 5)), ({1: 80, 10: 20}, (1, 10, 1, 10, 10, 10, 100, 2)), ({1: 50, 100: 30, 1000: 20}, (1, 1000, 1, 1000, 1000, 1000, 100, 3)), ({0: 10, 1: 150, 2: 300, 3: 250, 4: 150, 5: 100, 10: 30, 20: 10}, (0, 20, 3, 5, 5, 10, 1000, 8))])
def test_distribution(spark, freq, want):
    f = spark.createDataFrame([(float(k), v) for k, v in freq.items()], "value double, n long")
    r = P.distribution(f, []).first()
    assert tuple(r[c] for c in ("min", "max", "median", "p90", "p95", "p99", "total", "unique")) == want


def test_distribution_many_values(spark):
    f = spark.range(5000).select(F.lit("p").alias("path"), ((F.col("id") * 7919) % 5003).cast("double").alias("value"), (F.col("id") % 3 + 1).alias("n"))
    r = P.distribution(f, ["path"]).first()
    raw = sorted(v for x in f.collect() for v in [x["value"]] * x["n"])
    for name, q in P.QUANTILES.items():
        assert r[name] == raw[math.ceil(len(raw) * q) - 1]


def test_numeric_and_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], {"b": 1.5}), (2, None, None), (3, [], {"b": float("nan")})], "a int, xs array<int>, s struct<b:double>")
    n = {r["path"]: r for r in P.numeric_profile(P.unnest(df).where("kind = 'number'")).collect()}
    assert (n["a"]["mean"], n["a"]["std_dev"], n["a"]["is_int"]) == (2.0, 1.0, True)
    assert (n["s.b"]["n"], n["s.b"]["std_dev"]) == (1, 0.0) and n["xs[]"]["max"] == 2
    lengths = {r["num"] for r in P.unnest(df).where("kind = 'array'").collect()}
    assert lengths == {2.0, 0.0}
    assert [r[0] for r in df.select(P.size_proxy(df, "leafFieldCount")).collect()] == [4, 3, 2]
    with pytest.raises(ValueError):
        P.size_proxy(df, "other")
    assert ("s.b", "double") in P.field_paths(df.schema)


def test_variant_paths(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"x","d":[1.5,2]}}',), ('{"a":"t","b":null}',)], "j string")
    got = {(r["path"], r["typ"]): r["n"] for r in P.variant_paths(df, "j").groupBy("path", "typ").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "integer"): 1, ("a", "string"): 1, ("b", "object"): 1, ("b", "null"): 1, ("b.c", "string"): 1, ("b.d", "array"): 1, ("b.d[]", "number"): 1, ("b.d[]", "integer"): 1}


@pytest.mark.parametrize("name,good,bad", [
    ("Email", ["a@b.co", "x.y+z@mail.example.org"], ["a@b", "nobody"]), ("URL", ["http://x", "https://a/b"], ["ftp://x", "http://"]),
    ("UUID", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]), ("ObjectID", ["507f1f77bcf86cd799439011"], ["507f"]),
    ("Phone", ["+1-555-123-4567", "(555) 123-4567", "555.123.4567"], ["12", "abc"]), ("PersonName", ["Ann O'Neil-Smith Jr."], ["x", "R2D2"]),
    ("IPv4", ["192.168.1.1"], ["1.2.3"]), ("IPv6", ["::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "::ffff:192.0.2.1", "fe80::1%eth0", "::"], ["1:2:3", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9"]),
])
def test_detectors(spark, name, good, bad):
    d = next(x for x in S.DETECTORS if x.name == name)
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r["v"]: r["hit"] for r in df.select("v", d.test(F.col("v")).alias("hit")).collect()}
    assert got == {v: True for v in good} | {v: False for v in bad}


def keyset(n, make):
    return [make(i) for i in range(n)]


@pytest.mark.parametrize("keys,docs,dynamic,pattern", [
    (keyset(60, lambda i: f"{i:08x}-0000-4000-8000-000000000000"), 10, True, "UUID"), (keyset(2, lambda i: f"{i:08x}-0000-4000-8000-000000000000"), 10, True, "UUID"),
    (keyset(80, lambda i: f"{i:024x}") + keyset(40, lambda i: f"field{i}"), 10, True, "OBJECTID"), (keyset(5, lambda i: f"name{i}"), 10, False, None), (keyset(1, lambda i: f"{i:024x}") + ["a", "b"], 10, False, "OBJECTID"),
    (keyset(120, lambda i: f"generic{i}"), 10, True, None), (keyset(120, lambda i: f"generic{i}"), 10000, False, None),
])
def test_detection(spark, keys, docs, dynamic, pattern):
    k = spark.createDataFrame([("p", x) for x in keys], "path string, key string")
    r = P.detect(P.key_ratios(k).withColumn("n_docs", F.lit(docs))).first()
    assert (r["is_dynamic"], r["pattern"]) == (dynamic, pattern)


def test_key_config():
    with pytest.raises(E.ConfigError):
        P.KeyConfig.merged({"threshold": 1})
    with pytest.raises(E.ConfigError):
        P.KeyConfig.merged({"patterns": {"X": "("}})
    with pytest.raises(E.ConfigError):
        P.KeyConfig(force_static=("a",), force_dynamic=("a",)).checked()
    c = P.KeyConfig.merged({"threshold": 5}, {"threshold": None, "force_dynamic": ("x.*",)})
    assert c.threshold == 5 and c.forced("x.y") == "dynamic" and c.forced("z") is None


def test_normalize(spark):
    df = spark.sql("SELECT unhex('507f1f77bcf86cd799439011') AS _id, timestamp'2024-01-02 03:04:05.678' AS at, cast(1.50 AS decimal(5,2)) AS d, array(unhex('ff')) AS bs, map('k', timestamp'2024-01-01 00:00:00') AS m")
    out, hints = D.normalize(df)
    r = out.first()
    assert r["_id"] == "507f1f77bcf86cd799439011" and r["at"] == "2024-01-02T03:04:05.678Z" and r["d"] == "1.50" and r["bs"] == ["/w=="] and r["m"]["k"].startswith("2024-01-01T")
    assert hints["_id"][0] == "objectid" and hints["at"][0] == "date-time" and hints["bs[]"][0] == "base64"


def test_prng_and_formats(spark):
    df = spark.range(500)
    once = [tuple(r) for r in df.select("id", *[f(7, F.col("id"), "p").alias(k.replace("-", "_")) for k, f in S.FORMATS.items()]).orderBy("id").collect()]
    again = [tuple(r) for r in spark.range(0, 500, 1, 17).select("id", *[f(7, F.col("id"), "p").alias(k.replace("-", "_")) for k, f in S.FORMATS.items()]).orderBy("id").collect()]
    assert once == again
    for name, rx in (("objectid", S.OBJECTID), ("uuid", S.UUID), ("email", S.EMAIL), ("url", S.URL), ("ipv4", S.IPV4), ("person-name", S.PERSON)):
        assert df.where(~S.FORMATS[name](7, F.col("id"), "p").rlike(rx)).count() == 0, name
    assert df.where(~S.ipv6(S.FORMATS["ipv6"](7, F.col("id"), "p"))).count() == 0
    assert S.seed_of("abc") == spark.range(1).select(S.seed_column(F.lit("abc"))).first()[0]


@pytest.mark.parametrize("u,want", [(0.05, 1), (0.15, 5), (0.5, 10), (0.99, 10)])
def test_ladder(spark, u, want):
    assert spark.range(1).select(S.ladder([(1, 10), (5, 10), (10, 80)], F.lit(u))).first()[0] == want
    with pytest.raises(ValueError):
        S.ladder([], F.lit(0.5))


SCHEMA = {"properties": {
    "_id": {"type": "string", "format": "objectid"}, "name": {"type": "string", "minLength": 3, "maxLength": 20}, "age": {"type": "integer", "minimum": 18, "maximum": 80}, "score": {"type": "number", "minimum": 0, "maximum": 100},
    "status": {"type": "string", "enum": ["A", "B", "C"], "x-gen": {"enum": {"A": 50, "B": 30, "C": 20}}}, "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "minItems": 2, "maxItems": 5},
    "profile": {"type": "object", "properties": {"email": {"type": "string", "format": "email"}, "ok": {"type": "boolean"}}, "required": ["email"]},
    "accounts": {"type": "object", "x-dynamic-keys": {"pattern": "UUID", "countDistribution": {"3": 100}, "valueSchema": {"type": "integer", "minimum": 1, "maximum": 2}}},
}, "required": ["_id", "name"], "additionalProperties": False}


def test_generate(spark):
    g = D.Generator(SCHEMA, seed="s")
    a, b = g.generate(spark, 1000, 1), g.generate(spark, 1000, 7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert D.conformance(a, SCHEMA, strict=True).first()["rate"] == 1.0
    r = a.agg(F.count_if(F.col("status") == "A").alias("a"), F.min(F.size("accounts")).alias("lo"), F.max(F.size("accounts")).alias("hi"), F.count_distinct("_id").alias("u")).first()
    assert 430 < r["a"] < 570 and (r["lo"], r["hi"], r["u"]) == (3, 3, 1000)
    assert a.where(F.exists(F.map_keys("accounts"), lambda k: ~S.key_valid(k, "UUID"))).count() == 0
    own = S.Registry()
    own.register_path("name", lambda *a: F.lit("fixed"))
    assert D.Generator(SCHEMA, registry=own).generate(spark, 3).select("name").distinct().collect()[0][0] == "fixed"
    assert D.has_dynamic(SCHEMA) == 1


def test_violations(spark):
    df = spark.createDataFrame([("507f1f77bcf86cd799439011", "bob", 20, ["aa", "b"]), ("x", None, 5, ["aa", "bb", "cc", "dd", "ee", "ff"])], "_id string, name string, age int, tags array<string>")
    got = [sorted(tuple(v) for v in r[0]) for r in df.select(D.violations(SCHEMA, df.columns)).collect()]
    assert got[0] == [("/tags[]", "minLength")]
    assert got[1] == [("/_id", "format"), ("/age", "minimum"), ("/name", "required"), ("/tags", "maxItems")]


def test_change_log(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, s string, v double")
    log = spark.createDataFrame([(1, 1, "update", None, 9.0), (2, 1, "update", "z", None), (3, 2, "delete", None, None), (4, 4, "insert", "n", None), (5, 4, "update", None, 4.0), (6, 5, "update", "no", None), (7, 3, "delete", None, None), (8, 3, "insert", "c2", None)], "seq long, k int, op string, s string, v double")
    out, ops = api.mutate(target, log, "k", ["s", "v"])
    assert sorted(map(tuple, out.collect())) == [(1, "z", 9.0), (3, "c2", None), (4, "n", 4.0)]
    assert ops.first()["update"] == 4
    assert D.parse_ratios("insert:50,delete:10") == {"insert": 50, "update": 0, "delete": 10}
    good, bad = D.insert_rows(target, spark.createDataFrame([(1, 0), (7, 1), (7, 2)], "k int, o int"), "k", "o")
    assert (good.count(), bad.count()) == (1, 2)


def test_id_cache():
    c = live.IdCache(2)
    for k in "abc":
        c.add(k)
    assert "a" not in c and len(c) == 2
    c.tombstone("b")
    assert c.pick(0.0) == "c" and c.remove("c") and not c.remove("c") and c.pick(0.5) is None
    c.add("b")
    assert c.pick(0.9) == "b"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(400).select(F.col("id").alias("value")).repartition(1).write.parquet(str(src))
    stream = spark.readStream.schema("value long").parquet(str(src))
    ops = live.change_stream(stream, {"insert": 50.0, "update": 30.0, "delete": 20.0}, shards=2, warm_up=20)
    q = ops.writeStream.format("memory").queryName("ops").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = sorted(spark.sql("SELECT * FROM ops").collect(), key=lambda r: r["seq"])
    assert len(rows) == 400
    alive: dict[int, set] = {0: set(), 1: set()}
    for r in rows:
        if r["op"] == "insert":
            alive[r["shard"]].add(r["key"])
        else:
            assert r["key"] in alive[r["shard"]]
            if r["op"] == "delete":
                alive[r["shard"]].discard(r["key"])
    made = D.Generator(SCHEMA).stream(stream, "value")
    assert made.isStreaming and "_id" in made.columns


def test_compare(spark):
    f = lambda *n: spark.createDataFrame([("t", float(x)) for x in n], "path string, num double")
    same = D.compare_arrays(D.array_stats(f(2, 3, 3, 4)), D.array_stats(f(3, 3, 4))).first()
    assert same["dev_median"] == 0 and same["passed"]
    assert not D.compare_arrays(D.array_stats(f(5, 5)), D.array_stats(f(10, 10))).first()["passed"]
    lost = D.compare_arrays(D.array_stats(f(1)), D.array_stats(f(1)).where("false")).first()
    assert (lost["dev_p90"], lost["passed"]) == (1.0, False)
    u = D.uniqueness(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "_id string"), ["_id"]).first()
    assert (u["total"], u["unique"], u["duplicates"]) == (3, 2, 1)


def test_sources(spark, tmp_path):
    assert R.sanitize_uri("db://u:p@h/x") == "db://***:***@h/x"
    with pytest.raises(E.SamplingError):
        R.strategy("none")
    with pytest.raises(E.SamplingError):
        R.time_window(spark.range(3), 2, "id", None)
    with pytest.raises(E.FileIOError):
        R.load_json(str(tmp_path / "no.json"))
    old = {"fieldPath": "t", "observedLengths": [1, 1, 3]}
    assert R.upgrade(old)["distribution"] == {"1": 2, "3": 1}
    (tmp_path / "c.json").write_text(json.dumps({"arrayStats": [old]}))
    assert R.load_constraints(spark, str(tmp_path / "c.json")).agg(F.sum("n")).first()[0] == 3
    a = [r[0] for r in R.random_sample(spark.range(0, 1000, 1, 1), 10, "id").collect()]
    assert a == [r[0] for r in R.random_sample(spark.range(0, 1000, 1, 9), 10, "id").collect()] and len(a) == 10
    (tmp_path / "d.ndjson").write_text('{"a":1}\n\n{"a":[2]}\n')
    assert R.read_ndjson(spark, str(tmp_path / "d.ndjson")).count() == 2
    (tmp_path / "bad.ndjson").write_text("{oops\n")
    with pytest.raises(Exception):
        R.read_ndjson(spark, str(tmp_path / "bad.ndjson")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    W.write_ndjson(df.coalesce(1), str(tmp_path / "n"))
    lines = [x for p in glob.glob(f"{tmp_path}/n/part*") for x in open(p).read().splitlines()]
    assert sorted(lines) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert W.write_json_array(df, str(tmp_path / "a.json")) == 2 and len(json.load(open(tmp_path / "a.json"))) == 2
    W.write_json_array(df.limit(0), str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json")) == []
    assert W.content_hash(df) == W.content_hash(df.repartition(5)) != W.content_hash(df.limit(1))
    m = W.Manifest(seed=1)
    m.artifact("a", str(tmp_path / "a.json"))
    m.save(str(tmp_path / "m.json"))
    assert len(json.load(open(tmp_path / "m.json"))["artifacts"]["a"]["sha256"]) == 64
    assert W.jsonable({"s": {2, 1}}) == {"s": [1, 2]}


def test_workflow(spark, tmp_path):
    """Profile, synthesise, generate, validate: what is generated passes its own tolerances."""
    made = D.Generator({"properties": SCHEMA["properties"]}, 3).generate(spark, 400)
    schema, facts = api.infer(made)
    assert schema["properties"]["status"]["enum"] and schema["properties"]["tags"]["minItems"] == 2 and schema["properties"]["age"]["type"] == "integer"
    assert schema["properties"]["accounts"]["x-dynamic-keys"]["pattern"] == "UUID" and schema["properties"]["profile"]["properties"]["email"]["format"] == "email"
    again = api.generate(spark, schema, 400)
    report = api.validate(made, again, schema)
    assert report["schemaConformance"]["rate"] == 1.0 and all(r["passed"] for r in report["arrayLengthComparison"])
    with pytest.raises(E.InferenceError):
        api.infer(made.limit(0))
    made.write.parquet(str(tmp_path / "src"))
    assert cli.main(["infer", "--input", str(tmp_path / "src"), "--schema", str(tmp_path / "s.json"), "--constraints", str(tmp_path / "c.json")], spark) == 0
    lengths = {(r["path"], r["value"]): r["n"] for r in R.load_constraints(spark, str(tmp_path / "c.json")).collect()}
    assert sum(n for (p, _), n in lengths.items() if p == "tags") == 400
    assert cli.main(["generate", "--schema", str(tmp_path / "s.json"), "--count", "50", "--output", str(tmp_path / "out")], spark) == 0
    assert cli.main(["generate", "--schema", str(tmp_path / "none.json"), "--output", str(tmp_path / "x")], spark) == 4
    W.write_ndjson(made, str(tmp_path / "sample"))
    assert cli.main(["validate", "--sample", str(tmp_path / "sample"), "--generated", str(tmp_path / "out"), "--schema", str(tmp_path / "s.json"), "--report", str(tmp_path / "r.json")], spark) in (0, 1)


def test_collapse_nested(spark):
    """Two levels of made-up keys above a fixed object: the fixed part stays."""
    u = lambda *x: "%08x-0000-4000-8000-%012x" % x
    rows = [(d, "", "a", ) for d in range(10)]
    for d in range(10):
        for i in range(5):
            rows.append((d, "a", u(d, i)))
            for j in range(5):
                rows.append((d, f"a.{u(d, i)}", u(i, 100 * d + j)))
                rows.append((d, f"a.{u(d, i)}.{u(i, 100 * d + j)}", "val"))
    out, found = P.collapse(spark.createDataFrame(rows, "doc int, parent string, key string"), P.KeyConfig(threshold=20))
    assert [p for p, _ in found] == ["a", "a.*"] and {r["parent"] for r in out.collect()} == {"", "a", "a.*", "a.*.*"}
    stats = spark.createDataFrame([("a",), ("a.x",), ("b.c",)], "path string")
    assert {r[0] for r in P.prune(stats, spark.createDataFrame([("a",)], "path string")).collect()} == {"a", "b.c"}


def test_types():
    assert D.array_bounds({"min": 1, "max": 9, "median": 3, "p90": 7, "p99": 8}, "percentileClamp", (60, 90)) == (3, 7)
    s = D.synthesize(T.StructType().add("a", T.LongType()).add("b", T.StringType()), {"b": {"presence": 0.5}, "a": {"presence": 1.0, "numeric": {"min": 1, "max": 2, "is_int": True}}})
    assert s["required"] == ["a"] and s["properties"]["a"]["maximum"] == 2 and s["additionalProperties"] is False


def test_values_and_regex(spark):
    rows = spark.createDataFrame([("p", "integer")] * 3 + [("p", "string")] * 2, "path string, typ string")
    got = [r.asDict() for r in P.value_types(rows).orderBy("typ").collect()]
    assert [(r["typ"], r["probability"], r["dominant"]) for r in got] == [("integer", 0.6, True), ("string", 0.4, False)]
    assert P.value_schema(got, {"min": 1, "max": 3}) == {"anyOf": [{"type": "integer", "minimum": 1, "maximum": 3}, {"type": "string"}], "x-type-probabilities": [0.6, 0.4]}
    assert P.percentile(spark.createDataFrame([(1.0, 80), (10.0, 20)], "value double, n long"), 0.95).first()[0] == 10.0
    with pytest.raises(ValueError):
        P.percentile(rows, 1.5)
    rx = r"^(ab|cd)-[0-9]{3}x+[^a-y]?$"
    k = spark.range(50).select(S.custom_keys(rx, 1, F.col("id"), "k").alias("k"))
    assert k.where(~F.col("k").rlike(rx)).count() == 0


def test_mutations(spark):
    g = D.Generator({"properties": {"_id": {"type": "string"}, "n": {"type": "integer"}, "s": {"type": "string"}, "t": {"type": "string"}, "u": {"type": "boolean"}}})
    df = spark.range(200).withColumn("n", F.lit(4))
    m = {x: [r[0] for r in df.select(D.mutation(g, x, F.col("id"), {"n": F.col("n")})).collect()] for x in (*D.MODES, "other")}
    assert all(set(r) == {"n", "s", "t", "u"} for r in m["regenerate"]) and {len(r) for r in m["partial"]} == {1, 2, 3}
    assert {len(r) for r in m["mixed"]} == {1, 2, 3, 4} and m["increment"][0] == {"n": '{"v":5}'} and list(m["other"][0]) == ["updatedAt"]


def test_change_log_batch(spark, tmp_path):
    ids = spark.range(1000, 1050).select(F.col("id").cast("string"))
    log = live.change_log(spark, 600, {"insert": 20.0, "update": 50.0, "delete": 30.0}, ids, D.Generator(SCHEMA), shards=3)
    rows = sorted(log.collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in rows] == list(range(600))
    alive = {str(i) for i in range(1000, 1050)}
    for r in rows:
        if r["op"] == "insert":
            alive.add(r["key"])
            assert "name" in r["set"]
        else:
            assert r["key"] in alive
            assert (r["set"] is None) == (r["op"] == "delete")
            alive -= {r["key"]} if r["op"] == "delete" else set()
    assert rows == sorted(live.change_log(spark, 600, {"insert": 20.0, "update": 50.0, "delete": 30.0}, ids.repartition(7), D.Generator(SCHEMA), shards=3).collect(), key=lambda r: r["seq"])
    spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(1.5).alias("v")).write.parquet(str(tmp_path / "t"))
    assert cli.main(["mutate", "--target", str(tmp_path / "t"), "--key", "k", "--output", str(tmp_path / "o"), "--ratios", "update:50,delete:50", "--count", "60"], spark) == 0
    assert 0 < spark.read.parquet(str(tmp_path / "o")).count() < 100
    R.save_schema(SCHEMA, str(tmp_path / "s.json"))
    assert cli.main(["generate", "--schema", str(tmp_path / "s.json"), "--count", "50", "--output", str(tmp_path / "log"), "--cdc", "insert:50,update:50", "--manifest", str(tmp_path / "m.json")], spark) == 0


def test_draft07(spark):
    """Wrong kinds are violations, never errors; nested, map and combined rules."""
    df = spark.createDataFrame([("notanumber", True, [1, 1], {"a": 1, "b": 300}), (None, None, None, None)], "age string, name boolean, tags array<int>, m map<string,int>")
    schema = {"properties": {"age": {"type": "number", "minimum": 3}, "name": {"type": "string"}, "tags": {"type": "array", "uniqueItems": True, "items": {"oneOf": [{"maximum": 5}, {"minimum": 0}]}}, "m": {"type": "object", "additionalProperties": {"maximum": 200}, "required": ["z"]}}}
    got = [sorted(tuple(v) for v in r[0]) for r in df.select(D.violations(schema, df)).collect()]
    assert got == [[("/age", "type"), ("/m/*", "maximum"), ("/m/z", "required"), ("/name", "type"), ("/tags", "uniqueItems"), ("/tags[]", "oneOf"), ("/tags[]", "oneOf")], []]
    assert D.conformance(df, {"properties": {"age": {"type": "integer"}}}).first()["valid"] == 1
    docs = spark.createDataFrame([('{"a":null,"b":"x"}',), ('{"a":1.5}',), ("[1]",)], "j string").select(F.parse_json("j").alias("v"))
    rule = {"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"enum": ["x", 1]}}, "required": ["b"]}
    assert [sorted(tuple(v) for v in r[0]) for r in docs.select(D.violations_of(F.col("v"), rule)).collect()] == [[], [("/a", "type"), ("/b", "required")], [("", "type")]]


def test_dynamic_structs(spark):
    """Structs wide with made-up keys become maps unless told otherwise, values of several kinds keep them all, and what is made conforms."""
    k = lambda i: "%08x-0000-4000-8000-%012x" % (i, i)
    lines = ["{" + f'"_id":"{i}","m":{{"{k(2 * i)}":{i},"{k(2 * i + 1)}":' + ('"t"' if i % 4 == 0 else "2.5") + '},"s":{"x":1,"y":2}}' for i in range(30)]
    df = spark.read.json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]))
    schema, _ = api.infer(df)
    m = schema["properties"]["m"]["x-dynamic-keys"]
    assert m["pattern"] == "UUID" and m["uniqueKeysObserved"] == 60 and m["countDistribution"] == {"2": 30} and "x" in schema["properties"]["s"]["properties"]
    assert [x["type"] for x in m["valueSchema"]["anyOf"]] and sum(m["valueSchema"]["x-type-probabilities"]) == pytest.approx(1, abs=1e-5)
    for keys in (P.KeyConfig(force_static=("m",)), P.KeyConfig.disabled()):
        assert len(api.infer(df, keys=keys)[0]["properties"]["m"]["properties"]) == 60
    assert "x-dynamic-keys" in api.infer(df, keys=P.KeyConfig(force_dynamic=("s",)))[0]["properties"]["s"]


def test_annotation_layouts(spark):
    values, counts = {"type": "integer", "minimum": 1, "maximum": 3}, {"2": 1}
    layouts = ({"x-dynamic-keys": {"pattern": "ULID", "countDistribution": counts, "valueSchema": values}}, {"x-dynamic-keys": {"enabled": True, "metadata": {"pattern": "ULID", "countDistribution": counts}, "valueSchema": {"schemas": [values]}}}, {"x-dynamic-keys": {"pattern": "ULID", "countDistribution": counts}, "x-dynamic-key-value-schema": values})
    for p in layouts:
        schema = {"properties": {"m": {"type": "object"} | p}}
        made = D.Generator(schema).generate(spark, 20)
        assert made.where((F.size("m") != 2) | F.exists(F.map_values("m"), lambda v: ~v.between(1, 3)) | F.exists(F.map_keys("m"), lambda x: ~S.key_valid(x, "ULID"))).count() == 0
        assert [x for x, _ in D.dynamic_annotations(schema)] == ["m"] and D.conformance(made, schema).first()["rate"] == 1.0
    own = {"properties": {"m": {"type": "object", "x-dynamic-keys": {"pattern": "CUSTOM", "customPattern": "^sku-[0-9]{4}$", "countDistribution": {"3": 1}, "valueSchema": values}}}}
    assert D.Generator(own).generate(spark, 20).where((F.size("m") != 3) | F.exists(F.map_keys("m"), lambda x: ~x.rlike("^sku-[0-9]{4}$"))).count() == 0


def test_id_cache_time():
    """A pick takes the same time in a full cache as in a small one; order of age, not of places, decides what goes."""
    c = live.IdCache(3, ["a", "b", "c"])
    c.remove("a")
    c.add("d")
    c.add("e")
    assert "b" not in c and sorted(c.live) == ["c", "d", "e"]
    big = live.IdCache(200_000, [str(i) for i in range(200_000)])
    for i in range(100_000):
        big.tombstone(big.pick((i * 7919 % 100_000) / 100_000))
    assert len(big.dead) == 100_000 and big.pick(0.3) not in big.dead


def test_narrow_structs_have_no_keys_to_look_at(spark):
    """Structs of too few fields to be dynamic are not gone through, but where a map or a wide struct is above them, or they are forced."""
    wide = ", ".join(f"k{i}: struct<x: int, y: int>" for i in range(12))
    df = spark.createDataFrame([], f"id int, a struct<b: struct<c: int>, l: array<struct<d: int>>>, m map<string, struct<e: int>>, w struct<{wide}>, n array<struct<f: int, w: struct<{wide}>>>")
    assert P.object_keys(df.select("id", "a"), P.KeyConfig()) is None
    assert P.object_keys(df.select("a"), P.KeyConfig(force_dynamic=("a.l[]",))) is not None
    full = df.sparkSession.createDataFrame([(1, ((2,), [(3,)]), {"u": (4,)}, tuple((i, i) for i in range(12)), [(5, tuple((i, i) for i in range(12)))])], df.schema)
    seen = {(r["parent"], r["key"]) for r in P.object_keys(full).collect()}
    kept = {(r["parent"], r["key"]) for r in P.object_keys(full, P.KeyConfig()).collect()}
    assert seen - kept == {("a", "b"), ("a", "l"), ("a.b", "c"), ("a.l[]", "d"), ("n[]", "f"), ("n[]", "w")} and kept < seen
