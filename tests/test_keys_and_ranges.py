"""Keys by regular expression at any depth, ranges of text, source types."""

import re

import pytest
from pyspark.sql import functions as F

from doclathe.functions import scalar as S
from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.plans import api

PATTERNS = [r"^sku-[0-9]{4}$", r"^(?:ab|c[d-f]|x)+\d?$", r"[^a-z0-9]{3}", r"^user_(\w{2,5}|[A-F0-9]{8})$", r"a*b?c{2}", r"^.{5}$", r"(a|b)(c|d){2,3}\.x\z"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_texts_match_their_pattern(spark, pattern):
    make = S.regex_text(pattern)
    got = [r[0] for r in spark.range(300).select(make(1, F.col("id"), "p")).collect()]
    assert all(re.search(pattern.replace(r"\z", r"\Z"), x) for x in got) and len(set(got)) > 5
    assert spark.range(300).select(make(1, F.col("id"), "p").rlike(pattern).alias("ok")).where("not ok").count() == 0


def test_unreadable_patterns_fall_back():
    for pattern in ("(", r"(?=x)y", r"(a)\1"):
        with pytest.raises(ValueError):
            S.regex_text(pattern)


def test_keys_by_pattern_inside_arrays(spark):
    own = lambda pattern, n: {"type": "object", "x-dynamic-keys": {"pattern": "CUSTOM", "customPattern": pattern, "countDistribution": {str(n): 1}, "valueSchema": {"type": "integer"}}}
    schema = {"properties": {
        "a": {"type": "array", "minItems": 2, "maxItems": 2, "items": own(r"^k-[a-z]{6}$", 3)},
        "deep": {"type": "array", "minItems": 1, "maxItems": 1, "items": {"type": "array", "minItems": 2, "maxItems": 2, "items": own(r"^(x|y)[0-9]{5}$", 2)}},
        "few": own(r"^[ab]$", 5), "bad": own("(", 2),
    }}
    rows = D.Generator(schema, 7).generate(spark, 40).collect()
    inside = [k for r in rows for m in r["a"] for k in m]
    assert len(inside) == 240 and all(re.fullmatch("k-[a-z]{6}", k) for k in inside) and len(set(inside)) > 235
    assert all(re.fullmatch("[xy][0-9]{5}", k) for r in rows for xs in r["deep"] for m in xs for k in m)
    for r in rows:  # two texts only: digits after them; keys of an object always differ
        assert len(r["few"]) == 5 and {"a", "b"} >= {k for k in r["few"] if len(k) == 1} and len(r["bad"]) == 2
    assert D.Generator(schema, 7).generate(spark, 40, 3).collect() == rows


def test_ranges_of_text_are_even(spark):
    texts = spark.range(5000).select(F.lit("p").alias("path"), F.format_string("https://example.com/%07d/page", F.col("id") * 13 % 5003).alias("value")).unionByName(spark.createDataFrame([("q", "only"), ("q", None)], "path string, value string"))
    freq = P.frequencies(texts, "path", "value")
    cuts = {r["path"]: r["cuts"] for r in P.text_cuts(freq, ["path"], "value", 64).collect()}
    values = sorted(r["value"] for r in freq.where("path = 'p'").collect())
    size = [0] * 64
    for v in values:
        size[sum(c < v for c in cuts["p"])] += 1
    assert max(size) <= 2 * len(values) / 64, "no range is above twice the mean"
    got = {r["value"]: r["upto"] for r in P.running(freq, ["path"]).where("path = 'p'").collect()}
    assert got == {v: i + 1 for i, v in enumerate(values)}


def test_source_types(spark):
    df = spark.createDataFrame([(bytearray(b"\x01" * 12), 1)] * 30, "_id binary, n int").select("_id", "n", F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit("1.50").cast("decimal(9,2)").alias("price"))
    p = api.infer(df)[0]["properties"]
    assert {k: v.get("x-gen", {}).get("sourceType") for k, v in p.items()} == {"_id": "ObjectId", "n": None, "at": "Date", "price": "Decimal"}


def test_weighted_pick_takes_the_first_value_whose_running_share_is_above(spark):
    from doclathe.operators import documents as D

    us = [0.0, 1 / 1024, 0.2499999, 0.25, 0.5, 0.7499, 0.999999, 1 - 2**-40]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i long, u double")
    for freq in ([("a", 1), ("b", 1), ("c", 2)], [("x", 7)], [(f"v{i:05d}", 1 + i % 3) for i in range(5000)]):
        table = spark.createDataFrame(freq, "value string, n bigint")
        total, want = sum(n for _, n in freq), {}
        for i, u in enumerate(us):
            run = 0
            for v, n in sorted(freq):
                run += n
                if u < run / total:
                    want[i] = v
                    break
        assert {r["i"]: r["value"] for r in D.weighted_pick(rows, table).collect()} == want
    empty = D.weighted_pick(rows, spark.createDataFrame([], "value string, n bigint")).collect()
    assert len(empty) == len(us) and all(r["value"] is None for r in empty)


def test_documents_for_rows_depend_on_the_row_alone(spark):
    from doclathe.operators import documents as D

    gen = D.Generator({"properties": {"_id": {"type": "string", "format": "uuid"}, "xs": {"type": "array", "items": {"type": "integer"}, "minItems": 0, "maxItems": 3}}})
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (3, "again")], "k long, name string")
    made = {r["name"]: (r["_id"], r["xs"]) for r in gen.generate_for(rows, "k", keep=("name",)).collect()}
    assert made == {r["name"]: (r["_id"], r["xs"]) for r in gen.generate_for(rows.repartition(3), "k", keep=("name",)).collect()}
    assert made["c"] == made["again"] and len({made[x][0] for x in ("a", "c", "n")}) == 3
    assert made["a"] == tuple(gen.generate(spark, 2).collect()[1])
    assert gen.generate_for(rows.limit(0), "k").count() == 0
