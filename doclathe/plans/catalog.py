"""Every query of the engine by name, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclathe.functions import scalar as S
from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.sources import readers as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as an array: one co-partitioned shuffle of each table by order key."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    return t(spark, d, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


U_SQL = "(('0x' || substr(md5('42:' || {row} || ':{path}'), 1, 8))::BIGINT / 4294967296.0)"
DIST = """min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, quantile_disc(v, 0.5)::DOUBLE AS median, quantile_disc(v, 0.9)::DOUBLE AS p90,
 quantile_disc(v, 0.95)::DOUBLE AS p95, quantile_disc(v, 0.99)::DOUBLE AS p99, count(*)::BIGINT AS total, count(DISTINCT v)::BIGINT AS "unique" """
NUM = """count(v)::BIGINT AS n, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std_dev,
 bool_and(v = floor(v)) AS is_int, bool_and(v >= 0) AS all_positive"""
NUMP = NUM + ", quantile_disc(v, 0.5)::DOUBLE AS median, quantile_disc(v, 0.9)::DOUBLE AS p90, quantile_disc(v, 0.95)::DOUBLE AS p95, quantile_disc(v, 0.99)::DOUBLE AS p99"
LEN_SQL = "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS v FROM orders"


def per_path(pairs: dict[str, str], what: str) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS path, {what} FROM ({q})" for p, q in pairs.items())


# --- sources -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def sample_random_exact(spark, d):
    return R.random_sample(t(spark, d, "customer"), 100, "c_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def sample_first_n(spark, d):
    return R.first_n(t(spark, d, "orders"), 100, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT event_id, user_id, event_type FROM events, (SELECT min(ts) AS a, max(ts) AS b FROM events)
WHERE ts BETWEEN a AND a + (b - a) / 2 ORDER BY md5('42:' || event_id), event_id LIMIT 200""")
def sample_time_window(spark, d):
    e = t(spark, d, "events")
    a, b = e.agg(F.min("ts"), F.max("ts")).first()
    mid = None if a is None else a + (b - a) / 2
    return R.time_window(e, 200, "event_id", "ts", a, mid).select("event_id", "user_id", "event_type") if a is not None else e.select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS idx FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50)")
def sample_metadata(spark, d):
    s = R.first_n(t(spark, d, "customer").select("c_custkey"), 50, "c_custkey")
    return R.with_metadata(s, "customer", "c_custkey").select("c_custkey", F.col("__metadata.sampleIndex").alias("idx"))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1000")
def id_projection(spark, d):
    return R.ids(t(spark, d, "customer"), "c_custkey", 1000)


@query("SELECT json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events WHERE trim(props) <> '' GROUP BY 1")
def ndjson_fields(spark, d):
    e = t(spark, d, "events").where(F.trim("props") != "").select(F.parse_json("props").alias("doc"))
    return e.groupBy(F.expr("variant_get(doc, '$.k', 'string')").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, true AS typed_alike FROM customer")
def ndjson_round_trip(spark, d):
    """All customers written as NDJSON in files of 1000 lines at most, and read back as variants and as typed columns."""
    from doclathe.sources import writers as W
    from doclathe.sources.paths import scratch

    df = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = scratch(spark, "ndjson")
    W.write_ndjson(df, path, max_records=1000)
    get = lambda f: F.expr(f"variant_get(doc, '$.{f.name}', '{f.dataType.simpleString()}')").alias(f.name)
    loose = R.read_ndjson(spark, path).select(*[get(f) for f in df.schema])
    typed = R.read_documents(spark, path, df.schema)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in df.columns]
    both = loose.alias("a").join(typed.alias("b"), same[0], "full")
    return both.select("a.*", reduce(lambda x, y: x & y, same).alias("typed_alike"))


# --- normalising -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, base64(encode(event_type)) AS event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value,
lower(hex(encode(event_type))) AS _id FROM events""")
def normalize_scalars(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", F.col("event_type").cast("binary").alias("event_type"), F.col("value").cast("decimal(18,2)").alias("value"), F.col("event_type").cast("binary").alias("_id"))
    return D.normalize(e)[0]


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS shipdate FROM lineitem")
def normalize_nested(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_shipdate").alias("line"))
    n = D.normalize(li)[0]
    return n.select("l_orderkey", "line.l_linenumber", F.col("line.l_shipdate").alias("shipdate"))


# --- inference ---------------------------------------------------------------------------------------------------------

PRESENT = {"doc_id": "doc_id", "lang": "lang", "quality": "quality", "toxic": "toxic"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c})::BIGINT AS n, round(count({c}) / count(*), 6) AS probability, round(count({c}) / count(*), 6) >= 0.95 AS required FROM documents LEFT JOIN labels USING (doc_id)" for c in PRESENT))
def schema_presence(spark, d):
    return P.presence(t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left").select(*PRESENT))


@query("SELECT field FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) / count(*) AS p FROM documents LEFT JOIN labels USING (doc_id)" for c in PRESENT) + ") WHERE p >= 0.95")
def schema_required(spark, d):
    return schema_presence(spark, d).where("required").select("field")


@query("""SELECT 'k' AS path, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(json_type(props, '$.k')) END AS typ,
count(*)::BIGINT AS n FROM events WHERE json_type(props, '$.k') IS NOT NULL GROUP BY 1, 2""")
def schema_types_json(spark, d):
    return P.variant_paths(t(spark, d, "events").select("props"), "props").groupBy("path", "typ").agg(F.count("*").alias("n"))


@query("""SELECT 'o_orderkey' AS path, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM orders
UNION ALL SELECT 'lines[].l_quantity', count(l_quantity) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lines[].l_returnflag', count(l_returnflag) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def field_paths(spark, d):
    n = nested(spark, d).select("o_orderkey", F.transform("lines", lambda x: F.struct(x["l_quantity"].alias("l_quantity"), x["l_returnflag"].alias("l_returnflag"))).alias("lines"))
    return P.unnest(n).groupBy("path").agg(F.count("*").alias("n"))


# --- distributions -----------------------------------------------------------------------------------------------------


@query("SELECT l_quantity AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def freq_table(spark, d):
    return P.frequencies(t(spark, d, "lineitem").select(F.col("l_quantity").alias("value")), "value")


@query(f"SELECT l_returnflag AS path, {DIST} FROM (SELECT l_returnflag, l_quantity AS v FROM lineitem) GROUP BY 1")
def distribution_stats(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_quantity").alias("value"))
    return P.distribution(P.frequencies(li, "path", "value"), ["path"])


@query(f"SELECT {DIST} FROM (SELECT l_extendedprice AS v FROM lineitem)")
def distribution_from_freq(spark, d):
    return P.distribution(P.frequencies(t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value")), "value"), [])


@query(f"SELECT 'lines' AS path, {DIST} FROM ({LEN_SQL}) UNION ALL SELECT 'turns', {DIST} FROM (SELECT count(*) AS v FROM conversations GROUP BY conv_id)")
def array_length_stats(spark, d):
    lines = P.unnest(nested(spark, d).select("lines"), kinds=("array",)).select("path", F.col("num").alias("value"))
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("double").alias("value")).select(F.lit("turns").alias("path"), "value")
    return P.distribution(P.frequencies(lines.unionByName(turns), "path", "value"), ["path"])


@query("SELECT len(string_split(text, chr(10)))::INTEGER AS value, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def array_length_hist(spark, d):
    return P.frequencies(t(spark, d, "documents").where("text is not null").select(F.size(F.split("text", "\n")).alias("value")), "value")


@query("SELECT len(embedding)::INTEGER AS value, count(*)::BIGINT AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1")
def embedding_length(spark, d):
    return P.frequencies(t(spark, d, "embeddings").where("embedding is not null").select(F.size("embedding").alias("value")), "value")


@query(per_path({"l_quantity": "SELECT l_quantity AS v FROM lineitem", "l_discount": "SELECT l_discount AS v FROM lineitem", "l_extendedprice": "SELECT l_extendedprice AS v FROM lineitem"}, NUMP)
    + " UNION ALL " + per_path({"c_acctbal": "SELECT c_acctbal AS v FROM customer", "o_totalprice": "SELECT o_totalprice AS v FROM orders"}, NUMP))
def numeric_profile(spark, d):
    parts = [t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), t(spark, d, "customer").select("c_acctbal"), t(spark, d, "orders").select("o_totalprice")]
    out = [P.numeric_profile(P.unnest(p), percentiles=True) for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(per_path({f"lines[].{c}": f"SELECT {c} AS v FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)" for c in ("l_quantity", "l_extendedprice")}, NUM))
def numeric_profile_nested(spark, d):
    n = nested(spark, d).select(F.transform("lines", lambda x: F.struct(x["l_quantity"].alias("l_quantity"), x["l_extendedprice"].alias("l_extendedprice"))).alias("lines"))
    return P.numeric_profile(P.unnest(n).where("kind = 'number'"))


# --- semantic types ----------------------------------------------------------------------------------------------------


def contacts(spark, d):
    c = F.col("c_custkey")
    u = F.md5(c.cast("string"))
    return t(spark, d, "customer").select(
        F.when(c % 10 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("c"), c.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("https://example.com/"), c.cast("string")).alias("website"),
        F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12)).alias("uuid"),
        F.substring(u, 1, 24).alias("owner_id"),
        F.when(c % 2 == 0, F.concat(F.lit("+1-555-123-"), F.lpad((c % 10000).cast("string"), 4, "0"))).otherwise("none").alias("phone"),
        F.col("c_name").alias("name"),
        F.concat_ws(".", F.lit("10"), (c % 256).cast("string"), (c % 7).cast("string"), F.lit("1")).alias("ip_address"),
    )


CONTACTS_SQL = """WITH c AS (SELECT c_custkey AS k, md5(c_custkey::VARCHAR) AS u, c_name FROM customer), x AS (
SELECT CASE WHEN k % 10 = 0 THEN 'nobody' ELSE 'c' || k || '@example.com' END AS email, 'https://example.com/' || k AS website,
 substr(u,1,8) || '-' || substr(u,9,4) || '-' || substr(u,13,4) || '-' || substr(u,17,4) || '-' || substr(u,21,12) AS uuid, substr(u,1,24) AS owner_id,
 CASE WHEN k % 2 = 0 THEN '+1-555-123-' || lpad((k % 10000)::VARCHAR, 4, '0') ELSE 'none' END AS phone, c_name AS name,
 '10.' || (k % 256) || '.' || (k % 7) || '.1' AS ip_address FROM c), m AS (
SELECT 'email' AS path, 'Email' AS detector, 1 AS priority, 0.8::DOUBLE AS confidence, regexp_matches(email, '^[^@]+@[^@]+$') AS hit FROM x
UNION ALL SELECT 'website', 'URL', 2, 0.8, website LIKE 'http%' FROM x
UNION ALL SELECT 'uuid', 'UUID', 3, 0.9, regexp_matches(uuid, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') FROM x
UNION ALL SELECT 'owner_id', 'ObjectID', 3, 0.9, regexp_matches(owner_id, '^[0-9a-f]{24}$') FROM x
UNION ALL SELECT 'phone', 'Phone', 4, 0.7, regexp_matches(phone, '^[+][0-9-]+$') FROM x
UNION ALL SELECT 'name', 'PersonName', 5, 0.6, length(name) BETWEEN 2 AND 50 AND regexp_matches(name, '^[A-Za-z\\s''.-]+$') FROM x
UNION ALL SELECT 'ip_address', 'IPv4', 6, 0.9, regexp_matches(ip_address, '^([0-9]{1,3}[.]){3}[0-9]{1,3}$') FROM x
UNION ALL SELECT 'ip_address', 'IPv6', 7, 0.9, false FROM x), r AS (
SELECT path, detector, priority, confidence, count(*)::BIGINT AS n, count(*) FILTER (hit)::BIGINT AS matches, round(count(*) FILTER (hit) / count(*), 6) AS ratio FROM m GROUP BY ALL) """


@query(CONTACTS_SQL + "SELECT * FROM r")
def semantic_profile(spark, d):
    return P.semantic_profile(P.unnest(contacts(spark, d)))


@query(CONTACTS_SQL + "SELECT path, detector, ratio FROM r WHERE ratio >= confidence QUALIFY row_number() OVER (PARTITION BY path ORDER BY priority, detector) = 1")
def semantic_best_match(spark, d):
    return P.semantic_best(semantic_profile(spark, d))


@query("""WITH p AS (SELECT page_id, url FROM pages WHERE url IS NOT NULL) SELECT 'url' AS path, 'URL' AS detector, count(*)::BIGINT AS n, count(*) FILTER (regexp_matches(url, '^https?://.'))::BIGINT AS matches FROM p""")
def semantic_pages(spark, d):
    return P.semantic_profile(P.unnest(t(spark, d, "pages").select("url"))).select("path", "detector", "n", "matches")


# --- sizes -------------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, (6 + 6 * v)::BIGINT AS leaves FROM ({LEN_SQL})")
def leaf_count(spark, d):
    n = nested(spark, d)
    return n.select("o_orderkey", P.size_proxy(n, "leafFieldCount").alias("leaves"))


@query(f"SELECT o_orderkey, v::BIGINT AS total FROM ({LEN_SQL})")
def array_len_sum(spark, d):
    n = nested(spark, d)
    return n.select("o_orderkey", P.size_proxy(n, "arrayLengthSum").alias("total"))


@query("SELECT n_nationkey, length('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}')::BIGINT AS size FROM nation")
def json_size(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", P.size_proxy(n, "byteSize").alias("size"))


BUCKET_SQL = "SELECT b AS bucket, lo::DOUBLE AS min, hi::DOUBLE AS max, count(size) FILTER (size BETWEEN lo AND hi)::BIGINT AS n, round(count(size) FILTER (size BETWEEN lo AND hi) / count(*), 6) AS probability FROM s, {buckets} GROUP BY ALL"


@query(f"WITH s AS (SELECT 6 + 6 * v AS size FROM ({LEN_SQL})) " + BUCKET_SQL.format(buckets="(VALUES ('small', 0, 10), ('medium', 11, 100), ('large', 101, 1000000)) AS x(b, lo, hi)"))
def size_buckets_fixed(spark, d):
    n = nested(spark, d)
    return P.size_buckets(n.select(P.size_proxy(n, "leafFieldCount").alias("size")))


@query(f"""WITH s AS (SELECT 6 + 6 * v AS size FROM ({LEN_SQL})), e AS (SELECT min(size) AS lo, max(size) AS hi FROM s), c AS (SELECT lo, floor(lo + (hi - lo) * 0.33) AS a, floor(lo + (hi - lo) * 0.67) AS b, hi FROM e),
w AS (SELECT CASE WHEN size <= a THEN 'small' WHEN size <= b THEN 'medium' ELSE 'large' END AS bucket FROM s, c), n AS (SELECT bucket, count(*) AS n FROM w GROUP BY 1),
x AS (SELECT 'small' AS bucket, lo::DOUBLE AS min, a::DOUBLE AS max FROM c UNION ALL SELECT 'medium', a, b FROM c UNION ALL SELECT 'large', b, hi FROM c)
SELECT bucket, min, max, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 6) AS probability FROM x LEFT JOIN n USING (bucket)""")
def size_buckets_auto(spark, d):
    n = nested(spark, d)
    return P.auto_buckets(n.select(P.size_proxy(n, "leafFieldCount").alias("size")))


ENUMS = {"lang": "documents", "source": "documents", "event_type": "events", "o_orderstatus": "orders", "o_orderpriority": "orders", "url": "pages"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c})::BIGINT AS n, count(DISTINCT {c})::BIGINT AS n_unique, count(DISTINCT {c}) <= 50 AND (count(DISTINCT {c}) / count({c}) <= 0.1 OR count(DISTINCT {c}) <= 10) AS is_enum FROM {tb}" for c, tb in ENUMS.items()))
def enum_detection(spark, d):
    out = None
    for c, tb in ENUMS.items():
        one = t(spark, d, tb).agg(F.count(c).alias("n"), F.count_distinct(c).alias("n_unique")).select(F.lit(c).alias("field"), "n", "n_unique")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_enum", P.enum_like(F.col("n_unique"), F.col("n")))


# --- dynamic keys ------------------------------------------------------------------------------------------------------


def keyed(spark, d):
    """doc, path, key: keys of four maps per customer and of one fixed object."""
    o = t(spark, d, "orders")
    k, u = F.col("o_orderkey"), F.md5(F.col("o_orderkey").cast("string"))
    pad = F.lpad(k.cast("string"), 8, "0")
    made = {"by_uuid": F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12)), "by_order": F.concat(F.lit("order_"), pad), "by_number": pad, "by_status": F.col("o_orderstatus")}
    each = F.array(*[F.struct(F.lit(p).alias("path"), c.alias("key")) for p, c in made.items()])
    return o.select(F.col("o_custkey").alias("doc"), F.inline(each))


KEYED_SQL = """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, md5(o_orderkey::VARCHAR) AS u, lpad(o_orderkey::VARCHAR, 8, '0') AS pad, o_orderstatus AS s FROM orders), x AS (
SELECT doc, 'by_uuid' AS path, substr(u,1,8) || '-' || substr(u,9,4) || '-' || substr(u,13,4) || '-' || substr(u,17,4) || '-' || substr(u,21,12) AS key FROM o
UNION ALL SELECT doc, 'by_order', 'order_' || pad FROM o UNION ALL SELECT doc, 'by_number', pad FROM o UNION ALL SELECT doc, 'by_status', s FROM o), k AS (SELECT DISTINCT path, key FROM x), r AS (
SELECT path, count(*)::BIGINT AS n_keys, avg(regexp_matches(key, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')::INT) AS a, avg(regexp_matches(key, '^[0-9]{6,20}$')::INT) AS b, avg(regexp_matches(key, '^(user|doc|item|order)_[a-z0-9]{8,32}$')::INT) AS c FROM k GROUP BY 1), p AS (
SELECT path, n_keys, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a = greatest(a, b, c) THEN 'UUID' WHEN b = greatest(a, b, c) THEN 'NUMERIC_ID' ELSE 'PREFIXED_ID' END AS pattern, round(greatest(a, b, c), 6) AS ratio FROM r) """


@query(KEYED_SQL + "SELECT * FROM p")
def key_pattern_ratio(spark, d):
    return P.key_ratios(keyed(spark, d))


@query(KEYED_SQL + """, n AS (SELECT path, count(DISTINCT doc)::BIGINT AS n_docs FROM x GROUP BY 1), j AS (SELECT * FROM p JOIN n USING (path)), f AS (SELECT *, round(CASE
WHEN n_keys >= 100 AND ratio >= 0.8 THEN least(1.0, ratio + CASE WHEN n_keys / 100 > 2 THEN least(0.1, (n_keys / 100 - 2) * 0.02) ELSE 0 END)
WHEN ratio >= 0.8 THEN least(1.0, ratio + 0.05)
WHEN n_keys >= 100 THEN least(0.9, 0.7 + 0.2 * log10(n_keys / 100)) - CASE WHEN pattern IS NULL AND n_keys / n_docs < 0.1 THEN 0.1 ELSE 0 END ELSE 0 END::DOUBLE, 6) AS confidence FROM j)
SELECT path, n_keys, pattern, ratio, n_docs, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level,
(ratio >= 0.8 OR (n_keys >= 100 AND (pattern IS NOT NULL OR n_docs <= 50 OR n_keys > 500 OR n_keys / n_docs > 0.05))) AND confidence >= 0.7 AS is_dynamic FROM f""")
def dynamic_key_detect(spark, d):
    k = keyed(spark, d)
    return P.detect(P.key_ratios(k).join(k.groupBy("path").agg(F.count_distinct("doc").alias("n_docs")), "path"))


@query("""WITH v AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity = floor(l_quantity) THEN 'integer' ELSE 'number' END WHEN 1 THEN CASE WHEN l_discount = floor(l_discount) THEN 'integer' ELSE 'number' END ELSE 'string' END AS typ FROM lineitem)
SELECT typ, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM v), 6) AS probability FROM v GROUP BY 1""")
def dynamic_value_types(spark, d):
    n = F.col("l_linenumber") % 3
    js = F.when(n == 0, F.to_json(F.struct(F.col("l_quantity").alias("v")))).when(n == 1, F.to_json(F.struct(F.col("l_discount").alias("v")))).otherwise(F.to_json(F.struct(F.col("l_returnflag").alias("v"))))
    v = t(spark, d, "lineitem").select(F.expr("1").alias("one"), js.alias("j"))
    typed = v.select(F.expr("variant_get(parse_json(j), '$.v')").alias("v")).withColumn("raw", F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)).select(F.lit("m.*").alias("path"), P.json_type("v", "raw").alias("typ"))
    return P.value_types(typed).select("typ", "n", "probability")


@query(f"SELECT 'orders' AS path, {DIST} FROM (SELECT count(*) AS v FROM orders GROUP BY o_custkey)")
def dynamic_key_counts(spark, d):
    m = t(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("order_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), "o_totalprice"))).alias("orders"))
    counts = P.unnest(m.select("orders")).where("kind = 'object'").select("path", F.col("num").alias("value"))
    return P.distribution(P.frequencies(counts, "path", "value"), ["path"])


@query("""SELECT 'accounts' AS parent, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'accounts.*', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'accounts.*.*', 2 * count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def dynamic_path_collapse(spark, d):
    """accounts.<order uuid>.<line key>.{qty, flag}: two levels of made-up keys over a fixed object."""
    o, li = t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    u = F.md5(F.col("o_orderkey").cast("string"))
    acc = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12))
    top = o.select(F.col("o_orderkey").alias("doc"), F.lit("accounts").alias("parent"), acc.alias("key"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("acc", acc).withColumn("line", F.format_string("item_%08d%02d", F.col("o_orderkey"), F.col("l_linenumber").cast("int")))
    mid = j.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("accounts."), "acc").alias("parent"), F.col("line").alias("key"))
    low = j.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("accounts."), "acc", F.lit("."), "line").alias("parent"), F.explode(F.array(F.lit("qty"), F.lit("flag"))).alias("key"))
    rows, _ = P.collapse(top.unionByName(mid).unionByName(low), P.KeyConfig(threshold=100))
    return rows.groupBy("parent").agg(F.count("*").alias("n"))


@query("""SELECT path, count(*)::BIGINT AS n FROM (SELECT 'kinds.' || event_type AS path FROM events WHERE event_type IS NOT NULL UNION ALL SELECT 'by_user' FROM events UNION ALL SELECT 'by_user_names.x' FROM events) GROUP BY 1""")
def prune_dynamic_stats(spark, d):
    """Counts by path of events keyed by type and by user; what is nested under the dynamic path goes, a path that only begins alike stays."""
    e = t(spark, d, "events")
    paths = F.array(F.concat(F.lit("kinds."), "event_type"), F.lit("by_user"), F.concat(F.lit("by_user."), F.col("user_id").cast("string")), F.lit("by_user_names.x"))
    stats = e.select(F.explode(paths).alias("path")).where("path is not null").groupBy("path").agg(F.count("*").alias("n"))
    return P.prune(stats, spark.createDataFrame([("by_user",)], "path string"))


def keyed_documents(spark, d):
    """A document per customer: a map of its orders by made-up order key, a map of its spending by status, a plain struct."""
    o, pad = t(spark, d, "orders"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    by_key = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("order_"), pad), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))))
    sums = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("by_status"))
    return o.groupBy("o_custkey").agg(by_key.alias("orders")).join(sums, "o_custkey").select(F.col("o_custkey").alias("_id"), "orders", "by_status", F.struct(F.col("o_custkey").alias("a")).alias("fixed"))


INFER_SQL = """WITH k AS (SELECT count(DISTINCT o_orderkey)::BIGINT AS n FROM orders), s AS (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS names, count(DISTINCT o_orderstatus) AS n FROM orders)
SELECT mode, path, is_dynamic, CASE WHEN is_dynamic AND path = 'orders' THEN 'PREFIXED_ID' WHEN is_dynamic THEN 'CUSTOM' END AS pattern, CASE WHEN is_dynamic THEN CASE path WHEN 'orders' THEN (SELECT n FROM k) ELSE (SELECT n FROM s) END END::BIGINT AS keys,
 CASE WHEN is_dynamic THEN NULL WHEN path = 'by_status' THEN (SELECT names FROM s) WHEN path = 'fixed' THEN 'a' ELSE (SELECT n FROM k) || ' fields' END AS fields
FROM (SELECT * FROM (VALUES ('default', 'orders', true), ('default', 'by_status', false), ('default', 'fixed', false), ('forced', 'orders', true), ('forced', 'by_status', true), ('forced', 'fixed', false)) AS x(mode, path, is_dynamic))"""


@query(INFER_SQL)
def infer_dynamic_keys(spark, d):
    """Inference over documents with made-up keys: by default, and with a path forced to be dynamic."""
    from doclathe.plans.api import dynamic_objects

    docs, out = keyed_documents(spark, d), []
    for mode, keys in (("default", P.KeyConfig()), ("forced", P.KeyConfig(force_dynamic=("by_status",)))):
        shaped, found = dynamic_objects(docs, keys)
        for path in ("orders", "by_status", "fixed"):
            names = getattr(shaped.schema[path].dataType, "names", None)
            r = found.get(path)
            out.append((mode, path, r is not None, r and r["pattern"], r and r["uniqueKeysObserved"], names and ",".join(sorted(names))))
    return spark.createDataFrame(out, "mode string, path string, is_dynamic boolean, pattern string, keys bigint, fields string")


# --- synthesis ---------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT {DIST} FROM ({LEN_SQL})) SELECT 'minmax' AS policy, min::BIGINT AS lo, max::BIGINT AS hi FROM s UNION ALL SELECT 'clamp_25_90', min::BIGINT, p90::BIGINT FROM s UNION ALL SELECT 'clamp_60_99', median::BIGINT, p99::BIGINT FROM s""")
def array_bounds(spark, d):
    """The bounds that synthesis takes from the length statistics, by policy."""
    stats = array_length_stats(spark, d).where("path = 'lines'").first().asDict()
    made = [(p, *D.array_bounds(stats, policy, clamp)) for p, policy, clamp in (("minmax", "minmax", (1, 99)), ("clamp_25_90", "percentileClamp", (25, 90)), ("clamp_60_99", "percentileClamp", (60, 99)))]
    return spark.createDataFrame(made, "policy string, lo bigint, hi bigint")


@query(f"""WITH x AS (SELECT o_orderkey, {U_SQL.format(row='o_orderkey', path='len')} AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 0.5 THEN floor(1 + u / 0.5 * 3) WHEN u < 0.9 THEN floor(3 + (u - 0.5) / 0.4 * 5) ELSE least(12, floor(7 + (u - 0.9) / 0.1 * 6)) END::BIGINT AS length FROM x""")
def recommended_length(spark, d):
    return t(spark, d, "orders").select("o_orderkey", D.recommended_length(S.uniform(42, F.col("o_orderkey"), "len"), 1, 3, 7, 12).alias("length"))


# --- generation --------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {U_SQL.format(row='o_orderkey', path='x')} AS u FROM orders")
def prng_uniform(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.uniform(42, F.col("o_orderkey"), "x").alias("u"))


@query(f"""WITH f AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT value, (sum(n) OVER w - n) / sum(n) OVER () AS lo, sum(n) OVER w / sum(n) OVER () AS hi FROM f WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)),
x AS (SELECT o_orderkey, {U_SQL.format(row='o_orderkey', path='prio')} AS u FROM orders) SELECT o_orderkey, value FROM x JOIN s ON u >= lo AND u < hi""")
def weighted_sample(spark, d):
    o = t(spark, d, "orders")
    rows = o.select("o_orderkey", S.uniform(42, F.col("o_orderkey"), "prio").alias("u"))
    return D.weighted_pick(rows, P.frequencies(o.select(F.col("o_orderpriority").alias("value")), "value")).select("o_orderkey", "value")


SCHEMA = {"type": "object", "properties": {
    "_id": {"type": "string", "format": "uuid"}, "age": {"type": "integer", "minimum": 18, "maximum": 80}, "status": {"type": "string", "enum": ["A", "B", "C"], "x-gen": {"enum": {"A": 50, "B": 30, "C": 20}}},
    "ip": {"type": "string", "format": "ipv4"}, "tags": {"type": "array", "items": {"type": "integer", "minimum": 0, "maximum": 9}, "minItems": 1, "maxItems": 4}}, "required": ["_id", "age"], "additionalProperties": False}


def _h(path: str) -> str:
    return f"md5('42:' || i || ':{path}')"


def _u(path: str) -> str:
    return f"(('0x' || substr({_h(path)}, 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH r AS (SELECT o_orderkey AS i FROM orders), x AS (SELECT i, {_h('_id')} AS d, {_u('age')} AS ua, {_u('status')} AS us, {_h('ip')} AS p, {_u('tags#n')} AS un FROM r)
SELECT i AS o_orderkey, substr(d,1,8) || '-' || substr(d,9,4) || '-4' || substr(d,14,3) || '-a' || substr(d,18,3) || '-' || substr(d,21,12) AS _id, (floor(ua * 63) + 18)::BIGINT AS age,
CASE WHEN us * 100 < 50 THEN 'A' WHEN us * 100 < 80 THEN 'B' ELSE 'C' END AS status,
('0x' || substr(p,1,2))::INT || '.' || ('0x' || substr(p,3,2))::INT || '.' || ('0x' || substr(p,5,2))::INT || '.' || ('0x' || substr(p,7,2))::INT AS ip, (floor(un * 4) + 1)::INTEGER AS n_tags FROM x""")
def generate_documents(spark, d):
    """A made-up document for each order."""
    made = D.Generator(SCHEMA).generate_for(t(spark, d, "orders"), "o_orderkey", keep=("o_orderkey",))
    return made.select("o_orderkey", "_id", "age", "status", "ip", F.size("tags").alias("n_tags"))


@query("""WITH x AS (SELECT i, j, md5('42:' || i || ':k:' || j) AS d FROM (SELECT c_custkey AS i FROM customer), (SELECT range AS j FROM range(1, 4)))
SELECT i AS c_custkey, substr(d,1,8) || '-' || substr(d,9,4) || '-4' || substr(d,14,3) || '-a' || substr(d,18,3) || '-' || substr(d,21,12) AS key FROM x""")
def generate_keys(spark, d):
    """Three made-up keys for each customer."""
    return t(spark, d, "customer").select("c_custkey", F.explode(S.keys("UUID", F.lit(3), 42, F.col("c_custkey"), "k")).alias("key"))


def _digits(at: int) -> str:
    return f"lpad((('0x' || substr(d, {at}, 12))::BIGINT % 100000000)::VARCHAR, 8, '0')"


@query(f"""WITH x AS (SELECT i, j, md5('42:' || i || ':k:' || j) AS d, md5('42:' || i || ':k#t:' || j) AS w FROM (SELECT o_orderkey AS i FROM orders), (SELECT range AS j FROM range(1, 6))),
y AS (SELECT i, unnest(['UUID', 'NUMERIC_ID', 'OBJECTID', 'PREFIXED_ID']) AS pattern, unnest([substr(d,1,8) || '-' || substr(d,9,4) || '-4' || substr(d,14,3) || '-a' || substr(d,18,3) || '-' || substr(d,21,12), {_digits(1)} || {_digits(13)} || lpad(j::VARCHAR, 4, '0'),
 lower(lpad(to_hex(1735689600 - floor(('0x' || substr(w,1,8))::BIGINT / 4294967296.0 * 31536000)::BIGINT), 8, '0')) || substr(d,1,16), ['user', 'doc', 'item', 'order'][floor(('0x' || substr(d,1,8))::BIGINT / 4294967296.0 * 4)::INT + 1] || '_' || substr(d,1,16)]) AS key FROM x)
SELECT pattern, count(*)::BIGINT AS n, count(*) FILTER (CASE pattern WHEN 'UUID' THEN regexp_full_match(key, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') WHEN 'NUMERIC_ID' THEN regexp_full_match(key, '[0-9]{{6,20}}')
 WHEN 'OBJECTID' THEN regexp_full_match(key, '[0-9a-f]{{24}}') ELSE regexp_full_match(key, '(user|doc|item|order)_[a-z0-9]{{8,32}}') END)::BIGINT AS valid, count(DISTINCT key)::BIGINT AS distinct_keys, min(key) AS least, max(key) AS most FROM y GROUP BY 1""")
def validate_keys(spark, d):
    """Five keys of four patterns for every order, as SQL makes them, too: how many match their pattern, and how many differ in all."""
    o = t(spark, d, "orders").select("o_orderkey")
    each = F.array(*[F.struct(F.lit(p).alias("pattern"), S.keys(p, F.lit(5), 42, F.col("o_orderkey"), "k").alias("keys")) for p in ("UUID", "OBJECTID", "NUMERIC_ID", "PREFIXED_ID")])
    k = o.select(F.inline(each)).select("pattern", F.explode("keys").alias("key"))
    ok = reduce(or_, [(F.col("pattern") == p) & S.key_valid(F.col("key"), p) for p in ("UUID", "OBJECTID", "NUMERIC_ID", "PREFIXED_ID")])
    return k.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_distinct("key").alias("distinct_keys"), F.min("key").alias("least"), F.max("key").alias("most"))


@query(f"""WITH f AS (SELECT v, count(*) AS n FROM ({LEN_SQL}) GROUP BY 1), w AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM f), u AS (SELECT i, {_u('lines#n')} AS u FROM (SELECT o_orderkey AS i FROM orders)),
g AS (SELECT i, min(v) AS v FROM u JOIN w ON u * total < upto GROUP BY 1), a AS (SELECT {DIST} FROM ({LEN_SQL})), b AS (SELECT {DIST} FROM g), dv AS (SELECT """ + ", ".join(f"round(CASE WHEN a.{c} = 0 AND b.{c} = 0 THEN 0 WHEN a.{c} = 0 THEN 1 ELSE abs(b.{c} - a.{c}) / a.{c} END, 6)::DOUBLE AS dev_{c}" for c in ("median", "p90", "p99")) + """ FROM a, b)
SELECT 'lines' AS path, *, dev_median <= 0.1 AND dev_p90 <= 0.1 AND dev_p99 <= 0.1 AS passed FROM dv""")
def generated_fidelity(spark, d):
    """Lengths of arrays drawn for each order by the distribution of its lines, against that distribution."""
    n = nested(spark, d).select("lines")
    drawn = {str(int(r["value"])): r["n"] for r in P.frequencies(n.select(F.size("lines").alias("value")), "value").collect()}
    schema = {"properties": {"lines": {"type": "array", "items": {"type": "boolean"}, "minItems": 0, "maxItems": max(map(int, drawn), default=0), "x-array-length-distribution": drawn}}}
    made = D.Generator(schema).generate_for(t(spark, d, "orders"), "o_orderkey")
    return D.compare_arrays(*[D.array_stats(P.unnest(x, kinds=("array",))) for x in (n, made)])


def _below(path: str, n: int) -> str:
    return f"floor({_u(path)} * {n})::BIGINT"


def _word(words: tuple[str, ...], path: str) -> str:
    return f"{list(words)!r}[{_below(path, len(words))} + 1]"


def _format_sql() -> dict[str, str]:
    """What the generator of each format makes of its path's digest, in SQL."""
    h = {f: _h(f"v.{f}") for f in S.FORMATS}
    u, o = h["uuid"], h["objectid"]
    return {
        "objectid": f"lower(lpad(to_hex(1735689600 - {_below('v.objectid#t', 31536000)}), 8, '0')) || substr({o}, 1, 16)",
        "date-time": f"strftime(make_timestamp((1735689600 - {_below('v.date-time', 31536000)}) * 1000000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'",
        "uuid": f"substr({u}, 1, 8) || '-' || substr({u}, 9, 4) || '-4' || substr({u}, 14, 3) || '-a' || substr({u}, 18, 3) || '-' || substr({u}, 21, 12)",
        "decimal": f"({_below('v.decimal', 100000000)} // 100)::VARCHAR || '.' || lpad(({_below('v.decimal', 100000000)} % 100)::VARCHAR, 2, '0')",
        "base64": f"base64(encode(substr({h['base64']}, 1, 16)))",
        "email": f"lower({_word(S.FIRST, 'v.email')}) || substr({h['email']}, 25, 4) || '@' || {_word(S.DOMAINS, 'v.email#d')}",
        "url": f"'https://' || {_word(S.WORDS, 'v.url')} || '.' || {_word(S.DOMAINS, 'v.url#d')} || '/' || substr({h['url']}, 1, 8)",
        "phone": f"'+1-555-' || lpad({_below('v.phone#a', 1000)}::VARCHAR, 3, '0') || '-' || lpad({_below('v.phone', 10000)}::VARCHAR, 4, '0')",
        "person-name": f"{_word(S.FIRST, 'v.person-name')} || ' ' || {_word(S.LAST, 'v.person-name#l')}",
        "ipv4": " || '.' || ".join(f"('0x' || substr({h['ipv4']}, {2 * k + 1}, 2))::INT::VARCHAR" for k in range(4)),
        "ipv6": " || ':' || ".join(f"substr({h['ipv6']}, {4 * k + 1}, 4)" for k in range(8)),
    }


@query("SELECT i AS c_custkey, " + ", ".join(f'{sql} AS "{f}"' for f, sql in _format_sql().items()) + " FROM (SELECT c_custkey AS i FROM customer)")
def generate_formats(spark, d):
    """A value of every format for each customer."""
    schema = {"properties": {"v": {"type": "object", "properties": {f: {"type": "string", "format": f} for f in S.FORMATS}}}}
    registry = S.Registry(paths={})  # formats alone decide, no names of fields
    return D.Generator(schema, registry=registry).generate_for(t(spark, d, "customer"), "c_custkey", keep=("c_custkey",)).select("c_custkey", "v.*")


# --- change logs -------------------------------------------------------------------------------------------------------


@query(f"SELECT i AS seq, CASE WHEN i < 100 THEN 'insert' WHEN {_u('#op')} * 100 < 50 THEN 'insert' WHEN {_u('#op')} * 100 < 90 THEN 'update' ELSE 'delete' END AS op FROM (SELECT event_id AS i FROM events)")
def op_selection(spark, d):
    ratios = D.parse_ratios("insert:50,update:40,delete:10")
    seq = F.col("event_id")
    return t(spark, d, "events").select(seq.alias("seq"), D.select_op(S.uniform(42, seq, "#op"), ratios, seq, 100).alias("op"))


UPDATED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("WITH f AS (SELECT o_orderkey, " + f"(floor({U_SQL.format(row='o_orderkey', path='#fields')} * 3) + 1)::INT AS n, list_sort([" + ", ".join(f"md5('42:' || o_orderkey || ':{c}') || '{c}'" for c in UPDATED) + "]) AS l FROM orders) SELECT o_orderkey, list_aggregate(list_transform(l[1:n], lambda x: substr(x, 33)), 'string_agg', ',') AS fields FROM f")
def partial_update_fields(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.array_join(D.partial_fields(UPDATED, 42, F.col("o_orderkey")), ",").alias("fields"))


_NEW = {"o_custkey": f"{_below('o_custkey', 1001)}::VARCHAR", "o_orderstatus": f"""'"' || CASE WHEN {_u('o_orderstatus')} * 100 < 50 THEN 'F' WHEN {_u('o_orderstatus')} * 100 < 90 THEN 'O' ELSE 'P' END || '"'""", "o_shippriority": f"{_below('o_shippriority', 10)}::VARCHAR"}
_MODES_SQL = "WITH o AS (SELECT o_orderkey AS i, o_custkey, o_orderkey % 7 AS o_shippriority FROM orders), n AS (SELECT *, " + ", ".join(f"{sql} AS new_{c}" for c, sql in _NEW.items()) + f""", {_u('#coin')} < 0.5 AS heads,
 list_transform(list_sort([{', '.join(f"{_h(c)} || '{c}'" for c in _NEW)}])[1:floor({_u('#fields')} * 3)::INT + 1], lambda x: substr(x, 33)) AS chosen FROM o),
 m AS (""" + " UNION ALL ".join(f"""SELECT i, 'regenerate' AS mode, '{c}' AS field, new_{c} AS value FROM n UNION ALL SELECT i, 'partial', '{c}', new_{c} FROM n WHERE list_contains(chosen, '{c}')
 UNION ALL SELECT i, 'mixed', '{c}', new_{c} FROM n WHERE heads OR list_contains(chosen, '{c}')""" for c in _NEW) + """
 UNION ALL SELECT i, 'increment', 'o_custkey', (o_custkey + 1)::VARCHAR FROM n UNION ALL SELECT i, 'increment', 'o_shippriority', (o_shippriority + 1)::VARCHAR FROM n UNION ALL SELECT i, 'touch', 'updatedAt', '"2025-01-01T00:00:00.000Z"' FROM n)
 SELECT mode, field, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS n_values, min(value) AS least, max(value) AS most, (sum(('0x' || substr(md5(i || ':' || value), 1, 8))::BIGINT))::BIGINT AS checksum FROM m GROUP BY 1, 2"""


@query(_MODES_SQL)
def update_modes(spark, d):
    """What every mode of updates sets in every order, by mode and field."""
    gen = D.Generator({"properties": {"_id": {"type": "integer"}, "o_custkey": {"type": "integer"}, "o_orderstatus": {"type": "string", "x-gen": {"enum": {"F": 50, "O": 40, "P": 10}}}, "o_shippriority": {"type": "integer", "maximum": 9}}})
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("i"), "o_custkey", (F.col("o_orderkey") % 7).alias("o_shippriority"))
    now = {c: F.col(c) for c in ("o_custkey", "o_shippriority")}
    each = [F.struct(F.lit(m).alias("mode"), D.mutation(gen, m, F.col("i"), now).alias("sets")) for m in ("regenerate", "partial", "mixed", "increment", "touch")]
    rows = o.select("i", F.inline(F.array(*each))).select("i", "mode", F.explode("sets").alias("field", "json"))
    rows = rows.withColumn("value", F.regexp_extract("json", r'^\{"v":(.*)\}$', 1))
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", "i", "value")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("mode", "field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(mark).alias("checksum"))


def op_log(spark, d):
    """Three operations on some orders, by key: two price updates, then for every 30th a delete, and for every 60th an insert again."""
    o = t(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus")
    up = lambda n, price, status: F.struct((F.col("o_orderkey") * 10 + n).alias("seq"), F.lit("update").alias("op"), price.alias("o_totalprice"), status.cast("string").alias("o_orderstatus"))
    gone = F.when(F.col("o_orderkey") % 30 == 0, F.struct((F.col("o_orderkey") * 10 + 3).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("double").alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderstatus")))
    back = F.when(F.col("o_orderkey") % 60 == 0, F.struct((F.col("o_orderkey") * 10 + 4).alias("seq"), F.lit("insert").alias("op"), F.lit(1.0).alias("o_totalprice"), F.lit("N").alias("o_orderstatus")))
    ops = F.array_compact(F.array(up(1, F.col("o_totalprice") + 1, F.lit(None)), up(2, F.lit(None).cast("double"), F.lit("X")), gone, back))
    return o.select("o_orderkey", F.explode(ops).alias("x")).select("o_orderkey", "x.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 60 = 0 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
CASE WHEN o_orderkey % 60 = 0 THEN 'N' WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 30 <> 0 OR o_orderkey % 60 = 0""")
def apply_change_log(spark, d):
    target = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return D.apply_log(target, op_log(spark, d), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, 1 AS o FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o) = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM a) AS ok FROM b)
SELECT count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS inserted, count(*) FILTER (NOT ok)::BIGINT AS failed FROM r""")
def insert_with_rejects(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    rows = o.withColumn("o", F.lit(1)).unionByName(o.where("o_orderkey % 5 = 0").withColumn("o", F.lit(2)))
    good, bad = D.insert_rows(o.where("o_orderkey % 2 = 0"), rows, "o_orderkey", "o")
    both = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok")))
    return both.agg(F.count("*").alias("total"), F.count_if("ok").alias("inserted"), F.count_if(~F.col("ok")).alias("failed"))


@query("""WITH e AS (SELECT user_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op FROM events) SELECT user_id, arg_max(op, seq) AS op FROM e GROUP BY 1 HAVING arg_max(op, seq) <> 'delete'""")
def id_cache_state(spark, d):
    k = F.col("event_id") % 4
    ops = t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(k == 0, "delete").when(k == 1, "insert").otherwise("update").alias("op"))
    return D.live_keys(ops, "user_id")


# --- validation --------------------------------------------------------------------------------------------------------

ORDER_SCHEMA = {"type": "object", "required": ["_id", "status"], "additionalProperties": False, "properties": {
    "_id": {"type": "integer"}, "status": {"type": "string", "enum": ["F", "O", "P"]}, "price": {"type": "number", "minimum": 0, "maximum": 400000}, "priority": {"type": "string", "maxLength": 10}}}


def flawed(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k.alias("_id"), F.when(k % 11 != 0, F.when(k % 13 == 0, "?").otherwise(F.col("o_orderstatus"))).alias("status"), F.when(k % 17 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("priority"))


FLAWED_SQL = """WITH f AS (SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE o_orderstatus END END AS status, CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS price, o_orderpriority AS priority FROM orders),
v AS (SELECT *, status IS NULL AS v1, coalesce(status NOT IN ('F','O','P'), false) AS v2, coalesce(price < 0, false) AS v3, coalesce(price > 400000, false) AS v4, coalesce(length(priority) > 10, false) AS v5 FROM f) """


@query(FLAWED_SQL + "SELECT count(*)::BIGINT AS total, count(*) FILTER (NOT (v1 OR v2 OR v3 OR v4 OR v5))::BIGINT AS valid, count(*) FILTER (v1 OR v2 OR v3 OR v4 OR v5)::BIGINT AS invalid, round(count(*) FILTER (NOT (v1 OR v2 OR v3 OR v4 OR v5)) / count(*), 6) AS rate FROM v")
def schema_conformance(spark, d):
    return D.conformance(flawed(spark, d), ORDER_SCHEMA)


@query(FLAWED_SQL + "SELECT path, keyword, n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, '{k}' AS keyword, count(*) FILTER ({v})::BIGINT AS n FROM v" for p, k, v in (("/status", "required", "v1"), ("/status", "enum", "v2"), ("/price", "minimum", "v3"), ("/price", "maximum", "v4"), ("/priority", "maxLength", "v5"))) + ") WHERE n > 0")
def schema_violations(spark, d):
    f = flawed(spark, d)
    return f.select(F.inline(D.violations(ORDER_SCHEMA, f))).groupBy("path", "keyword").agg(F.count("*").alias("n"))


STRICT_SCHEMA = {
    "type": "object", "required": ["id", "name"], "minProperties": 4, "properties": {
        "id": {"type": "integer"}, "name": {"type": "string", "pattern": "^[A-Z]", "minLength": 2}, "age": {"type": "number", "exclusiveMinimum": 0, "multipleOf": 1}, "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "minItems": 1},
        "code": {"anyOf": [{"type": "integer", "maximum": 500}, {"type": "string", "maxLength": 4}]}, "kind": {"const": "x"}, "only": {"oneOf": [{"minimum": 100}, {"maximum": 200}]}, "all": {"allOf": [{"type": "number"}, {"not": {"minimum": 900}}]},
        "deep": {"type": "object", "properties": {"ok": {"type": "boolean"}}, "additionalProperties": False}, "map": {"type": "object", "additionalProperties": {"type": "integer"}},
    },
}


def wrong(spark, d):
    """k and JSON text of documents, made from all orders, whose values have the wrong kinds or break a rule by turns."""
    k = F.col("o_orderkey").cast("long")
    m = lambda mod, yes, no: F.when(k % mod == 0, F.lit(yes)).otherwise(F.lit(no))
    doc = F.concat(
        F.lit('{"id":'), F.when(k % 2 == 0, k.cast("string")).when(k % 3 == 0, F.lit('"one"')).otherwise(F.lit("1.5")), m(7, "", ',"name":"Bob"'), F.lit(',"age":'), (k % 3).cast("string"), m(5, ".5", ""),
        F.lit(',"tags":'), m(4, "[]", '["a","b"]'), F.lit(',"code":'), (k % 1000).cast("string"), F.lit(',"kind":'), m(9, '"y"', '"x"'), F.lit(',"only":'), (k % 300).cast("string"), F.lit(',"all":'), (k % 1000).cast("string"),
        F.lit(',"deep":{"ok":'), m(8, "1", "true"), m(6, ',"more":2', ""), F.lit('},"map":{"a":1,"b":'), m(10, '"c"', "2"), F.lit("}}"),
    )
    return t(spark, d, "orders").select(k.alias("k"), doc.alias("json"))


BROKEN = (
    ("/id", "type", "k % 2 <> 0"), ("/name", "required", "k % 7 = 0"), ("/age", "exclusiveMinimum", "k % 3 = 0 AND k % 5 <> 0"), ("/age", "multipleOf", "k % 5 = 0"), ("/tags", "minItems", "k % 4 = 0"), ("/code", "anyOf", "k % 1000 > 500"), ("/kind", "const", "k % 9 = 0"),
    ("/only", "oneOf", "k % 300 BETWEEN 100 AND 200"), ("/all", "not", "k % 1000 >= 900"), ("/deep/ok", "type", "k % 8 = 0"), ("/deep/more", "additionalProperties", "k % 6 = 0"), ("/map/*", "type", "k % 10 = 0"),
)


@query("SELECT path, keyword, n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, '{w}' AS keyword, count(*) FILTER ({c})::BIGINT AS n FROM (SELECT o_orderkey AS k FROM orders)" for p, w, c in BROKEN) + ") WHERE n > 0")
def json_violations(spark, d):
    """Documents of any kind against a schema: each keyword's violations counted."""
    docs = wrong(spark, d).select(F.parse_json("json").alias("doc"))
    return docs.select(F.inline(D.violations_of(F.col("doc"), STRICT_SCHEMA))).groupBy("path", "keyword").agg(F.count("*").alias("n"))


TYPED_SCHEMA = {"type": "object", "properties": {"c_name": {"type": "integer"}, "c_acctbal": {"type": "integer"}, "c_custkey": {"type": "number", "exclusiveMaximum": 100}, "c_mktsegment": {"type": "string", "pattern": "^[A-M]", "enum": ["BUILDING", "MACHINERY", "FURNITURE", 3]}, "c_nationkey": {"type": ["string", "null"], "minimum": 3}, "none": {"type": "string"}}, "required": ["none"]}


@query("SELECT path, keyword, n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, '{w}' AS keyword, count(*) FILTER ({c})::BIGINT AS n FROM customer" for p, w, c in (
    ("/c_name", "type", "c_name IS NOT NULL"), ("/c_acctbal", "type", "c_acctbal <> floor(c_acctbal)"), ("/c_custkey", "exclusiveMaximum", "c_custkey >= 100"), ("/c_mktsegment", "pattern", "c_mktsegment >= 'N'"),
    ("/c_mktsegment", "enum", "c_mktsegment NOT IN ('BUILDING','MACHINERY','FURNITURE')"), ("/c_nationkey", "type", "c_nationkey IS NOT NULL"), ("/c_nationkey", "minimum", "c_nationkey < 3"), ("/none", "required", "true"))) + ") WHERE n > 0")
def typed_violations(spark, d):
    """Rules of one kind over columns of another: an integer rule over texts is a violation of each, not an error."""
    c = t(spark, d, "customer")
    return c.select(F.inline(D.violations(TYPED_SCHEMA, c))).groupBy("path", "keyword").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c})::BIGINT AS total, count(DISTINCT {c})::BIGINT AS \"unique\", (count({c}) - count(DISTINCT {c}))::BIGINT AS duplicates FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_linenumber")))
def key_uniqueness(spark, d):
    return D.uniqueness(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"])


def halves(spark, d):
    n = nested(spark, d).select("o_orderkey", "lines")
    return n.where("o_orderkey % 2 = 0"), n.where("o_orderkey % 2 = 1")


HALF_SQL = f"WITH l AS ({LEN_SQL}), a AS (SELECT {DIST} FROM l WHERE o_orderkey % 2 = 0), b AS (SELECT {DIST} FROM l WHERE o_orderkey % 2 = 1), dv AS (SELECT " + ", ".join(f"round(CASE WHEN a.{c} = 0 AND b.{c} = 0 THEN 0 WHEN a.{c} = 0 THEN 1 ELSE abs(b.{c} - a.{c}) / a.{c} END, 6)::DOUBLE AS dev_{c}" for c in ("median", "p90", "p99")) + " FROM a, b) "


@query(HALF_SQL + "SELECT 'lines' AS path, *, dev_median <= 0.1 AND dev_p90 <= 0.1 AND dev_p99 <= 0.1 AS passed FROM dv")
def compare_array_lengths(spark, d):
    return D.compare_arrays(*[D.array_stats(P.unnest(h.select("lines"), kinds=("array",))) for h in halves(spark, d)])


BUCKET_CMP = f"WITH l AS (SELECT o_orderkey % 2 AS h, 1 + 6 * v AS size FROM ({LEN_SQL})), bk AS (SELECT * FROM (VALUES ('small', 0, 10), ('medium', 11, 100), ('large', 101, 1000000)) AS x(b, lo, hi)), p AS (SELECT b, h, round(count(*) FILTER (size BETWEEN lo AND hi) / count(*), 6) AS p FROM l, bk GROUP BY ALL), c AS (SELECT b AS bucket, max(p) FILTER (h = 0) AS expected, max(p) FILTER (h = 1) AS actual FROM p GROUP BY 1), dv AS (SELECT *, round(CASE WHEN expected = 0 AND actual = 0 THEN 0 WHEN expected = 0 THEN 1 ELSE abs(actual - expected) / expected END, 6)::DOUBLE AS deviation FROM c) "


@query(BUCKET_CMP + "SELECT *, deviation <= 0.2 AS passed FROM dv")
def compare_size_buckets(spark, d):
    return D.compare_buckets(*[P.size_buckets(h.select(P.size_proxy(h, "leafFieldCount").alias("size"))) for h in halves(spark, d)])


@query(BUCKET_CMP + f", s AS (SELECT bool_and(deviation <= 0.2) AS sizes FROM dv), ar AS ({HALF_SQL} SELECT dev_median <= 0.1 AND dev_p90 <= 0.1 AND dev_p99 <= 0.1 AS arrays FROM dv), o AS (SELECT bool_and(o_orderkey >= 0 AND o_orderkey IS NOT NULL) AS conforms, count(o_orderkey) = count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderkey % 2 = 1) SELECT 'conforms' AS check_name, conforms AS passed FROM o UNION ALL SELECT 'arrays', arrays FROM ar UNION ALL SELECT 'sizes', sizes FROM s UNION ALL SELECT 'keys', keys FROM o UNION ALL SELECT 'overall', arrays AND sizes AND conforms AND keys FROM ar, s, o")
def validation_report(spark, d):
    """Orders of odd keys as if they were made like those of even keys."""
    from doclathe.plans.api import validate

    sample, made = halves(spark, d)
    r = validate(sample, made, {"properties": {"o_orderkey": {"type": "integer", "minimum": 0}}, "required": ["o_orderkey"]}, ("o_orderkey",))
    checks = {
        "conforms": r["schemaConformance"]["invalid"] == 0, "arrays": all(x["passed"] for x in r["arrayLengthComparison"]), "sizes": all(x["passed"] for x in r["documentSizeComparison"]),
        "keys": all(x["duplicates"] == 0 for x in r["keyUniqueness"]), "overall": r["passed"],
    }
    return spark.createDataFrame(list(checks.items()), "check_name string, passed boolean")


# --- change logs with presence, skipped operations and outcomes ---------------------------------------------------------

LOG_SQL = """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders), log AS (
 SELECT k, 1 AS seq, 'update' AS op, NULL::DOUBLE AS price, NULL AS status, 'price' AS present FROM o WHERE k % 3 = 0 UNION ALL
 SELECT k, 2, 'update', NULL, 'X', NULL FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 3, 'frob', 7.0, 'Z', 'price,status' FROM o WHERE k % 7 = 0 UNION ALL
 SELECT k, 4, 'delete', NULL, NULL, NULL FROM o WHERE k % 11 = 0 UNION ALL SELECT k, 5, 'update', 9.0, NULL, NULL FROM o WHERE k % 22 = 0 UNION ALL
 SELECT k, 6, 'insert', 1.0, NULL, NULL FROM o WHERE k % 33 = 0 UNION ALL SELECT k, 7, 'update', NULL, status, 'status' FROM o WHERE k % 13 = 0 UNION ALL
 SELECT -k - 1, 8, 'delete', NULL, NULL, NULL FROM o WHERE k % 4 = 0 UNION ALL SELECT -k - 1, 9, 'update', 1.0, NULL, NULL FROM o WHERE k % 6 = 0) """


def presence_log(spark, d):
    """(target, log): updates that set null, of unknown kinds, of keys that are gone or never were, and an insert after a delete."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    none = F.lit(None)
    op = lambda when, key, seq, op, price=none, status=none, present=none: F.when(when, F.struct(key.alias("k"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), price.cast("double").alias("price"), status.cast("string").alias("status"), present.cast("string").alias("present")))
    k, x = F.col("k"), F.lit
    ops = [
        op(k % 3 == 0, k, 1, "update", present=x("price")), op(k % 5 == 0, k, 2, "update", status=x("X")), op(k % 7 == 0, k, 3, "frob", x(7.0), x("Z"), x("price,status")), op(k % 11 == 0, k, 4, "delete"), op(k % 22 == 0, k, 5, "update", x(9.0)),
        op(k % 33 == 0, k, 6, "insert", x(1.0)), op(k % 13 == 0, k, 7, "update", status=F.col("status"), present=x("status")), op(k % 4 == 0, -k - 1, 8, "delete"), op(k % 6 == 0, -k - 1, 9, "update", x(1.0)),
    ]
    return o, o.select(F.inline(F.array_compact(F.array(*ops)))).withColumn("present", F.split("present", ","))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 33 = 0 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
CASE WHEN o_orderkey % 13 = 0 THEN o_orderstatus WHEN o_orderkey % 33 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 33 = 0""")
def apply_log_with_presence(spark, d):
    target, log = presence_log(spark, d)
    return D.apply_log(target, log, "k", ["price", "status"], present="present")


@query(LOG_SQL + """, c AS (SELECT l.*, o.price AS p0, o.status AS s0, o.k IS NOT NULL AS t0, l.k % 5 = 0 AS u2, l.k % 11 = 0 AS gone, l.k % 33 = 0 AS back FROM log l LEFT JOIN o ON l.k = o.k)
SELECT op, CASE WHEN op = 'frob' THEN 'skipped' WHEN op = 'insert' THEN 'inserted' WHEN NOT t0 OR seq = 5 OR (seq = 7 AND gone AND NOT back) THEN 'unmatched' WHEN op = 'delete' THEN 'deleted'
 WHEN seq = 1 AND p0 IS NOT NULL OR seq = 2 AND s0 <> 'X' OR seq = 7 AND (CASE WHEN back THEN NULL WHEN u2 THEN 'X' ELSE s0 END) IS DISTINCT FROM status THEN 'modified' ELSE 'matched' END AS outcome, count(*)::BIGINT AS n
FROM c GROUP BY 1, 2""")
def change_outcomes(spark, d):
    target, log = presence_log(spark, d)
    return D.log_outcomes(target, log, "k", ["price", "status"], present="present").groupBy("op", "outcome").agg(F.count("*").alias("n"))


# --- more of JSON Schema ------------------------------------------------------------------------------------------------

REF_SCHEMA = {
    "definitions": {"tree": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/definitions/tree"}}}, "required": ["v"]}, "short": {"$id": "#short", "maxLength": 3}},
    "type": "object", "properties": {
        "obj": {"enum": [{"y": 1, "x": [2, {"b": 1, "a": 2}]}, [1, 2]]}, "num": {"const": {"n": 1.0}}, "set": {"type": "array", "uniqueItems": True}, "tree": {"$ref": "#/definitions/tree"}, "name": {"$ref": "#short"},
        "card": {"type": "object", "dependencies": {"number": ["owner"], "owner": {"properties": {"number": {"minimum": 10}}}}}, "keys": {"type": "object", "propertyNames": {"minLength": 2, "enum": ["aa", "b", "cc"]}}, "it's": {"type": "integer"},
    },
}


def referring(spark, d):
    k = F.col("o_orderkey").cast("long")
    m = lambda mod, yes, no: F.when(k % mod == 0, F.lit(yes)).otherwise(F.lit(no))
    doc = F.concat(
        F.lit('{"obj":'), m(3, '{"x":[2.0,{"a":2,"b":1}],"y":1}', '{"y":1,"x":[2,{"b":1}]}'), F.lit(',"num":'), m(4, '{"n":1}', '{"n":1,"m":2}'), F.lit(',"set":'), m(5, '[{"a":1,"b":"1.0"},{"b":"1.0","a":1.0}]', '[{"a":1,"b":"1.0"},{"a":1,"b":"1"},1,"1"]'),
        F.lit(',"tree":{"v":1,"kids":[{"v":'), m(6, '"x"', "2"), F.lit(',"kids":[{"kids":['), m(7, '{"v":true}', ""), F.lit(']}]}]},"name":"'), m(8, "long", "abc"), F.lit('","card":{'), m(9, '"number":5', '"number":20'), m(2, ',"owner":2', ""),
        F.lit('},"keys":{'), m(10, '"b":1', '"aa":1'), F.lit("},\"it's\":"), m(12, '"z"', "1"), F.lit("}"),
    )
    return t(spark, d, "orders").select(k.alias("k"), doc.alias("json"))


REFERRED = (
    ("/obj", "enum", "k % 3 <> 0"), ("/num", "const", "k % 4 <> 0"), ("/set", "uniqueItems", "k % 5 = 0"), ("/tree/kids[]/v", "type", "k % 6 = 0"), ("/tree/kids[]/kids[]/v", "required", "true"), ("/tree/kids[]/kids[]/kids[]/v", "type", "k % 7 = 0"),
    ("/name", "maxLength", "k % 8 = 0"), ("/card", "dependencies", "k % 2 <> 0"), ("/card/number", "minimum", "k % 9 = 0 AND k % 2 = 0"), ("/keys", "propertyNames", "k % 10 = 0"), ("/it's", "type", "k % 12 = 0"),
)


@query("SELECT path, keyword, n FROM (" + " UNION ALL ".join(f"SELECT '{p.replace(chr(39), chr(39) * 2)}' AS path, '{w}' AS keyword, count(*) FILTER ({c})::BIGINT AS n FROM (SELECT o_orderkey AS k FROM orders)" for p, w, c in REFERRED) + ") WHERE n > 0")
def reference_violations(spark, d):
    """References, values compared as JSON has it, dependencies and rules of names: each keyword's violations counted."""
    docs = referring(spark, d).select(F.parse_json("json").alias("doc"))
    return docs.select(F.inline(D.violations_of(F.col("doc"), REF_SCHEMA))).groupBy("path", "keyword").agg(F.count("*").alias("n"))


# --- streams and variants -----------------------------------------------------------------------------------------------


def in_batches(df: DataFrame, merged, key: str, n: int = 3) -> DataFrame:
    """The merged state of df fed as n micro-batches, the last one twice, as after a restart."""
    for i in [*range(n), n - 1]:
        merged.update(df.where(F.pmod(F.col(key), F.lit(n)) == i), i)
    return merged.read()


@query(per_path({"user_id": "SELECT user_id AS v FROM events", "value": "SELECT value AS v FROM events", "props.k": "SELECT (props::JSON ->> '$.k')::DOUBLE AS v FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"}, NUMP))
def stream_profile(spark, d):
    """Numeric profile of a stream of events, from states that micro-batches leave."""
    from doclathe.operators import state as St
    from doclathe.sources.paths import scratch
    from doclathe.streaming.profile import profile

    events = t(spark, d, "events").select("event_id", "user_id", "value", F.parse_json("props").alias("props"))
    state = in_batches(events, profile(spark, scratch(spark, "profile"), compact=3), "event_id")
    return St.numeric(state.where("path <> 'event_id'"))


SHAPED = "SELECT event_id AS i, event_type AS e, value AS v FROM events"


@query(f"""WITH s AS ({SHAPED}), p AS (
 SELECT 'doc' AS path, 'object' AS typ, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::BOOLEAN AS required UNION ALL
 SELECT 'doc.kind', 'string', min(length(e)), max(length(e)), true FROM s UNION ALL
 SELECT 'doc.n', 'integer', min(i), max(i), count(*) >= 0.95 * (SELECT count(*) FROM s) FROM s WHERE i % 3 <> 0 UNION ALL
 SELECT 'doc.n', 'string', min(length(e)), max(length(e)), false FROM s WHERE i % 3 = 0 UNION ALL
 SELECT 'doc.deep', 'object', NULL, NULL, count(*) FILTER (i % 10 <> 0) >= 0.95 * count(*) FROM s UNION ALL
 SELECT 'doc.deep.v', 'number', min(v), max(v), true FROM s WHERE i % 10 <> 0 UNION ALL
 SELECT 'doc.deep.tags', 'array', 1, 2, true FROM s HAVING count(*) > 0 UNION ALL
 SELECT 'doc.deep.tags[]', 'object', NULL, NULL, NULL UNION ALL SELECT 'doc.deep.tags[].w', 'boolean', NULL, NULL, true)
SELECT path, typ, lo, hi, CASE WHEN path = 'doc.n' THEN true ELSE required END AS required FROM p""")
def variant_value_schema(spark, d):
    """The schema of documents of any shape, made from all events: types, bounds and lengths of each path, and what is required."""
    from doclathe.operators import state as St

    i = F.col("event_id")
    tag = F.lit('{"w":true}')
    doc = F.concat(
        F.lit('{"kind":"'), F.col("event_type"), F.lit('","n":'), F.when(i % 3 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(i.cast("string")),
        F.when(i % 10 != 0, F.concat(F.lit(',"deep":{"v":'), F.col("value").cast("string"), F.lit(',"tags":['), F.when(i % 2 == 0, F.concat(tag, F.lit(","), tag)).otherwise(tag), F.lit("]}"))).otherwise(""), F.lit("}"),
    )
    facts = St.facts(St.state_of(t(spark, d, "events").select(F.parse_json(doc).alias("doc"))).cache())
    rows = []

    def tell(path: str, p: dict, required: bool | None) -> None:
        for x in p.get("anyOf", [p]):
            lo, hi = next(((x[a], x[b]) for a, b in (("minimum", "maximum"), ("minLength", "maxLength"), ("minItems", "maxItems")) if a in x), (None, None))
            rows.append((path, x["type"], lo if lo is None else float(lo), hi if hi is None else float(hi), required))
            for k, v in x.get("properties", {}).items():
                tell(f"{path}.{k}", v, k in x["required"])
            if "items" in x:
                tell(path + "[]", x["items"], None)

    tell("doc", St.variant_schema(facts, "doc"), None)
    return spark.createDataFrame(rows, "path string, typ string, lo double, hi double, required boolean")


@query(FLAWED_SQL + ", r AS (" + " UNION ALL ".join(f"SELECT _id AS key, '{p}' AS path, '{k}' AS keyword FROM v WHERE {v}" for p, k, v in (("/status", "required", "v1"), ("/status", "enum", "v2"), ("/price", "minimum", "v3"), ("/price", "maximum", "v4"), ("/priority", "maxLength", "v5")))
    + """), l AS (SELECT key, path, keyword FROM r ORDER BY 1, 2, 3 LIMIT 100)
SELECT 'docs' AS section, NULL::BIGINT AS key, NULL AS path, 'total' AS keyword, count(*)::BIGINT AS n FROM v UNION ALL SELECT 'docs', NULL, NULL, 'invalid', count(DISTINCT key) FROM r
UNION ALL SELECT 'rule', NULL, path, keyword, count(*) FROM r GROUP BY path, keyword UNION ALL SELECT 'listed', key, path, keyword, 1 FROM l""")
def stream_report(spark, d):
    """Validation of a stream of orders: running counts and the first hundred violations by key."""
    from doclathe.sources.paths import scratch
    from doclathe.streaming.profile import report

    return in_batches(flawed(spark, d), report(spark, scratch(spark, "report"), ORDER_SCHEMA, "_id", worst=100, compact=3), "_id")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def stream_sample(spark, d):
    """The sample of a stream is that of all its rows."""
    from doclathe.sources.paths import scratch
    from doclathe.streaming.profile import sample

    return in_batches(t(spark, d, "customer"), sample(spark, scratch(spark, "sample"), 100, "c_custkey", compact=3), "c_custkey")


# --- whole schemas -----------------------------------------------------------------------------------------------------


def schema_rows(p: dict, path: str = "", required: bool = True) -> list[tuple]:
    """(path, type, format, source_type, lo, hi, fewest, most, drawn, n_enum, required): what a schema says of each path, from the top down. drawn: the weights of its lengths, or of its enumerated values, in all."""
    gen, lengths = p.get("x-gen", {}), p.get("x-array-length-distribution")
    drawn = sum((lengths or gen.get("enum") or {}).values()) or None
    lo, hi = (None if p.get(k) is None else float(p[k]) for k in ("minimum", "maximum"))
    out = [(path, p.get("type"), p.get("format"), gen.get("sourceType"), lo, hi, p.get("minItems"), p.get("maxItems"), drawn, len(p["enum"]) if "enum" in p else None, required)]
    for k, v in p.get("properties", {}).items():
        out += schema_rows(v, f"{path}.{k}" if path else k, k in p.get("required", []))
    return out + (schema_rows(p["items"], path + "[]") if "items" in p else [])


def _number(col: str, table: str, path: str) -> str:
    return f"SELECT '{path}' AS path, CASE WHEN bool_and({col} = floor({col})) THEN 'integer' ELSE 'number' END AS type, NULL AS format, NULL AS source_type, min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, NULL::INT AS fewest, NULL::INT AS most, NULL::BIGINT AS drawn, NULL::INT AS n_enum, true AS required FROM {table}"


def _text(col: str, table: str, path: str, fmt: str = "NULL", source: str = "NULL") -> str:
    few = f"count(DISTINCT {col}) <= 50 AND (count(DISTINCT {col}) / count({col}) <= 0.1 OR count(DISTINCT {col}) <= 10)"
    return f"SELECT '{path}', 'string', {fmt}, {source}, NULL, NULL, NULL, NULL, CASE WHEN {few} THEN count({col})::BIGINT END, CASE WHEN {few} THEN count(DISTINCT {col})::INT END, true FROM {table}"


_OWN = "(SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"


@query(" UNION ALL ".join([
    *[_number(c, "orders", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")], *[_text(c, "orders", c) for c in ("o_orderstatus", "o_orderpriority")],
    _text("o_orderdate", "orders", "o_orderdate", "'date-time'", "'Date'"), *[_number(c, _OWN, f"lines[].{c}") for c in ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")], _text("l_returnflag", _OWN, "lines[].l_returnflag"),
    f"SELECT 'lines', 'array', NULL, NULL, NULL, NULL, min(v)::INT, max(v)::INT, count(*)::BIGINT, NULL, true FROM ({LEN_SQL})", "SELECT '', 'object', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true", "SELECT 'lines[]', 'object', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true",
]))
def inferred_schema(spark, d):
    """The generation schema of all orders with their lines, a row for each path."""
    schema, _ = P_infer(nested(spark, d))
    return spark.createDataFrame(schema_rows(schema), "path string, type string, format string, source_type string, lo double, hi double, fewest int, most int, drawn bigint, n_enum int, required boolean")


# --- without SQL for comparison ----------------------------------------------------------------------------------------


@query()
def infer_generate_validate(spark, d):
    """The whole round: profile orders with lines, synthesise a schema, generate documents, count those that conform."""
    n = nested(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("lines.l_quantity").alias("quantities"))
    schema, _ = P_infer(n)
    made = D.Generator(schema).generate(spark, 5000)
    return D.conformance(made, schema)


def P_infer(df: DataFrame):
    from doclathe.plans.api import infer

    return infer(df)
