"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, html, langid, lexical, mixing, packing, passages, secrets, simhash, turns, vectors, warc
from .runtime import drop_path, scratch, store, table


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", "fingerprint", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"), keep="max")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"), least=50)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents"), entropy=0.5)
    return p.select("doc_id", "source", "n_tokens", F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"), "copies")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, deduplicated = scratch(spark, "warc-in"), scratch(spark, "warc-out")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), raw)
    warc.dedup_archives(spark, raw, deduplicated)
    drop_path(spark, raw)
    page = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("bigint")
    return warc.resolved(spark, deduplicated).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), rank_file(), outputs=("n_tokens", "ids_le", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = store(turns.paths(table(spark, sf_dir, "conversations")), "paths")
    c = F.col("conv_id")
    return turns.trie(turns.with_heads(own, own.where("conv_id % 20 = 0"), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, most=3))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary_file(), longest=4096), tokens=4096)


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS n_tokens FROM documents
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY source
), a AS (
  SELECT list(tokens::DOUBLE ORDER BY tokens) AS ts, sum(tokens)::DOUBLE AS total FROM s WHERE tokens > 0
), p AS (
  SELECT ts, total, list_transform(ts, lambda t: t / total) AS ps FROM a
), goal AS (
  SELECT ps, e1 + (ln(len(ps)::DOUBLE) - e1) * 0.5 AS goal FROM (SELECT ps, -list_sum(list_transform(ps, lambda q: q * ln(q))) AS e1 FROM p)
), b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps, goal FROM goal
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, ps, goal FROM (
    SELECT *, ln(list_sum(list_transform(ps, lambda q: pow(q, mid)))) - mid * list_sum(list_transform(ps, lambda q: pow(q, mid) * ln(q))) / list_sum(list_transform(ps, lambda q: pow(q, mid))) >= goal AS ok
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 60))
), x AS (
  SELECT round((lo + hi) / 2, 9) AS exponent FROM b WHERE i = 60
), z AS (
  SELECT exponent, total, list_sum(list_transform(ps, lambda q: pow(q, exponent))) AS z, ts[-1] AS tmax, ps[-1] AS pmax FROM x, p
), w AS (
  SELECT s.source, s.tokens, z.exponent, CASE WHEN tokens > 0 THEN pow(tokens / total, exponent) / z.z ELSE 0.0 END AS weight,
    CASE WHEN tokens > 0 THEN round(tmax * z.z / pow(pmax, exponent) * (pow(tokens / total, exponent) / z.z), 3) ELSE 0.0 END AS quota
  FROM s, z
), q AS (
  SELECT *, CASE WHEN tokens > 0 THEN floor(quota / tokens + 1e-9)::BIGINT ELSE 1 END AS passes FROM w
), r AS (
  SELECT d.*, q.exponent, q.weight, q.passes, CASE WHEN q.tokens > 0 THEN greatest(q.quota - q.passes * q.tokens, 0.0) ELSE 0.0 END AS rest,
    md5('42:' || q.passes || ':' || d.doc_id) AS o
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, source, n_tokens, round(exponent, 6) AS exponent, round(weight, 6) AS weight,
  passes + CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS copies
FROM r
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY 1
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY 1
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""

OP9_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY x) AS keep FROM d
)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""

OP11_SQL = """
WITH q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), qt AS (
  SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), g AS (
  SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g WHERE term IN (SELECT term FROM qt) GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_simhash_near_dedup, op3_language_id, op4_exact_dedup, op5_substring_dedup, op6_mixing, op7_html_extraction, op8_embedding_near_dedup, op9_warc_revisits, op10_byte_bpe, op11_lexical_search, op12_prefix_trie, op13_best_fit_packing)}
SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op8_embedding_near_dedup": OP8_SQL, "op9_warc_revisits": OP9_SQL, "op11_lexical_search": OP11_SQL}
