"""Cleaning pipeline over `documents`: language ID, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

STAGES: (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe.llm import bpe, exact, langid, mixing, simhash
from doclathe.llm.registry import rank_file
from doclathe.llm.runtime import cut, fresh, scratch

#: Below this calibrated probability of the best language a document is rejected, as is one without letters.
MIN_SCORE = 0.3
#: The flattest mix in which no source is passed over more often than this.
REPEAT = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language learned from the labelled ones. The text decides; labels only train."""
    model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    lang, score = fresh(docs, "__lang", "__score")
    scored = langid.predict(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return scored.where((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs, keep="min")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (cosine similarity of five-word shingles of 0.8 or more) the document with the smallest id stays."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return _near(docs, "doc_id")
    # Null or repeated ids: rows are numbered in the order of their ids, null last, and told apart by number.
    rows = cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")))
    row = fresh(docs, "__row")[0]
    return _near(cut(rows.withColumn(row, F.monotonically_increasing_id())), row).drop(row)


def _near(docs: DataFrame, key: str) -> DataFrame:
    found = simhash.similar(docs, key, shingle=5, similarity=0.8, measure="cosine")
    lost = cut(found.where("node <> component").select(F.col("node").alias(fresh(docs, "__id")[0])).distinct())
    return exact.without(docs, [docs[key]], lost)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of sources below their target weight occur again."""
    return mixing.mix(docs, repeat=REPEAT)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, rank_file(), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_to_targets),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the classifier nor the byte pair merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
