"""Exact dedup by 128-bit content hash.

Rows are grouped by a 128-bit hash of the normalised text (A-Z lowered); in each group the row with the smallest id stays (or the
largest, with keep="max"). Only hashes, never texts, are grouped; partial aggregation reduces a hot group to one row per task.
Then the texts of hashes that occur twice or more are compared byte by byte with the kept row's text; rows that differ
(collisions) are grouped again, by hash and whole text, so that no collision ever drops a document.

Defined results: null is the empty text. Rows of equal text and equal id are all in the group:
`kept` is true for the row whose id is keep_id; where several rows share that id, the one that the hash of its other columns orders first
isn't distinguishable, so all of them count as kept rows in the digest, while dedup() drops repeats of the same id and text. Null ids
are never kept unless every row of the group has a null id. Empty tables give no rows; other columns pass dedup() unchanged.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, fresh


def normalised(text: Column) -> Column:
    """A-Z lowered, null as empty. lower() has a fast path for ASCII texts, for which it is the same."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min", hasher: Callable[[Column], Column] = hash128, small: int = 2_000_000) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    small: up to so many repeated hashes (24 bytes each) are broadcast to select the texts to compare; beyond it they are joined."""
    best = F.min if keep == "min" else F.max
    d = df.select(df[id_col].alias("id"), normalised(df[text]).alias("norm"))
    keys = cut(d.select("id", hasher(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")))
    size = keys.groupBy("h").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    twice = cut(size.where("n > 1"))
    chosen = F.broadcast(twice) if twice.count() <= small else twice
    met = d.select("id", "norm", hasher(F.col("norm")).alias("h")).join(chosen.select("h", "keep_id"), "h")
    # The kept row's text; should colliding rows share the kept id, any one of their texts serves, the others are told apart below.
    # Written out, one text a group, so that the join's skewed side can be split.
    first = cut(met.where("id <=> keep_id").groupBy("h").agg(F.min("norm").alias("kept_norm")))
    other = met.join(first, "h").where("norm <> kept_norm").select("id", "h", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    other = cut(other)
    named = keys.join(chosen, "h", "left").select("id", "h", "sha", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    if not other.isEmpty():
        # Collisions: every text of such a hash by itself.
        bad = other.select("h").distinct()
        own = met.join(bad, "h", "left_semi").groupBy("h", "norm").agg(best("id").alias("keep2"), F.count("*").alias("n2"))
        own = own.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep2", "n2")
        named = named.join(own, ["h", "sha"], "left").select("id", "h", "sha", F.coalesce("keep2", "keep_id").alias("keep_id"), F.coalesce("n2", "n").alias("n"))
    return named.select(F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min", small: int = 2_000_000) -> DataFrame:
    """The rows of df that stay, all columns; of rows equal in id and (normalised) text, one. Rows are told apart by id and text, so null and repeated ids lose no other text."""
    g = cut(groups(df, id_col, text, keep, small=small))
    id_, sha_ = fresh(df, "__id", "__sha")
    lost = cut(g.where("not kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(sha_)).distinct())
    again = g.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1").limit(1).count()
    sha = F.sha2(normalised(df[text]).cast("binary"), 256)
    out = without(df, [df[id_col], sha], lost, small)
    return out.withColumn(sha_, sha).dropDuplicates([id_col, sha_]).drop(sha_) if again else out


def without(df: DataFrame, keys: list[Column], lost: DataFrame, small: int = 2_000_000) -> DataFrame:
    """df's rows whose keys aren't in the columns of `lost`, whose names df doesn't have; up to `small` rows are broadcast, so that texts stay where they are, beyond that joined."""
    same = [key.eqNullSafe(F.col(name)) for key, name in zip(keys, lost.columns, strict=True)]
    return df.join(F.broadcast(lost) if lost.count() <= small else lost, same, "left_anti")
