"""Profiles, inference and samples of streams: states that are merged, never recomputed.

A micro-batch adds one small table (its profile state, or its sample) under its number; every `compact` batches the tables since the last base are merged to a new base. So a batch
costs its own size, and a read costs a base and a few tables. A batch that is run again, after a failure or a restart, replaces its table or, if
that is already in a base, is skipped: each document counts once. All is in a folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe.operators import documents as D
from doclathe.operators import profile as P
from doclathe.operators import state as St
from doclathe.sources import paths as Fs


class Merged:
    """Tables of micro-batches, and their merge. of: a batch's table; merge: one table of several."""

    def __init__(self, spark: SparkSession, folder: str, of: Callable[[DataFrame], DataFrame], merge: Callable[..., DataFrame], compact: int = 8):
        self.spark, self.folder, self.of, self.merge, self.compact = spark, folder.rstrip("/"), of, merge, compact

    def _done(self, kind: str) -> list[int]:
        """Numbers of complete tables: the commit marker is written last."""
        at = f"{self.folder}/{kind}"
        return [int(n) for n in Fs.names(self.spark, at) if n.isdigit() and Fs.exists(self.spark, f"{at}/{n}/_SUCCESS")]

    def _at(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/{n:012d}"

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        base = max(self._done("base"), default=-1)
        if batch_id <= base:
            return
        self.of(batch).write.mode("overwrite").parquet(self._at("delta", batch_id))
        deltas = [n for n in self._done("delta") if n > base]
        if len(deltas) >= self.compact:
            self.read(batch_id).write.mode("overwrite").parquet(self._at("base", batch_id))
            # The base before this one stays until the next, for readers that have begun.
            for kind, upto in (("delta", base), ("base", base - 1)):
                for n in self._done(kind):
                    if n <= upto:
                        Fs.remove(self.spark, self._at(kind, n))

    def read(self, upto: int | None = None) -> DataFrame:
        """The merge of all batches (up to a number)."""
        base = max(self._done("base"), default=-1)
        parts = ([self._at("base", base)] if base >= 0 else []) + [self._at("delta", n) for n in self._done("delta") if n > base and (upto is None or n <= upto)]
        if not parts:
            raise ValueError(f"no batch has been seen: {self.folder}")
        return self.merge(*[self.spark.read.parquet(p) for p in parts])

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any):
        """The running query; trigger: as for writeStream.trigger()."""
        writer = stream.writeStream.foreachBatch(lambda batch, n: self.update(batch, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def profile(spark: SparkSession, folder: str, config: P.KeyConfig | None = None, compact: int = 8) -> Merged:
    """The profile state of a stream of documents; read() gives it, for operators.state and api.infer_state."""
    return Merged(spark, folder, lambda batch: St.state_of(D.normalize(batch)[0], config), St.merge, compact)


def sample(spark: SparkSession, folder: str, n: int, key: str, seed: int | str = 42, compact: int = 8) -> Merged:
    """The n documents of least hash, the same as readers.random_sample() of all of them. Ties of equal keys are broken by the whole row."""

    def least(df: DataFrame) -> DataFrame:
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
        return df.orderBy(h, key, F.xxhash64(F.struct(*df.columns))).limit(n)

    return Merged(spark, folder, least, lambda *parts: least(reduce(DataFrame.unionByName, parts)), compact)


def report(spark: SparkSession, folder: str, schema: dict[str, Any], key: str, worst: int = 1000, compact: int = 8) -> Merged:
    """Conformance of a stream: `total`, `invalid`, counts by path and keyword, and of the violations the `worst` with the least key, path and keyword, however the stream is cut and partitioned.

    Rows: section (docs, rule, listed), key, path, keyword, n."""
    none = F.lit(None).cast("string")

    def of(batch: DataFrame) -> DataFrame:
        broken = batch.select(F.col(key).alias("key"), D.violations(schema, batch).alias("v"))
        docs = broken.agg(F.count("*").alias("total"), F.count_if(F.size("v") > 0).alias("invalid")).select(F.expr("stack(2, 'total', total, 'invalid', invalid) AS (keyword, n)"))
        each = broken.select("key", F.inline("v"))
        rules = each.groupBy("path", "keyword").agg(F.count("*").alias("n"))
        listed = each.orderBy("key", "path", "keyword").limit(worst)
        typ = batch.schema[key].dataType
        parts = [
            docs.select(F.lit("docs").alias("section"), F.lit(None).cast(typ).alias("key"), none.alias("path"), "keyword", "n"),
            rules.select(F.lit("rule").alias("section"), F.lit(None).cast(typ).alias("key"), "path", "keyword", "n"),
            listed.select(F.lit("listed").alias("section"), "key", "path", "keyword", F.lit(1).cast("long").alias("n")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def merge(*parts: DataFrame) -> DataFrame:
        both = reduce(DataFrame.unionByName, parts)
        listed = both.where("section = 'listed'").orderBy("key", "path", "keyword").limit(worst)
        return both.where("section <> 'listed'").groupBy("section", "key", "path", "keyword").agg(F.sum("n").alias("n")).unionByName(listed)

    return Merged(spark, folder, of, merge, compact)
