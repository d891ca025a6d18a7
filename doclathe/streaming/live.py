"""Change streams: a rate-driven operation feed over a bounded set of live ids, applied in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doclathe.functions import scalar as S
from doclathe.operators import documents as D


class IdCache:
    """A bounded set of live ids: adding revives a tombstone, a full cache lets the oldest go. Every step, a pick too, takes the same time at any size."""

    def __init__(self, size: int = 100_000, ids: list[str] | None = None, dead: list[str] | None = None):
        self.size = size
        self.age: dict[str, None] = dict.fromkeys(ids or [])  # in order of insertion
        self.dead = set(dead or []) & set(self.age)
        self.open = [k for k in self.age if k not in self.dead]  # what can be picked, in any order
        self.place = {k: i for i, k in enumerate(self.open)}

    def _close(self, key: str) -> None:
        """Take a key from the pickable ones: the last one moves to its place."""
        i = self.place.pop(key, None)
        if i is not None:
            last = self.open.pop()
            if last != key:
                self.open[i], self.place[last] = last, i

    def _reopen(self, key: str) -> None:
        if key not in self.place:
            self.place[key] = len(self.open)
            self.open.append(key)

    def add(self, key: str) -> None:
        self.dead.discard(key)
        if key not in self.age:
            if len(self.age) >= self.size:
                self.remove(next(iter(self.age)))
            self.age[key] = None
        self._reopen(key)

    def remove(self, key: str) -> bool:
        if key not in self.age:
            return False
        del self.age[key]
        self.dead.discard(key)
        self._close(key)
        return True

    def tombstone(self, key: str) -> None:
        if key in self.age:
            self.dead.add(key)
            self._close(key)

    def pick(self, u: float) -> str | None:
        return self.open[int(u * len(self.open))] if self.open else None

    @property
    def live(self) -> list[str]:
        return list(self.age)

    def __len__(self) -> int:
        return len(self.age)

    def __contains__(self, key: str) -> bool:
        return key in self.age


OPS = "seq long, shard int, op string, key string"
STATE = "ids array<string>, dead array<string>"


def _replay(cache: IdCache, shard: int, rows: pd.DataFrame, on_delete: str) -> pd.DataFrame:
    """Choose the id of each operation in order; what finds no id to change becomes an insert."""
    out = []
    rows = rows.sort_values("seq")
    for seq, op, u, fresh in zip(rows["seq"].tolist(), rows["op"].tolist(), rows["u"].tolist(), rows["fresh"].tolist(), strict=True):
        target = None
        if op != "insert":
            target = cache.pick(u)
            if target is None:
                op = "insert"
        if op == "insert":
            target = fresh
            cache.add(target)
        elif op == "delete":
            if on_delete == "remove":
                cache.remove(target)
            elif on_delete == "tombstone":
                cache.tombstone(target)
        out.append((seq, shard, op, target))
    return pd.DataFrame(out, columns=["seq", "shard", "op", "key"])


def _advance(on_delete: str, cache_size: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = IdCache(cache_size, *(list(x) for x in state.get)) if state.exists else IdCache(cache_size)
        out = _replay(cache, key[0], pd.concat(list(chunks)), on_delete)
        state.update((cache.live, sorted(cache.dead)))
        yield out

    return step


def requests(rows: DataFrame, ratios: dict[str, float], seed: int | str = 42, shards: int = 8, seq: str = "value", warm_up: int = 0) -> DataFrame:
    """seq, shard, op, u, fresh: what each operation asks for, before ids are chosen."""
    s = F.col(seq)
    return rows.select(s.alias("seq"), (s % shards).cast("int").alias("shard"), D.select_op(S.uniform(seed, s, "#op"), ratios, s, warm_up).alias("op"), S.uniform(seed, s, "#pick").alias("u"), S.FORMATS["objectid"](seed, s, "_id").alias("fresh"))


def change_stream(stream: DataFrame, ratios: dict[str, float], seed: int | str = 42, shards: int = 8, on_delete: str = "remove", cache_size: int = 100_000, warm_up: int = 0) -> DataFrame:
    """Operations with live targets. Ids are sharded like the operations, so each shard's cache is its own keyed state."""
    asked = requests(stream, ratios, seed, shards, warm_up=warm_up)
    return asked.groupBy("shard").applyInPandasWithState(_advance(on_delete, cache_size), OPS, STATE, "append", GroupStateTimeout.NoTimeout)


def change_log(spark: SparkSession, total: int, ratios: dict[str, float], ids: DataFrame | None = None, gen: D.Generator | None = None, mode: str = "mixed", seed: int | str = 42, shards: int | None = None, on_delete: str = "remove", cache_size: int = 100_000, warm_up: int = 0) -> DataFrame:
    """A bounded log of `total` operations: seq, shard, op, key and, with a generator, set (field to JSON text; all fields of an insert, by `mode` for an update).

    ids (one column): keys that exist before. Operations and keys are dealt to shards of at most about 100 000 operations, each simulated in order."""
    shards = shards or max(1, -(-total // 100_000))
    asked = requests(spark.range(total).withColumnRenamed("id", "value"), ratios, seed, shards, warm_up=warm_up)

    def simulate(key: tuple, ops: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        cache = IdCache(cache_size, sorted(known["key"].astype(str)))
        return _replay(cache, int(key[0]), ops, on_delete)

    known = (ids if ids is not None else spark.createDataFrame([], "key string")).toDF("key").where("key is not null").select(F.col("key").cast("string").alias("key"))
    known = known.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key")
    known = known.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("key"))).where(F.col("r") <= cache_size).drop("r")  # no task gets more than its cache holds
    log = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(simulate, OPS)
    if gen is None:
        return log
    new, changed = D.mutation(gen, "regenerate", F.col("seq")), D.mutation(gen, mode, F.col("seq"))
    return log.withColumn("set", F.when(F.col("op") == "insert", new).when(F.col("op") == "update", changed))


def rate_source(spark: SparkSession, per_second: int, partitions: int | None = None) -> DataFrame:
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second)
    return (r.option("numPartitions", partitions) if partitions else r).load()


def apply_batches(stream: DataFrame, read, write, key: str, cols: list[str], checkpoint: str):
    """Start a query that applies each micro-batch of a log to a target; read() and write(df, batch) bind the target."""

    def one(batch: DataFrame, number: int) -> None:
        write(D.apply_log(read(), batch, key, cols), number)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one).start()
