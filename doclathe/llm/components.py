"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is one aggregation of each node's smallest neighbour and one join with it, both by node and salt, so that a hub's
edges are dealt to SALTS keys; stars shrink until nothing changes. Lineage is cut with a reliable checkpoint each
round, so a lost executor costs one round. Nothing is gathered on the driver but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

SALTS = 64


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows (key, value) with m, the least value of the row's key. A key's rows are split by a salt of their values: the least is merged from at most SALTS
    partial ones and goes back to these salts only, so no task has more than a share of a hot key."""
    salted = rows.select(key, value, F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int").alias("salt"))
    part = salted.groupBy(key, "salt").agg(F.min(value).alias("m"))
    least = part.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).select(key, value, "m")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), distinct. large: link each node's larger neighbours to its smallest; else its smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:  # the edge to the smallest is the node's own link
        out = with_least(edges, "u", "v").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: pairs of long ids, in any order, repeats and loops allowed, nulls ignored. Returns (node, component): each node of
    an edge between two different ids and the smallest id that it reaches. No edges: no rows."""
    a_, b_ = edges[a].cast("long"), edges[b].cast("long")
    e = cut(edges.select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).where((a_ != b_)).distinct())
    while True:
        e = cut(_star(_star(e, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))).alias("e")).select("e.*")
        role = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        # Stars are final when every node has one edge down at most, and none both up and down.
        if not role.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") > 0)))).first()[0]:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
