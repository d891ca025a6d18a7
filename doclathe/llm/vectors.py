"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors of a label become one node with a weight. Each tree splits space by random directions at medians of a bounded sample (`sample_rows`
for the first levels, then as many of each leaf that is still large, fitted where the leaf is; every row is indexed), until leaves are near `leaf` rows at any size of the table; rows
within a margin of a split go down both sides. A node that a split would hardly divide, since most rows are within the margin, stays whole. Pairs are compared inside leaves, in double precision, within equal labels only. A leaf with more than `block` nodes
is cut into blocks whose pairs are compared apart, so that no task holds a whole hot leaf and none is left out. A pair that shares several leaves
counts in the first only, told from the leaf codes that travel with each row; so links are counted where they are found and never expanded into a
table of pairs. Components come from a spanning forest of each block.

The margin is 0.7 standard deviations of a linked pair's distance along a random direction; a split parts a pair at the threshold with about 1 %
chance, four trees all part it with a chance under 1 in 1000 at the depths used here. Recall against brute force is measured in the tests (1.0 there).

Defined results: null vectors or labels, empty or zero vectors, null or non-finite components link with nothing: n_links 0, component_id the own id. Vectors of different length never link. Rows with a null id
are counted as links of others by their vector. Repeated rows are links of each other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, groups, ship
from .simhash import forest as spanning


def directions(seed: int, tree: int, root: int, depth: int, dim: int) -> np.ndarray:
    """Random unit vectors of the inner nodes below a tree's node `root`, in heap order: known from their place alone."""
    dirs = np.random.default_rng([seed, tree, root]).standard_normal(((1 << depth) - 1, dim))
    return dirs / np.linalg.norm(dirs, axis=1, keepdims=True)


def fit(sample: np.ndarray, dirs: np.ndarray, margin: float) -> np.ndarray:
    """Thresholds of inner nodes in heap order: medians of the sample; infinite where a split would send most rows both ways."""
    cuts = np.full(len(dirs), np.inf)
    at = np.zeros(len(sample), np.int64)
    for node in range(len(dirs)):
        own = np.flatnonzero(at == node)
        proj = sample[own] @ dirs[node]
        if len(proj) > 1:
            middle = np.median(proj)
            if np.mean(np.abs(proj - middle) < margin) <= 0.5:
                cuts[node] = middle
        at[own] = 2 * node + 1 + (proj >= cuts[node])
    return cuts


def leaves(v: np.ndarray, dirs: np.ndarray, cuts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of its leaf from the left) of unit vectors; near a split a row goes both ways."""
    depth = (len(dirs) + 1).bit_length() - 1
    row, at = np.arange(len(v)), np.zeros(len(v), np.int64)
    for _ in range(depth):
        gap = np.einsum("ij,ij->i", v[row], dirs[at]) - cuts[at]
        left, right = gap < margin, gap >= -margin
        row, at = np.concatenate((row[left], row[right])), np.concatenate((2 * at[left] + 1, 2 * at[right] + 2))
    return row, at - ((1 << depth) - 1)


def units(vec: pa.Array, dim: int) -> np.ndarray:
    v = np.array(vec.flatten().to_numpy()).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


#: A leaf's code is its tree's number above its path, a 1 followed by its turns.
PATH = 50


def deepen(coded: DataFrame, step: int, dim: int, leaf: int, sample_rows: int, margin: float, seed: int) -> DataFrame | None:
    """coded (label, dim, node, m, vec, codes) with its large leaves split by up to `step` more levels, or None if there are no large ones.

    Each large leaf is fitted on about sample_rows of its rows in the task that they are dealt to; rows meet their leaf's thresholds by a join."""
    spread = coded.where(F.col("dim") == dim).select("node", "label", "vec", F.explode("codes").alias("code"))
    large = cut(spread.groupBy("code", "label").count().groupBy("code").agg(F.max("count").alias("most"), F.sum("count").alias("n")).where(F.col("most") > 2 * leaf).drop("most"))
    if large.isEmpty():
        return None
    chance = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n")) * (1 << 30)
    chosen = spread.join(large, "code").where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < chance).select("code", "vec").repartition("code").sortWithinPartitions("code")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["code"]):
            code = g.column("code")[0].as_py()
            depth = min(step, max(1, int(log2(max(2, len(g) / 32)))))
            cuts = fit(units(g.column("vec").combine_chunks(), dim), directions(seed, code >> PATH, code & ((1 << PATH) - 1), depth, dim), margin)
            yield pa.RecordBatch.from_arrays([pa.array([code]), pa.array([cuts.tolist()], pa.list_(pa.float64()))], names=["code", "cuts"])

    cuts = cut(chosen.mapInArrow(train, "code long, cuts array<double>"))
    dealt = spread.select("node", "code", "vec").join(cuts, "code", "left").sortWithinPartitions("code")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, known = b.column("code").to_numpy(), b.column("cuts").is_valid().to_numpy(zero_copy_only=False)
            node = b.column("node").to_numpy()
            out = [(node[~known], code[~known])]
            for c in np.unique(code[known]).tolist():
                own = np.flatnonzero(code == c)
                t = np.asarray(b.column("cuts")[int(own[0])].values)
                row, lf = leaves(units(b.column("vec").take(pa.array(own)), dim), directions(seed, c >> PATH, c & ((1 << PATH) - 1), (len(t) + 1).bit_length() - 1, dim), t, margin)
                path = (c & ((1 << PATH) - 1)) << ((len(t) + 1).bit_length() - 1)
                out.append((node[own[row]], (c >> PATH << PATH) | path + lf))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["node", "code"])

    again = dealt.mapInArrow(split, "node long, code long").groupBy("node").agg(F.array_sort(F.collect_set("code")).alias("new"))
    return coded.join(again, "node", "left").select("label", "dim", "node", "m", "vec", F.coalesce("new", "codes").alias("codes"))


def near_dedup(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, trees: int = 4, leaf: int = 512, block: int = 1024, sample_rows: int = 20_000, seed: int = 42, small: int = 1_000_000) -> DataFrame:
    """id, n_links, component_id, kept. small: leaf counts up to so many rows are broadcast, beyond it joined."""
    spark = df.sparkSession
    ship(spark)
    vec = df[vector].cast("array<double>")
    fine = F.coalesce(df[label].isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(df[id_col].alias("id"), F.when(fine, df[label].cast("string")).alias("label"), F.when(fine, vec).alias("vec"))
    ok = rows.where("vec is not null")
    nodes = cut(ok.groupBy("label", "vec").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("m")).where("node is not null").withColumn("dim", F.size("vec")))
    biggest = nodes.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count"), F.max("dim")).first()
    if biggest[0] is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    rate = min(1.0, sample_rows / biggest[1])
    # Trees are fitted on vectors of the usual length; others get a forest of no depth: one leaf per label.
    dim = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    got = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < rate * (1 << 30))).select("node", F.col("vec").cast("array<float>").alias("vec")).orderBy("node").toArrow()
    sample = np.array(got["vec"].to_pylist(), np.float64).reshape(-1, dim)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    margin = 0.7 * (2 - 2 * threshold) ** 0.5 / dim**0.5
    want = ceil(log2(max(1, biggest[0] / leaf)))
    depth = max(0, min(want, int(log2(max(1, len(sample) / 32)))))
    first = [fit(sample, directions(seed, k, 1, depth, dim), margin) for k in range(trees)]
    planted = spark.sparkContext.broadcast(first)  # size set by sample_rows, not by the table

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dirs = [directions(seed, k, 1, depth, dim) for k in range(trees)]
        for b in batches:
            n = len(b)
            if not n:
                continue
            dims = b.column("dim").to_numpy()
            usual, other = np.flatnonzero(dims == dim), np.flatnonzero(dims != dim)
            at, code = [other], [np.full(len(other), -1)]
            if len(usual):
                v = units(b.column("vec").take(pa.array(usual)), dim)
                for k, cuts in enumerate(planted.value):
                    r, lf = leaves(v, dirs[k], cuts, margin)
                    at.append(usual[r])
                    code.append(k << PATH | 1 << depth | lf)
            at_, code_ = np.concatenate(at), np.concatenate(code)
            order = np.lexsort((code_, at_))
            at_, code_ = at_[order], code_[order]
            ends = np.searchsorted(at_, np.arange(n + 1))
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code_))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("label", "dim", "node", "m", "vec")] + [codes], names=["label", "dim", "node", "m", "vec", "codes"])

    coded = cut(nodes.select("label", "dim", "node", "m", "vec").mapInArrow(assign, "label string, dim int, node long, m long, vec array<double>, codes array<long>"))
    while depth < want:  # a table too large for the first sample's depth
        step = min(want - depth, max(1, int(log2(max(2, sample_rows / 32)))))
        if (deeper := deepen(coded, step, dim, leaf, sample_rows, margin, seed)) is None:
            break
        coded, depth = cut(deeper), depth + step
    spread = coded.select("*", F.explode("codes").alias("code"))
    key = ["label", "dim", "code"]
    size = coded.select("label", "dim", F.explode("codes").alias("code")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    size = cut(size)
    met = spread.join(F.broadcast(size) if size.count() <= small else size, key)
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    met = met.select(*key, "node", "m", "vec", "codes", "own", F.explode(pair).alias("p")).select(*key, "p.i", "p.j", "own", "node", "m", "vec", "codes")
    dealt = met.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: pa.Table) -> pa.RecordBatch | None:
            n = len(t)
            if n < 2:
                return None
            code, i, j = (t.column(c)[0].as_py() for c in ("code", "i", "j"))
            node, m, own = (t.column(c).to_numpy() for c in ("node", "m", "own"))
            v = np.array(t.column("vec").combine_chunks().flatten().to_numpy()).reshape(n, -1)
            s = np.abs(v).max(axis=1, keepdims=True)
            v = v / s  # scaled, so that no square over- or underflows
            norm = np.sqrt((v * v).sum(axis=1))
            link = (v @ v.T) / (norm[:, None] * norm[None, :]) >= threshold
            np.fill_diagonal(link, False)
            if i != j:
                link &= own[:, None] != own[None, :]
            if not link.any():
                return None
            codes = t.column("codes").combine_chunks()
            flat, where = codes.flatten().to_numpy(), np.repeat(np.arange(n), np.diff(codes.offsets.to_numpy()))
            early = flat < code
            known, place = np.unique(flat[early], return_inverse=True)
            first = link
            if len(known):
                has = np.zeros((n, len(known)), np.float32)
                has[where[early], place] = 1
                first = link & (has @ has.T == 0)
            count = first @ m
            words = -(-n // 64)
            bits = np.zeros((n, words * 64), np.uint8)
            bits[:, :n] = link
            bits[np.arange(n), np.arange(n)] = 1
            found = spanning(np.packbits(bits, axis=1, bitorder="little").view("<u8"), n)
            a, b = np.array(found).reshape(-1, 2).T
            some = np.flatnonzero(count)
            cols = [np.concatenate((node[some], node[a])), np.concatenate((np.full(len(some), -1), node[b])), np.concatenate((count[some], np.zeros(len(a), np.int64)))]
            edge = np.concatenate((np.zeros(len(some), bool), np.ones(len(a), bool)))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(edge)], names=["a", "b", "links", "edge"])

        for g in groups(batches, [*key, "i", "j"]):
            if (out := one(g)) is not None:
                yield out

    found = cut(dealt.mapInArrow(compare, "a long, b long, links long, edge boolean"))
    links = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("edge").select("a", "b"))
    named = nodes.join(links, "node", "left").join(comp, "node", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    with_ = ok.join(named, ["label", "vec"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"))
    rest = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return with_.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
