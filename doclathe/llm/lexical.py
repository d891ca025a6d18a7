"""Ranked lexical search: windowed bucket scoring of postings.

One pass over the texts makes segments: of every window of `window` documents, in the order in which a task reads them, the postings of all
terms that the queries ask for, by term (slot of the document in its window, occurrences), and each document's length. Segments are written to the shared
folder; texts aren't read again. Sums over the segments give N, L and every term's document frequency.

Scoring walks the segments. In each window a query's postings are scattered into an array of one bucket per slot, small enough for a core's
cache; the documents met are the union of the terms' bit sets; of those set, the ones that beat the query's k-th score so far go to its heap. A task returns
its k best per query, which are merged in two steps (by part of the tasks, then all), each keeping k rows of a query per task before it shuffles.

Queries come in blocks of bounded bytes, each with a pass of its own, so any number of them can be asked; a block is what the driver and the workers hold.
Scores are 64-bit integers, so that neither order of addition nor partitioning changes them.

Defined results: terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered. Null and empty texts have no terms and
are never returned; queries without terms, or whose terms no document has, get no rows. Rows of equal id are documents of their own, and both may be returned; equal scores are ranked by
ascending id, null ids last. Rows of an equal query id are queries of their own: each gets its rows. Other columns are ignored, so their names can't clash. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import utf8
from .runtime import ship, store

#: What a term's bytes become: A-Z lowered, other ASCII but letters and digits blank.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
SEGMENT = "ids array<bigint>, n_terms bigint, lengths binary, terms binary, counts binary, slots binary, tfs binary"


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def term_array(text: Column) -> Column:
    """The same as a column."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


def segments(df: DataFrame, vocabulary: list[str], id_col: str, text: str, window: int = 8192, held: int = 4_000_000) -> DataFrame:
    """Segments of all documents with terms. terms, counts: numbers of the vocabulary's terms that occur, and of how many documents; slots, tfs: their postings, one term
    after the other. A window ends early at `held` postings, so a segment is some tens of MB at most (a longer document alone)."""
    shared = df.sparkSession.sparkContext.broadcast({t.encode("utf-8"): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        ids: list[int | None] = []
        lengths: list[int] = []
        slots: list[np.ndarray] = []
        found: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        n = 0

        def segment() -> pa.RecordBatch:
            slot, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, found, tfs))
            order = np.argsort(term, kind="stable")
            seen, count = np.unique(term, return_counts=True)
            cols = [np.array(lengths, "<i8"), seen.astype("<i4"), count.astype("<i4"), slot[order].astype("<u2"), tf[order].astype("<i4")]
            row = [pa.array([ids], pa.list_(pa.int64())), pa.array([sum(lengths)], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]]
            return pa.RecordBatch.from_arrays(row, names=["ids", "n_terms", "lengths", "terms", "counts", "slots", "tfs"])

        for b in batches:
            data, offsets = utf8(b.column(1))
            blob, cuts = memoryview(data), offsets.tolist()
            for i, doc in enumerate(b.column(0).to_pylist()):
                all_ = terms(bytes(blob[cuts[i] : cuts[i + 1]]))
                if not all_:
                    continue
                own = np.array([x for x in map(number.get, all_) if x is not None], np.int64)
                own, tf = np.unique(own, return_counts=True)
                slots.append(np.full(len(own), len(ids), np.int64))
                found.append(own)
                tfs.append(tf)
                ids.append(doc)
                lengths.append(len(all_))
                n += len(own)
                if len(ids) == window or n >= held:
                    yield segment()
                    ids, lengths, slots, found, tfs, n = [], [], [], [], [], 0
        if ids:
            yield segment()

    return df.select(df[id_col].cast("long"), df[text].cast("string")).mapInArrow(run, SEGMENT)


class Best:
    """A query's k best: a heap with the worst on top. Worse is a lower score, and of equal scores the larger id; null is the largest."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, scores: np.ndarray, ids: list[int | None], at: np.ndarray) -> None:
        least = self.heap[0][0] if len(self.heap) == self.k else 0
        if len(scores) > self.k:
            least = max(least, int(np.partition(scores, -self.k)[-self.k]))
        keep = scores >= least
        scores, at = scores[keep], at[keep]
        for s, i in zip(scores.tolist(), at.tolist(), strict=True):
            x = (s, ids[i] is not None, -(ids[i] or 0))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, x)
            elif x > self.heap[0]:
                heapq.heapreplace(self.heap, x)


def score(segs: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best of each query in each task: query (its place in `queries`, lists of term number and repeats), doc_id, score, task."""
    shared = segs.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked, w = shared.value
        best = [Best(k) for _ in asked]
        for b in batches:
            for ids, *rest in zip(b.column(0).to_pylist(), *[b.column(i) for i in range(2, 7)], strict=True):
                lengths, seen, counts, slots, tfs = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(rest, ("<i8", "<i4", "<i4", "<u2", "<i4"), strict=True))
                norm = 100 - 25 + (25 * lengths * n_docs) // n_terms
                # What a posting adds depends on its term and document only.
                add = np.repeat(w[seen], counts) * ((1_000_000_000 * tfs.astype(np.int64)) // (1000 * tfs.astype(np.int64) + 12 * norm[slots]))
                ends = np.cumsum(counts.astype(np.int64))
                place = dict(zip(seen.tolist(), range(len(seen)), strict=True))
                bits: dict[int, np.ndarray] = {}
                bucket = np.zeros(len(ids), np.int64)
                for q, wanted in enumerate(asked):
                    met = np.zeros(-(-len(ids) // 8), np.uint8)
                    for t, times in wanted:
                        if (p := place.get(t)) is None:
                            continue
                        lo, hi = int(ends[p] - counts[p]), int(ends[p])
                        bucket[slots[lo:hi]] += add[lo:hi] if times == 1 else add[lo:hi] * times
                        if p not in bits:
                            one = np.zeros(len(ids), bool)
                            one[slots[lo:hi]] = True
                            bits[p] = np.packbits(one)
                        met |= bits[p]
                    at = np.flatnonzero(np.unpackbits(met, count=len(ids)))
                    got = bucket[at]
                    bucket[at] = 0
                    above = got > 0
                    best[q].add(got[above], ids, at[above])
        task = TaskContext.get().partitionId()
        out = [(q, -i if there else None, s) for q, x in enumerate(best) for s, there, i in x.heap]
        cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([task] * len(out), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score", "task"])

    return segs.mapInArrow(run, "query bigint, doc_id bigint, score bigint, task bigint")


def _top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", window: int = 8192, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank (from 1), id_col (long), score of the k best documents of each query. window: at most 65536."""
    assert 0 < window <= 65536
    spark = docs.sparkSession
    ship(spark)
    # Queries as counts of terms, one row each; the block of a row follows from its number.
    asked = store(queries.select(F.struct(queries[query_id]).alias("id"), term_array(queries[query_text]).alias("terms"), F.monotonically_increasing_id().alias("row")).where(F.size("terms") > 0), "queries")
    size = asked.agg(F.coalesce(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t) + 64)")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found: DataFrame | None = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).select("row", F.explode("terms").alias("term")).groupBy("row", "term").count()
        rows = part.collect()  # about block_bytes
        names = sorted({r["term"] for r in rows})
        number = {t: j for j, t in enumerate(names)}
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(rows):
            wanted.setdefault(r["row"], []).append((number[r["term"]], r["count"]))
        if not wanted:
            continue
        segs = store(segments(docs, names, id_col, text, window), "segments")
        n_docs, n_terms = segs.select(F.sum(F.size("ids")), F.sum("n_terms")).first()
        if not n_docs:
            continue
        df = np.zeros(len(names), np.int64)
        for r in _frequencies(segs).collect():  # a row per term of the block at most
            df[r["term"]] = r["n"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = score(segs, list(wanted.values()), weights, n_docs, n_terms, k)
        tasks = segs.rdd.getNumPartitions()
        top = _top(_top(best.withColumn("part", F.pmod("task", F.lit(max(1, math.isqrt(tasks))))), ["query", "part"], k), ["query"], k)
        own = spark.createDataFrame(list(enumerate(wanted)), "query long, row long")
        block = top.join(F.broadcast(own), "query").select("row", "rank", "doc_id", "score")
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = asked.select("row", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(asked.select("row", "id"), "row").select("id.*", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _frequencies(segs: DataFrame) -> DataFrame:
    """term, n: in how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(0)]
            c = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(1)]
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t).astype(np.int64)), pa.array(np.concatenate(c).astype(np.int64))], names=["term", "n"])

    return segs.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
