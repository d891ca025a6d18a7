"""SimHash near-dedup by bit-sliced comparison.

fingerprints(): one 64-bit fingerprint per text from its word shingles, by majority over the shingles' XXH64.
near(): links fingerprints at `radius` or fewer differing bits. Equal fingerprints become one node first. The 64 bits are cut
into `bands`; two fingerprints within the radius agree on at least bands - radius whole bands, so rows meet under each choice
of that many bands (exact: no link is lost at any setting; 6 bands are 15 choices of 21 bits, 7 are 35 of 27 bits, for over a billion nodes). Nodes alone in their bucket are dropped before any comparison. A bucket of more than `block` nodes is cut into blocks and each
pair of blocks is compared by itself, so no task holds a whole hot bucket. Within a pair of blocks the fingerprints
stand as vertical bit planes; carry-save counters add up the differing bits of 64 candidates per machine word, saturate above the
radius, and a run of candidates is left as soon as all of them are beyond it. Of the links found only a star
for each connected group leaves the task, so copies are never expanded into pairs.

Defined results: null is the empty text; a text without words has fingerprint zero and links like any other.
Repeated rows each get a row. Ids must not be null for a component to be named: rows with null ids get fingerprints and
the component of their fingerprint's other rows (null if there are none). Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, with_least
from .runtime import cut, discard, groups, ship, store, tidy

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def hashes(text: str | None, size: int, part: int = 1 << 22) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of a text, in runs. Words are runs of anything but ASCII white space, A-Z lowered; fewer words than
    a shingle are one shingle; no words give nothing.

    The whole text counts, in parts of about `part` bytes that share their last words with the next one."""
    data = (text or "").encode().lower()
    digest = xxhash.xxh64_intdigest
    some, carry, at = False, [], 0
    while at < len(data) or not at:
        words = carry + data[at : at + part].split()
        at += part
        if at < len(data) and words and not data[at - 1 : at].isspace():  # the last word goes on
            rest = data[at : at + part].split(None, 1) if not data[at : at + 1].isspace() else []
            while rest:
                words[-1] += rest[0]
                at += len(rest[0])
                rest = data[at : at + part].split(None, 1) if at < len(data) and not data[at : at + 1].isspace() else []
        n = len(words) - size + 1
        if n > 0:
            whole = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            starts, ends = (end - length)[:n].tolist(), end[size - 1 :].tolist()
            for lo in range(0, n, 1 << 16):
                yield np.fromiter((digest(whole[s:e], 42) for s, e in zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)], strict=True)), np.uint64)
            some = True
        carry = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if not some and carry:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: str | None, size: int, part: int = 1 << 22) -> int:
    """Bit b is set if more than half of the shingle hashes have it; zero without words."""
    total, count = np.zeros(64, np.int64), 0
    for h in hashes(text, size, part):
        total += bit_counts(h)
        count += len(h)
    return int(sum(1 << b for b in range(64) if 2 * total[b] > count))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return df.select(df[id_col], df[text].cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit b of all fingerprints, 64 to a word: (64, words)."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64)
    full = np.zeros((64, words * 64), np.uint8)
    full[:, :n] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, cand: np.ndarray, radius: int, run: int = 8) -> np.ndarray:
    """Bits (queries, words) of the candidates at `radius` or fewer differing bits, by vertical carry-save counting.

    Counters hold `digits` bits; a carry out of the last one sticks. `run` planes are added between looks at which candidate words
    still have someone within reach; words (blocks of 64 candidates) without are abandoned."""
    n = len(cand)
    p = planes(cand)
    q = queries.astype(np.uint64)
    digits = max(1, (radius).bit_length())
    start = np.uint64((1 << digits) - 1 - radius)  # so that radius + 1 overflows
    out = np.zeros((len(q), p.shape[1]), np.uint64)
    alive = np.arange(p.shape[1])
    live = np.full(p.shape[1], ALL)
    if n % 64:
        live[-1] = np.uint64((1 << (n % 64)) - 1)
    count = [np.full((len(q), len(alive)), ALL if int(start) >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = np.broadcast_to(~live, (len(q), len(alive))).copy()
    for lo in range(0, 64, run):
        for b in range(lo, lo + run):
            mask = np.where(q >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
            carry = p[b][alive][None, :] ^ mask[:, None]
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
        open_ = (over != ALL).any(axis=0)
        if not open_.all():
            alive, over, count = alive[open_], over[:, open_], [c[:, open_] for c in count]
            if not len(alive):
                return out
    out[:, alive] = ~over
    return out


def forest(adj: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A star (root, member) for each connected group of a graph given as packed rows, by search over bit sets: each row is read once."""
    left = np.zeros(adj.shape[1] * 64, np.uint8)
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view("<u8").copy()
    some = np.flatnonzero(np.bitwise_count(adj).sum(axis=1) > 1)
    out: list[tuple[int, int]] = []
    done = np.zeros(n, bool)
    for root in some.tolist():
        if done[root]:
            continue
        done[root] = True
        left[root >> 6] &= ~np.uint64(1 << (root & 63))
        front = np.array([root])
        while len(front):
            got = np.bitwise_or.reduce(adj[front], axis=0) & left
            left &= ~got
            front = np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little")[:n])
            done[front] = True
            out += [(root, x) for x in front.tolist()]
    return out


def tree(adj: np.ndarray, n: int, keep: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Each node's parent in a spanning forest of a graph given as packed rows, -1 for roots; a parent is a neighbour. keep(node, neighbours): which of these it is linked to after all, asked
    of neighbours that are in no tree yet only."""
    left = np.full(adj.shape[1], ALL)
    up, done = np.full(n, -1), np.zeros(n, bool)
    for root in range(n):
        if done[root]:
            continue
        done[root] = True
        left[root >> 6] &= ~np.uint64(1 << (root & 63))
        front = [root]
        while front:
            at = front.pop()
            got = adj[at] & left
            if got.any():
                kids = np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little")[:n])
                if keep:
                    kids = kids[keep(at, kids)]
                    got = np.zeros(len(got) * 64, np.uint8)
                    got[kids] = 1
                    got = np.packbits(got, bitorder="little").view("<u8")
                left &= ~got
                up[kids], done[kids] = at, True
                front += kids.tolist()
    return up


def marks(values: np.ndarray) -> bytes:
    """Which places the members of a set of hashes fall on, as bits: a power of two of places, twice as many as members or more, from 64 to 8192."""
    places = 1 << min(13, max(6, (2 * len(values) - 1).bit_length()))
    bits = np.zeros(places, np.uint8)
    bits[values & np.uint32(places - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Marked:
    """Sets of which only sizes and marks() are at hand. A member that falls on a place where the other set has none isn't shared, which bounds what two sets have in common."""

    def __init__(self, size: pa.ChunkedArray, bits: pa.ChunkedArray, similarity: float, measure: str):
        self.size, self.similarity, self.measure = size.to_numpy().astype(np.int64), similarity, measure
        lengths = np.fromiter(map(len, each := bits.to_pylist()), np.int64, len(bits))
        self.words, self.start, self.all = lengths // 8, (np.cumsum(lengths) - lengths) // 8, np.frombuffer(b"".join(each), "<u8")
        self.folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks on `words` * 64 places of the sets that have so many or more, each set's row there, bits set by row."""
        if words not in self.folded:
            rows, parts, place, n = [], [], np.full(len(self.size), -1), 0
            for w in np.unique(self.words[self.words >= words]).tolist():
                own = np.flatnonzero(self.words == w)
                rows.append(own)
                parts.append(np.bitwise_or.reduce(self.all[self.start[own][:, None] + np.arange(w)].reshape(len(own), w // words, words), axis=1))
            for own in rows:
                place[own] = np.arange(n, n := n + len(own))
            whole = np.concatenate(parts)
            self.folded[words] = whole, place, np.bitwise_count(whole).sum(axis=1, dtype=np.int64)
        return self.folded[words]

    def near_in_size(self, x, y):
        return np.minimum(x, y) >= (self.similarity**2 if self.measure == "cosine" else self.similarity) * np.maximum(x, y)

    def enough(self, common, x, y):
        return common >= self.similarity * (np.sqrt(x * y) - 1e-9 if self.measure == "cosine" else x + y - common)

    def may(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether sets r and s (row by row) can be alike; no two that are alike are refused."""
        out = self.near_in_size(self.size[r], self.size[s])
        ask = np.flatnonzero(out)
        words = np.minimum(self.words[r[ask]], self.words[s[ask]])
        for w in np.unique(words).tolist():
            whole, place, count = self.at(w)
            these, step = ask[words == w], max(1, (1 << 20) // w)
            for lo in range(0, len(these), step):
                at = these[lo : lo + step]
                a, b = r[at], s[at]
                shared = np.bitwise_count(whole[place[a]] & whole[place[b]]).sum(axis=1, dtype=np.int64)
                x, y = self.size[a], self.size[b]
                bound = np.minimum(x - count[place[a]], y - count[place[b]]) + shared
                out[at] = self.enough(bound + 1e-6, x, y)
        return out


def _runs(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each group of a sorted table."""
    cols = [t.column(c).to_numpy() for c in keys]
    cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(t)], strict=True))


def _few(runs: list[tuple[int, int]], fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows r < s of one run each, their fingerprints within the radius: of many small runs at once."""
    rows = np.concatenate([np.arange(lo, hi) for lo, hi in runs])
    own = np.repeat(np.arange(len(runs)), [hi - lo for lo, hi in runs])
    got = []
    for d in range(1, max(hi - lo for lo, hi in runs)):
        at = np.flatnonzero(own[d:] == own[:-d])
        r, s = rows[at], rows[at + d]
        near_ = np.bitwise_count(fp[r] ^ fp[s]) <= radius
        got.append((r[near_], s[near_]))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2


def _grown(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, parent) of a spanning forest of few edges, -1 for roots."""
    beside: dict[int, list[int]] = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    up: dict[int, int] = {}
    for root in beside:
        if root not in up:
            up[root], front = -1, [root]
            while front:
                at = front.pop()
                for x in beside[at]:
                    if x not in up:
                        up[x] = at
                        front.append(x)
    return list(up.items())


def _deal(rows: DataFrame, keys: list[str], block: int, more: DataFrame | None = None, times: int | None = None, most: int = 4096) -> DataFrame:
    """rows (keys, node, ...) that share their keys with others, once for each pair of blocks (i, j) that their own block is in; a group of up to
    `block` rows is one block. more: columns by node that only these rows are joined with. times: blocks grow, up to `most` rows, before a group has more than so many of them, so that its
    rows are sent so many times at most until it has times * most."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(size, keys)
    rest = [c for c in rows.columns if c not in keys]
    if more is not None:
        met, rest = met.join(more, "node"), rest + [c for c in more.columns if c != "node"]
    blocks = F.ceil(F.col("n") / block)
    if times:
        blocks = F.greatest(F.least(blocks, F.lit(times)), F.ceil(F.col("n") / max(block, most)))
    met = met.withColumn("m", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    return met.select(*keys, *rest, "own", F.explode(pair).alias("p")).select(*keys, "p.i", "p.j", "own", *rest)


def _adjacent(f: np.ndarray, radius: int) -> np.ndarray:
    return np.concatenate([within(f[lo : lo + 512], f, radius) for lo in range(0, len(f), 512)])


def near(nodes: DataFrame, radius: int = 4, block: int = 2048, bands: int = 6) -> DataFrame:
    """nodes (fp, node): distinct fingerprints with a long each. Returns (a, b): nodes connected by links, as a star for each connected group of each block."""
    ship(nodes.sparkSession)
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    assert len(keys) == comb(bands, radius)
    rows = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.k", "fp", "node")
    group = ["t", "k", "i", "j"]
    dealt = _deal(rows, ["t", "k"], block).repartition(*group).sortWithinPartitions(*group, "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole small groups together, or one large group
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # Rows of several small groups are compared together: what is found across groups is a link all the same.
            t = pa.concat_tables(held)
            node = t.column("node").to_numpy()
            found = forest(_adjacent(t.column("fp").to_numpy().view(np.uint64), radius), len(t))
            if found:
                a, b = np.array(found).T
                a, b = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for g in groups(batches, group):
            if held and total + len(g) > 1024:
                yield from flush()
                held, total = [], 0
            held.append(g)
            total += len(g)
        if held:
            yield from flush()

    return dealt.mapInArrow(compare, "a long, b long")


def similar(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, measure: str = "jaccard", radius: int = 25, keys: int = 9, block: int = 512, small: int = 500_000) -> DataFrame:
    """(node, component) of the documents with a near copy: similarity of their shingle sets of `similarity` or more, directly or in steps; component is the smallest id.
    measure: jaccard, or cosine, which is what SimHash estimates (for sets of one size a cosine of 0.8 is a Jaccard similarity of 2/3).

    At a cosine of 0.8 fingerprints differ in 13.1 bits on average (3.2 a standard deviation), too many to find them by equal bands of bits: 181 bands of 20 bits would be needed to miss under 1 in 1000.
    So documents meet under each of `keys` min-wise hashes of their shingles (sets of one size at 0.8 miss each other under all nine with a chance of 5 in 100 000). In a bucket
    fingerprints, here of distinct shingles, so that repeated passages don't move them, are compared bit-sliced; pairs beyond `radius`, 3.7 deviations above the average, are left. What is
    within it is verified on the sets (32 bits of each hash): first along a spanning tree of each bucket, so that a group of copies takes one verification and two sets a member,
    then between those of a bucket that the verified links leave unconnected. Documents of one shingle set (128 bits of its hash) are one node in all this, the smallest id's, and join its group at
    the end, so any number of them costs one row each. Texts without words have no near copies.
    What meets in a bucket by a common passage only is left by sizes and marks() of the sets before any set is moved, which no alike pair is (an upper bound of what they share). Blocks of a bucket
    grow with it, so that its rows are sent 8 times at most up to 32768 of them; sets are sent for rows that may be alike with one that they aren't linked with.
    small: the wanted documents are broadcast to the texts up to so many ids, and joined beyond. Null ids are left out."""
    with tidy(df.sparkSession):
        return _similar(df, id_col, text, shingle, similarity, measure, radius, keys, block, small)


def _similar(df: DataFrame, id_col: str, text: str, shingle: int, similarity: float, measure: str, radius: int, keys: int, block: int, small: int, few: int = 16, part: int = 512) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    docs = df.select(df[id_col].cast("long").alias("node"), df[text].cast("string").alias("text")).where("node is not null")
    salt = np.random.default_rng(7).integers(1, 2**63, keys, dtype=np.uint64)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, least, whole, size, bits = [], [], [], [], []
            for t in b.column(1):
                got = [np.unique(h) for h in hashes(t.as_py(), shingle)]
                h = np.unique(np.concatenate(got)) if len(got) > 1 else got[0] if got else np.zeros(0, np.uint64)  # a set, as in verification
                low, count = np.full(keys, ALL), len(h)
                if count:
                    for j in range(keys):
                        x = (h ^ salt[j]) * np.uint64(0x9E3779B97F4A7C15)
                        low[j] = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min()
                total = sum((bit_counts(h[lo : lo + (1 << 16)]) for lo in range(0, count, 1 << 16)), np.zeros(64, np.int64))
                fps.append(int(sum(1 << k for k in range(64) if 2 * total[k] > count)))
                least.append(low.view(np.int64) if count else None)
                whole.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                short = np.unique(h.astype(np.uint32))
                size.append(len(short))
                bits.append(marks(short))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(least, pa.list_(pa.int64())), pa.array(whole, pa.binary()), pa.array(size, pa.int32()), pa.array(bits, pa.binary())],
                names=["node", "fp", "least", "whole", "size", "bits"],
            )

    base = store(docs.mapInArrow(features, "node long, fp long, least array<long>, whole binary, size int, bits binary").where("least is not null"), "similar-base")
    twins = cut(with_least(base.select("whole", "node"), "whole", "node").where("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct())
    rows = base.join(twins.select(F.col("b").alias("node")), "node", "left_anti").select("node", F.posexplode("least").alias("t", "k"))
    group = ["t", "k", "i", "j"]
    dealt = _deal(rows, ["t", "k"], block, base.select("node", "fp", "size", "bits"), 8).repartition(*group).sortWithinPartitions(*group, "own")
    columns = [*group, "own", "node", "fp", "size", "bits"]
    schema = "t int, k long, i int, j int, own int, node long, fp long, size int, bits binary"

    def prints(t: pa.Table) -> np.ndarray:
        return t.column("fp").to_numpy().view(np.uint64)

    def marked(t: pa.Table) -> Marked:
        return Marked(t.column("size"), t.column("bits"), similarity, measure)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group that may be alike with another within the radius, each but one of those connected with one of these."""
        for t in groups(batches, group, 1024):
            fp, known, runs = prints(t), marked(t), _runs(t, group)
            up = np.full(len(t), -1)
            some = np.zeros(len(t), bool)
            if short := [x for x in runs if 1 < x[1] - x[0] <= few]:
                r, s = _few(short, fp, radius)
                ok = known.may(r, s)
                if ok.any():
                    node, over = np.array(_grown(list(zip(r[ok].tolist(), s[ok].tolist(), strict=True)))).T
                    up[node], some[node] = over, True
            for lo, hi in runs:
                if hi - lo > few:
                    over = tree(_adjacent(fp[lo:hi], radius), hi - lo, lambda at, kids, lo=lo, known=known: known.may(np.full(len(kids), at + lo), kids + lo))
                    node = np.flatnonzero(over >= 0)
                    up[node + lo] = over[node] + lo
                    some[node + lo] = some[over[node] + lo] = True
            if some.any():
                at, node = np.flatnonzero(some), t.column("node").to_numpy()
                out = t.take(pa.array(at)).append_column("up", pa.array(node[np.maximum(up[at], 0)], mask=up[at] < 0))
                yield from out.combine_chunks().to_batches()

    found = store(dealt.select(*columns).mapInArrow(candidates, schema + ", up long"), "similar-found")
    discard(base)
    wanted = cut(found.select("node").distinct())
    chosen = docs.join(F.broadcast(wanted) if wanted.count() <= small else wanted, "node", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(np.concatenate([np.unique(h.astype(np.uint32)) for h in hashes(t.as_py(), shingle)])).view(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["node", "set"])

    full = store(chosen.mapInArrow(sets, "node long, set array<int>"), "similar-sets")

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < (similarity**2 if measure == "cosine" else similarity) * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= similarity * ((len(x) * len(y)) ** 0.5 - 1e-9 if measure == "cosine" else len(x) + len(y) - common)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = found.where("up is not null").select(F.least("node", "up").alias("a"), F.greatest("node", "up").alias("b")).distinct()
    one, two = full.select(F.col("node").alias("a"), F.col("set").alias("x")), full.select(F.col("node").alias("b"), F.col("set").alias("y"))
    links = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    named = cut(components(links.unionByName(twins)))
    told = found.drop("up").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    again = told.repartition(*group).sortWithinPartitions(*group, "own", "node")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group that may be alike with another within the radius that they aren't connected with: of more than two parts of a group once for each pair of parts (a, b) that have such rows."""
        for t in groups(batches, group, 1024):
            comp, fp, known, runs = t.column("component").to_numpy(), prints(t), marked(t), _runs(t, group)
            some = np.zeros(len(t), bool)
            if short := [x for x in runs if 1 < x[1] - x[0] <= few]:
                r, s = _few(short, fp, radius)
                other = comp[r] != comp[s]
                r, s = r[other], s[other]
                ok = known.may(r, s)
                some[r[ok]] = some[s[ok]] = True
            out = []
            for lo, hi in runs:
                if hi - lo <= few or (comp[lo:hi] == comp[lo]).all():
                    continue
                n, adj, own = hi - lo, _adjacent(fp[lo:hi], radius), np.zeros(hi - lo, bool)
                width = part if n > 2 * part else n
                hit = set()
                for at in range(0, n, 64):
                    bits = np.unpackbits(adj[at : at + 64].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
                    r, s = np.nonzero(bits & (comp[lo + at : lo + at + len(bits), None] != comp[None, lo:hi]))
                    r += at
                    r, s = r[r < s], s[r < s]
                    ok = known.may(r + lo, s + lo)
                    own[r[ok]] = own[s[ok]] = True
                    hit |= set(zip((r[ok] // width).tolist(), (s[ok] // width).tolist(), strict=True))
                if width == n:
                    some[lo:hi] = own
                    continue
                for a, b in sorted(hit):
                    for half in sorted({a, b}):
                        at = np.flatnonzero(own[half * width : (half + 1) * width]) + half * width + lo
                        out.append((at, np.full(len(at), a), np.full(len(at), b), np.full(len(at), half)))
            at = np.flatnonzero(some)
            for rows_, a, b, half in [(at, *[np.zeros(len(at), np.int64)] * 3), *out]:
                if len(rows_):
                    got = t.take(pa.array(rows_))
                    for name, x in (("a", a), ("b", b), ("half", half)):
                        got = got.append_column(name, pa.array(x, pa.int32()))
                    yield from got.combine_chunks().to_batches()

    left = store(again.select(*columns, "component").mapInArrow(apart, schema + ", component long, a int, b int, half int"), "similar-left")
    discard(found)
    parts = [*group, "a", "b"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, parts):
            node, n, own, half = g.column("node").to_numpy(), len(g), g.column("own").to_numpy(), g.column("half").to_numpy()
            adj, known = _adjacent(prints(g), radius), marked(g)
            blocks, halves = (g.column(x)[0].as_py() != g.column(y)[0].as_py() for x, y in (("i", "j"), ("a", "b")))
            each = [x for c in g.column("set").chunks for x in c]
            held: dict[int, np.ndarray] = {}
            comp, a, b = g.column("component").to_numpy().copy(), [], []

            def value(i: int, each=each, held=held) -> np.ndarray:
                if i not in held:
                    held[i] = np.asarray(each[i].values)
                return held[i]

            for r in range(n):
                rest = np.flatnonzero(np.unpackbits(adj[r].view(np.uint8), bitorder="little")[r + 1 : n]) + r + 1
                rest = rest[comp[rest] != comp[r]]
                if blocks:
                    rest = rest[own[rest] != own[r]]
                if halves:
                    rest = rest[half[rest] != half[r]]
                rest = rest[known.may(np.full(len(rest), r), rest)]
                while len(rest := rest[comp[rest] != comp[r]]):
                    if alike(value(r), value(int(rest[0]))):
                        a.append(node[r])
                        b.append(node[rest[0]])
                        comp[comp == comp[rest[0]]] = comp[r]
                    rest = rest[1:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(b))], names=["a", "b"])

    more = left.join(full, "node").repartition(*parts).sortWithinPartitions(*parts, "own", "node")
    more = cut(more.select(*parts, "own", "node", "fp", "size", "bits", "component", "half", "set").mapInArrow(verify, "a long, b long"))
    discard(full, left)
    return named if more.isEmpty() else components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, block: int = 2048, bands: int = 6) -> DataFrame:
    """(id, fingerprint, component_id): fingerprint as 16 hexadecimal digits, component_id the smallest id reachable by links."""
    fps = cut(fingerprints(df, id_col, text, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")).where("node is not null"))
    comp = components(near(nodes, radius, block, bands))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexa = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp", "left").select(id_col, hexa, "component_id")
