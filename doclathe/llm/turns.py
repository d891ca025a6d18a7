"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a path of turns; a turn is the 128-bit hash of its role and text, with the number of its words, so texts are never sorted or shuffled.
Conversations are in the order of their paths, then ids, so all that share a prefix stand together.

1. Sampled paths split the order into ranges. Every batch of rows is sorted to a run, in which each row carries the number of turns that it shares with the row before it
   (LCP). Runs go through Spark's shuffle, which is the external memory: a range's slices of all runs meet in one task.
2. There a loser tree merges the runs. Of two candidates the one that shares more turns with the row that was output last is first; only equal LCPs need a look at turns, and only at
   those beyond the LCP. So shared turns are compared once.
3. The merged rows and their LCPs drive a stack, the path that is open: nodes below the LCP are finished and leave it with all their sums.
4. Nodes on a range's first and last path may go on in other ranges. They are left open: what is known of them is handed on as two paths per range, in order, to tasks that treat `fan` ranges
   as this one did its rows, until one is left. Members' ids of such nodes are hashed in order as a stream, in chunks joined before.

Defined results: turns are ordered by number, null first, then by hash; rows of equal conversation, turn, role and text are turns of their own. Null role and text are empty. Rows without a
conversation id belong to no conversation. Other columns are ignored, so their names can't clash. Empty tables give no nodes.
A conversation is one row of about 24 bytes a turn. Sampled paths are cut to some turns (`_splitters`), so a range may be larger than the others where more conversations share more turns than that.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import words
from .runtime import groups, ship, store

Path = tuple[bytes, ...]
_PATH = "array<struct<h:binary,w:int>>"
_EDGE = "array<struct<h:binary,w:int,n:bigint,least:bigint,kids:bigint,leaves:bigint,saved:bigint>>"
#: kind: 0 a finished node, 1 an open path, 2 ids of members that end at an open node. key: of nodes that were open; parent: the key of a parent that still was.
_OUT = f"kind int, key binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, place bigint, path {_EDGE}, ids string"
CHUNK = 50_000


def paths(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id (long), path: the turns of each conversation in order."""
    r, t = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role, text))
    h = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = df.select(df[conv_id].cast("long").alias("conv_id"), F.struct(df[turn].alias("turn"), h.alias("h"), words(t).cast("int").alias("w")).alias("x")).where("conv_id is not null")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return own.select("conv_id", F.transform("xs", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).cast(_PATH).alias("path"))


def with_heads(rows: DataFrame, donors: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """paths() with the first `head` turns (at most `most`) of each replaced by those of the row of `donors` whose id is `donor`: all if it has fewer, none if there is none."""
    given = donors.select(F.col("conv_id").alias("donor"), F.slice("path", 1, most).alias("given"))
    j = rows.select("conv_id", "path", donor.alias("donor"), head.cast("int").alias("head")).join(given, "donor", "left")
    first = F.slice(F.coalesce("given", F.array().cast(_PATH)), F.lit(1), F.col("head"))
    return j.select("conv_id", F.concat(first, F.slice("path", F.col("head") + 1, F.size("path"))).alias("path"))


def _decoded(col: pa.Array) -> list[tuple[Path, list]]:
    """(hashes, the other fields by node) of each row of a path column."""
    h, *rest = (x.to_pylist() for x in col.flatten().flatten())
    more = list(zip(*rest, strict=True))
    cuts = [0, *pc.cumulative_sum(pc.list_value_length(col)).to_pylist()]
    return [(tuple(h[a:b]), more[a:b]) for a, b in zip(cuts, cuts[1:])]


def shared(a: Path, b: Path, known: int = 0) -> int:
    """The number of turns that two paths share, of which `known` are known."""
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[list[tuple[Path, int, int]]]) -> Iterator[tuple[int, int, int]]:
    """Sorted runs of (path, id, LCP with the row before) -> (run, place in it, LCP with the row output before), by a loser tree."""
    k = len(runs)
    at = [0] * k
    lcp = [0 if r else -1 for r in runs]  # with the row that was output last; -1: the run has ended

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP is from now on with the winner."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        (x, i, _), (y, j, _) = runs[a][at[a]], runs[b][at[b]]
        m = shared(x, y, lcp[a])
        less = (x[m:], i) <= (y[m:], j) if m == len(x) or m == len(y) else x[m] < y[m]
        lcp[b if less else a] = m
        return (a, b) if less else (b, a)

    loser = [-1] * k
    top = -1
    for leaf in range(k):  # each leaf climbs until it waits for its sibling
        win, node = leaf, (leaf + k) // 2
        while node and loser[node] >= 0:
            win, loser[node] = duel(win, loser[node])
            node //= 2
        if node:
            loser[node] = win
        else:
            top = win
    while top >= 0 and lcp[top] >= 0:
        yield top, at[top], lcp[top]
        at[top] += 1
        lcp[top] = runs[top][at[top]][2] if at[top] < len(runs[top]) else -1
        node = (top + k) // 2
        while node:
            top, loser[node] = duel(top, loser[node])
            node //= 2


class Node:
    __slots__ = ("key", "h", "w", "n", "least", "kids", "leaves", "saved", "ends", "waiting", "edge")

    def __init__(self, key: bytes, h: bytes, w: int, edge: bool):
        self.key, self.h, self.w, self.edge = key, h, w, edge
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.waiting: list[list] = []  # finished children, which lack this node's smallest member


def _less(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _row(**of) -> list:
    names = [c.split()[0] for c in _OUT.split(", ")]
    return [of.get(n) for n in names]


def climb(rows: Iterable[tuple[int, Path, list, object]], place: int, final: bool, told: bool) -> Iterator[list]:
    """Rows of _OUT from rows in order: (LCP with the one before, hashes, fields by node, and the id of a member or, of an open path, the root's fields). told: of members; else the fields say what is known of open nodes.
    final: no other range follows or came before, so no node stays open."""
    stack = [Node(hashlib.md5(b"").digest(), b"", 0, not final)]
    first: list[Node] = []
    any_row = False

    def done(node: Node, depth: int, above: Node | None) -> Iterator[list]:
        node.saved += max(0, node.n - 1) * node.w
        node.leaves = node.leaves or 1
        for x in node.waiting:
            x[5] = node.least
            yield x
        sha = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if told else None
        own = _row(kind=0, key=None if told else node.key, conv_id=node.least, depth=depth, n_convs=node.n, n_children=node.kids, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=sha)
        if above is None:
            yield own
        else:
            above.waiting.append(own)
            above.n += node.n
            above.least = _less(above.least, node.least)
            above.kids += 1
            above.leaves += node.leaves
            above.saved += node.saved

    def leave(node: Node) -> Iterator[list]:
        """A node that stays open: what waits for it goes on without it."""
        for x in node.waiting:
            x[2] = node.key
            yield x
        for i in range(0, len(node.ends), CHUNK):
            yield _row(kind=2, key=node.key, place=place, depth=i, ids=",".join(map(str, node.ends[i : i + CHUNK])))
        node.waiting, node.ends = [], []

    for lcp, hashes, fields, ident in rows:
        while len(stack) > lcp + 1:
            node = stack.pop()
            yield from leave(node) if node.edge else done(node, len(stack), stack[-1])
        for h, x in zip(hashes[lcp:], fields[lcp:], strict=True):
            stack.append(Node(hashlib.md5(stack[-1].key + h).digest(), h, x[0], not final and not any_row))
        if told:
            stack[-1].n += 1
            stack[-1].ends.append(ident)
            stack[-1].least = _less(stack[-1].least, ident)
        else:
            for node, (_, n, least, kids, leaves, saved) in zip(stack, [ident, *fields], strict=True):
                node.n, node.least, node.kids, node.leaves, node.saved = node.n + n, _less(node.least, least), node.kids + kids, node.leaves + leaves, node.saved + saved
        if not any_row:
            first, any_row = list(stack), True
    if not any_row:
        return
    if final:
        while stack:
            node = stack.pop()
            yield from done(node, len(stack), stack[-1] if stack else None)
        return
    for node in stack:
        yield from leave(node)
    known = sum(a is b for a, b in zip(first, stack))  # on both paths: told with the first
    for side, nodes, from_ in ((0, first, 0), (1, stack, known)):
        if side == 0 or len(nodes) > known:
            full = [(x.n, x.least, x.kids, x.leaves, x.saved) if i >= from_ else (0, None, 0, 0, 0) for i, x in enumerate(nodes)]
            path = [{"h": x.h, "w": x.w, "n": n, "least": least, "kids": kids, "leaves": leaves, "saved": saved} for x, (n, least, kids, leaves, saved) in zip(nodes, full, strict=True)]
            yield _row(kind=1, place=2 * place + side, path=path)


_TYPES = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary())] + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("place", pa.int64()), ("path", pa.list_(pa.struct([("h", pa.binary()), ("w", pa.int32())] + [(c, pa.int64()) for c in ("n", "least", "kids", "leaves", "saved")]))), ("ids", pa.string())]
)


def _batches(rows: Iterable[list]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for x in rows:
        held.append(x)
        if len(held) >= 4096 or x[0] and len(held) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


def _splitters(rows: DataFrame, parts: int, n: int, per: int = 16, held: int = 64 << 20) -> list[tuple[Path, int]]:
    """parts - 1 places in the order that split the turns about evenly, from a sample of about `per` rows a part; of each sampled path as many turns as fit into `held` bytes for all."""
    deep = max(16, held // (parts * per * 16))
    chosen = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(max(1, n // (parts * per)))) == 0)
    got = chosen.select("conv_id", F.transform(F.slice("path", 1, deep), lambda x: x["h"]).alias("hs"), (F.size("path") + 1).alias("size")).collect()
    order = sorted((tuple(map(bytes, r["hs"])), r["conv_id"], r["size"]) for r in got)
    total, upto, out = sum(x[2] for x in order), 0, []
    for path, ident, size in order:
        upto += size
        if upto * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append((path, ident))
    return out


def trie(convs: DataFrame, parts: int | None = None, held: int = 400_000, fan: int = 256, small: int = 1_000_000) -> DataFrame:
    """paths() -> one row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    held: turns of a range, about; parts: ranges, by default what `held` asks for and at least Spark's shuffle partitions. small: up to so many open nodes are broadcast to their children, beyond they are joined."""
    spark = convs.sparkSession
    ship(spark)
    rows = store(convs, "conversations")
    n, turns, least = rows.select(F.count("*"), F.coalesce(F.sum(F.size("path") + 1), F.lit(0)), F.min("conv_id")).first()
    parts = max(1, min(n, max(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // held))))
    ranges = spark.sparkContext.broadcast(_splitters(rows, parts, n) if parts > 1 else [])

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 32
        for b in batches:
            if not len(b):
                continue
            keys = [(p, i) for (p, _), i in zip(_decoded(b.column(1)), b.column(0).to_pylist(), strict=True)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            pid, lcp = [bisect.bisect_right(ranges.value, keys[i]) for i in order], [0] * len(order)
            for k in range(1, len(order)):
                if pid[k] == pid[k - 1]:
                    lcp[k] = shared(keys[order[k - 1]][0], keys[order[k]][0])
            cols = [pa.array(pid, pa.int32()), pa.array([run] * len(order), pa.int64()), pa.array(range(len(order)), pa.int32()), pa.array(lcp, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *(c.take(pa.array(order)) for c in b.columns)], names=["pid", "run", "pos", "lcp", "conv_id", "path"])
            run += 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["pid"]):
            runs: dict[int, list[tuple[Path, int, int]]] = {}
            other: dict[int, list[list]] = {}
            for b in g.to_batches():
                for run, lcp, ident, (p, more) in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), _decoded(b.column(5)), strict=True):
                    runs.setdefault(run, []).append((p, ident, lcp))
                    other.setdefault(run, []).append(more)
            heads, fields = list(runs.values()), list(other.values())
            ordered = ((lcp, heads[r][i][0], fields[r][i], heads[r][i][1]) for r, i, lcp in merged(heads))
            yield from _batches(climb(ordered, g.column(0)[0].as_py(), parts == 1, True))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["pid"]):
            def ordered(g: pa.Table = g) -> Iterator[tuple[int, Path, list, tuple]]:
                last: Path = ()
                for b in g.to_batches():
                    for (_, *p), (root, *fields) in _decoded(b.column(2)):
                        yield shared(last, tuple(p)), tuple(p), fields, root
                        last = tuple(p)

            yield from _batches(climb(ordered(), g.column(0)[0].as_py(), last_level, False))

    sorted_runs = rows.select("conv_id", "path").mapInArrow(sort_runs, f"pid int, run bigint, pos int, lcp int, conv_id bigint, path {_PATH}")
    out = store(sorted_runs.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "run", "pos").mapInArrow(merge, _OUT), "trie")
    nodes, ends = out.where("kind = 0"), out.where("kind = 2")
    left = parts
    while left > 1:
        left = -(-left // fan)
        last_level = left == 1
        width = 2 * fan
        edges = out.where("kind = 1").select(F.floor(F.col("place") / width).cast("int").alias("pid"), "place", "path")
        out = store(edges.repartitionById(left, F.col("pid")).sortWithinPartitions("pid", "place").mapInArrow(fold, _OUT), "trie")
        nodes = nodes.unionByName(out.where("kind = 0"))
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if parts == 1:
        return nodes.select(*keep)
    open_ = nodes.where("key is not null")
    hint = F.broadcast if open_.count() <= small else (lambda x: x)
    hashed = ends.select("key", "place", "depth", "ids").repartition("key").sortWithinPartitions("key", "place", "depth").mapInArrow(_hash_ends, "key binary, sha string")
    known = open_.drop("ends_sha256").join(hint(hashed), "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha")
    nodes = nodes.where("key is null").unionByName(known)
    # Children of nodes that stayed open: the root, whose children are the most, has the smallest id of all; the others are joined.
    above = open_.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    waiting = nodes.where("parent is not null and depth > 1").join(hint(above), "parent", "left").withColumn("parent_conv_id", F.col("above"))
    told = nodes.where("parent is null or depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    return told.select(*keep).unionByName(waiting.select(*keep))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sha of joined ids; the chunks of a key come in order, in any number of batches."""
    key, sha = None, hashlib.sha256()
    done: list[tuple[bytes, str]] = []
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "sha"])
            done = []
    if key is not None:
        done.append((key, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "sha"])
