"""Substring dedup by compact windows.

A text is a sequence of shingles (5 words, A-Z lowered). For each of `hashes` functions the Cartesian tree of the shingles' hash values
is cut to the nodes that are the minimum of some run of `least` words: such a node c with its bounds l and r, given by the nearest smaller values, stands for
every run inside [l, r] through c, all of which share the signature f(c). Bounds are cut to one run's length on either side: longer repeats are covered by
their next nodes. Windows meet by (function, signature): first within a batch of texts, so that a passage of which a third of all documents
have a copy is one row per batch, then across the table. Each is linked to the first window of its context (the same shingles right of c) and to
the first of its signature, so groups are never expanded to pairs. Links stay where windows of `enough` functions overlap them in their document (an interval
join by binary search), and are verified on the shingles (32 bits of each hash): the stretches at least 80 % of whose shingles occur in the other
document's interval, and at least one run long, are repeats, every one of them.

A window compared with one partner may have a true one besides it. So all windows of a signature of which one is still outside every repeat are compared with one another, whatever
their contexts, on the shingles around c; of two that are both inside repeats nothing is asked. Rows that have too few shingles in common with all others of their group together are left out of that,
which loses no pair: around a line that many documents have nearly all are. Large groups are compared by pairs of blocks. And what isn't inside a verified stretch is looked at once more, without any partner's say: all runs through
the nodes of signatures that several documents share, grouped by 96 bits of the whole run. A run in two documents is a repeat, so no exact repeat is ever missed.

Defined results: null, empty and short texts (under `least` words) have no spans. A passage repeated only inside one document is not reported.
Rows of equal id and text count as one document; rows of equal id with different texts, and rows with null ids, are documents of their own. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices, utf8
from .runtime import cut, discard, groups, ship, store, tidy

SHINGLE = 5
GRID = 32
PART = 4096  # shingles of a document in which intervals on one diagonal are taken together
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FUNC = _RNG.integers(1, 2**63, (32, 2), dtype=np.uint64) | np.uint64(1)
_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.empty(size, np.uint64)
        out[0] = 1
        step, k = int(_BASE_INV if inverse else _BASE), 1
        while k < size:
            m = min(k, size - k)
            out[k : k + m] = out[:m] * np.uint64(step)
            step, k = step * step % (1 << 64), k * 2
        _POWERS[inverse] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of several UTF-8 texts end to end, and each text's end in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = white[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    before[begins[begins < len(data)]] = True
    start = np.flatnonzero(~white & before)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = white[1:]
    last = ends[(ends > 0)] - 1
    after[last] = True
    end = np.flatnonzero(~white & after) + 1
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(len(data), False), dtype=np.uint64)))
    word = mix((run[end] - run[start]) * _powers(len(data), True)[start])
    per = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if len(word) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    h = np.zeros(len(word) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        h += word[i : len(word) - SHINGLE + 1 + i] * _PLACE[i]
    h = mix(h)
    upto = np.cumsum(per)
    left = np.repeat(upto, per)[: len(h)] - np.arange(len(h))  # words left in the same text
    return h[left >= SHINGLE], np.cumsum(np.maximum(per - SHINGLE + 1, 0))


def windows(h: np.ndarray, ends: np.ndarray, run: int, func: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, c, l, r) of the compact windows of all texts under one function; positions in h."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < run:
        return np.zeros(0, np.uint64), none, none, none
    f = mix((h ^ _FUNC[func, 0]) * _FUNC[func, 1])
    best, span = f, 1
    while span * 2 <= run:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    least = np.minimum(best[: n - run + 1], best[run - span : run - span + n - run + 1])
    per = np.diff(np.concatenate(([0], ends)))
    upto = np.repeat(ends, per)
    ok = upto[: n - run + 1] - np.arange(n - run + 1) >= run
    turn = ok.copy()
    turn[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    at = np.flatnonzero(turn)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    good = np.flatnonzero(ok)
    upto_run = good[np.append(np.searchsorted(good, at[1:]) - 1, len(good) - 1)]  # last begin of a run with this minimum
    parts, reach = [], np.arange(run)
    while len(at):  # more than once only where equal values take over from one another
        p = at + run - 1 - f[at[:, None] + reach[None, ::-1]].argmin(axis=1)
        parts.append(p)
        go = p < upto_run
        at, upto_run = p[go] + 1, upto_run[go]
    c = np.unique(np.concatenate(parts))
    lo = np.maximum(np.repeat(np.concatenate(([0], ends[:-1])), per)[c], c - run + 1)
    hi = np.minimum(upto[c] - 1, c + run - 1)
    reach = np.arange(1, run)
    back, forth = c[:, None] - reach[None, :], c[:, None] + reach[None, :]
    smaller = (f[np.maximum(back, 0)] < f[c][:, None]) | (back < lo[:, None])
    left = np.where(smaller.any(axis=1), smaller.argmax(axis=1), run - 1)
    smaller = (f[np.minimum(forth, n - 1)] < f[c][:, None]) | (forth > hi[:, None])
    right = np.where(smaller.any(axis=1), smaller.argmax(axis=1), run - 1)
    keep = left + right + 1 >= run
    return f[c[keep]], c[keep], (c - left)[keep], (c + right)[keep]


WINDOW = "sig long, salt int, rc long, doc long, c long, l int, r int, doc0 long, c0 long, l0 int, r0 int, func int"
LINK = "doc0 long, doc long, diag long, s0 long, e0 long, func int"
CONTEXT = 12  # shingles right of c that tell contexts apart
MARK = -1  # func of a row that names the runs of a window (doc; begins from s0 to e0) of a signature (diag) that several documents share, and one of the others (doc0)

NEAR = -2  # NEAR - j: func of a row that names a window (doc; c is s0) of function j and of a signature (diag) that several documents share
BLOCK = 4096  # windows of a signature beyond which they are compared by pairs of blocks


def _ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range [start, end) of h."""
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), False), dtype=np.uint64)))
    return mix((run[end] - run[start]) * _powers(len(h) + 1, True)[start])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, each one's place of the first with equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _window_rows(cols: list[np.ndarray], peer: list[np.ndarray], null: np.ndarray, func: np.ndarray) -> pa.RecordBatch:
    """WINDOW rows from (sig, salt, rc, doc, c, l, r), (doc0, c0, l0, r0), which of these are null, and func."""
    kinds = [pa.int32() if " int" in x else pa.int64() for x in WINDOW.split(", ")]
    arrays = [pa.array(x).cast(k) for x, k in zip(cols, kinds, strict=False)] + [pa.array(x, mask=null).cast(k) for x, k in zip(peer, kinds[7:11], strict=True)] + [pa.array(func).cast(pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in WINDOW.split(", ")])


def compact(df: DataFrame, run: int, hashes: int) -> DataFrame:
    """WINDOW rows: a batch's first window of each signature and context, and its windows in other documents with that first one beside them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            for a, z in slices(np.diff(offsets), 2 << 20):
                h, ends = shingles(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a])
                per = np.diff(np.concatenate(([0], ends)))
                owner = np.repeat(np.asarray(ids[a:z], np.int64), per)
                base, upto = np.repeat(ends - per, per), np.repeat(ends, per)
                parts = [(*windows(h, ends, run, j), j) for j in range(hashes)]
                sig = np.concatenate([p[0] for p in parts]).view(np.int64)
                if not len(sig):
                    continue
                c, lo, hi = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
                func = np.repeat(np.arange(hashes), [len(p[0]) for p in parts])
                rc = _ranges(h, c + 1, np.minimum(c + 1 + CONTEXT, upto[c])).view(np.int64)
                doc, left, right = owner[c], c - lo, hi - c
                c = c - base[c]
                order = np.lexsort((c, doc, rc, sig, func))
                sig, func, rc, doc, c, left, right = (x[order] for x in (sig, func, rc, doc, c, left, right))
                k = _firsts(func, sig, rc)
                null = doc[k] == doc  # the first one, and that document's other places of the signature
                whole = _firsts(func, sig)
                apart = np.flatnonzero(doc != doc[whole])
                null[apart[np.unique(whole[apart], return_index=True)[1]]] = True  # one of another document, so that it is seen that they share it
                yield _window_rows([sig, np.where(null, 0, doc % 64 + 1), rc, doc, c, left, right], [x[k] for x in (doc, c, left, right)], null, func)

    return df.mapInArrow(go, WINDOW)


def link(rows: DataFrame, run: int, near: bool = False) -> DataFrame:
    """LINK rows: aligned intervals, in shingles, of a window and the first of its context and of its signature, at least `run` long; and MARK rows, all
    windows of function 0 whose signature is in two documents or more; near: NEAR rows, too, of such windows of all functions."""
    dealt = rows.repartition("func", "sig", "salt").sortWithinPartitions("func", "sig", "salt", "rc", "doc", "c")
    names = [x.split()[0] for x in LINK.split(", ")]

    def emit(doc0: np.ndarray, doc: np.ndarray, diag: np.ndarray, s0: np.ndarray, e0: np.ndarray, func: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if i == 5 else np.int64)) for i, x in enumerate((doc0, doc, diag, s0, e0, func))], names=names)

    def mark(z: np.ndarray, sig: np.ndarray, row: list[np.ndarray], other: np.ndarray) -> pa.RecordBatch:
        doc, c, lo, hi = (x[z] for x in row)
        return emit(other, doc, sig[z], c - lo, np.minimum(c, c + hi - run + 1), np.full(len(c), MARK))

    def aligned(row: list[np.ndarray], peer: list[np.ndarray], func: np.ndarray) -> pa.RecordBatch:
        (doc, c, lo, hi), (doc0, c0, l0, r0) = row, peer
        left, right = np.minimum(lo, l0), np.minimum(hi, r0)
        ok = (doc0 != doc) & (left + right + 1 >= run)
        return emit(*(x[ok] for x in (doc0, doc, c - c0, c0 - left, c0 + right, func)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups stream. Of the last one its first window, its context's first and one of another document are carried on; all its windows while they are of one document.
        carry, known = None, False
        for b in batches:
            if not len(b):
                continue
            met = b.column("doc0").is_valid().to_numpy(zero_copy_only=False)
            if met.any():
                m = b.filter(pa.array(met))
                row, peer = ([m.column(x).to_numpy() for x in cols] for cols in (("doc", "c", "l", "r"), ("doc0", "c0", "l0", "r0")))
                func = m.column("func").to_numpy()
                yield aligned(row, peer, func)
                z = func == 0
                if near:
                    yield emit(row[0], row[0], m.column("sig").to_numpy(), row[1], row[1], NEAR - func)
                yield mark(z, m.column("sig").to_numpy(), row, peer[0][z])  # the first one of the batch is marked where it meets the one of another document
            own = [b.filter(pa.array(~met)).column(x).to_numpy() for x in ("func", "sig", "salt", "rc", "doc", "c", "l", "r")]
            old = 0 if carry is None else len(carry[0])
            if not len(own[0]):
                continue
            func, sig, salt, rc, *row = own if carry is None else [np.concatenate(x) for x in zip(carry, own, strict=True)]
            whole, context = _firsts(func, sig, salt), _firsts(func, sig, salt, rc)
            fresh = np.arange(len(sig)) >= old
            yield aligned([x[fresh] for x in row], [x[context[fresh]] for x in row], func[fresh])
            apart = fresh & (whole != context) & (context == np.arange(len(sig)))
            yield aligned([x[apart] for x in row], [x[whole[apart]] for x in row], func[apart])
            # Marks: groups with a second document.
            heads = np.flatnonzero(whole == np.arange(len(sig)))
            doc = row[0]
            second = np.where(doc != doc[whole], np.arange(len(sig)), len(sig))
            second = np.minimum.reduceat(second, heads)[np.searchsorted(heads, whole)]
            shared = second < len(sig)
            z = shared & (func == 0) & (fresh | (not known)) & (row[3] > 0)  # carried rows, too, of a group that wasn't shared till now
            yield mark(z, sig, row, np.where(doc[z] != doc[whole[z]], doc[whole[z]], doc[np.minimum(second[z], len(sig) - 1)]))
            if near:
                x = shared & (fresh | (not known))
                yield emit(doc[x], doc[x], sig[x], row[1][x], row[1][x], NEAR - func[x])
            start = heads[-1]
            known = bool(shared[-1])
            pick = np.unique([start, context[-1], second[-1]]) if known else np.arange(start, len(sig))
            carry = [x[pick] for x in (func, sig, salt, rc, *row)]

    return dealt.mapInArrow(go, LINK)


def overlapping(links: DataFrame, enough: int, run: int) -> DataFrame:
    """The links whose interval in their document is overlapped, by half a run or more, by windows of `enough` functions, its own included."""
    dealt = links.repartition("doc").sortWithinPartitions("doc")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["doc"], 1 << 16):
            doc, diag, s0, e0, func = (t.column(x).to_numpy() for x in ("doc", "diag", "s0", "e0", "func"))
            base = np.unique(doc, return_inverse=True)[1].astype(np.int64) << 40  # documents end to end
            s, e = base + s0 + diag, base + e0 + diag
            votes = np.zeros(len(doc), np.int64)
            for j in np.unique(func).tolist():
                own = np.flatnonzero(func == j)
                own = own[np.argsort(s[own])]
                reach = np.maximum.accumulate(e[own])
                at = np.searchsorted(s[own], e - run // 2, "right") - 1
                votes += (at >= 0) & (reach[np.maximum(at, 0)] >= s + run // 2)
            yield from t.filter(pa.array(votes >= enough)).combine_chunks().to_batches()

    return dealt.mapInArrow(go, LINK)


def stretches(hit: np.ndarray, run: int) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in bounds(hit, run)), strict=True))


def bounds(hit: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions (starts, ends) of stretches with at least 80 % hits, begun and ended by hits, at least `run` long; stretches that overlap are joined.

    A hit adds 1, a miss takes 4: a stretch qualifies if its total isn't negative. Each hit's farthest end comes from the largest total still ahead."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    after = np.arange(1, len(at) + 1) * 5 - 4 * (at + 1)  # total up to and with each hit
    ahead = np.maximum.accumulate(after[::-1])  # rising, from the last hit on
    far = at[len(at) - 1 - np.searchsorted(ahead, after - 1)] + 1
    long = far - at >= run
    begin, end = at[long], np.maximum.accumulate(far[long])
    if not len(begin):
        return begin, end
    new = np.flatnonzero(np.concatenate(([True], begin[1:] >= end[:-1])))
    return begin[new], end[np.append(new[1:] - 1, len(end) - 1)]


def _cut_out(b: pa.RecordBatch, fields: list[str], ends_of: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.ListArray]]:
    """Of a batch (doc, text, list of structs): each struct's doc, its fields, and 32 bits of the shingles' hashes between the two places that ends_of() gives for it, as far as the text goes."""
    data, offsets = utf8(b.column(1))
    ids = b.column(0).to_numpy()
    per = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
    structs = b.column(2).flatten()
    cols = [structs.field(f).to_numpy(zero_copy_only=False) for f in fields]
    upto, owner = np.concatenate(([0], np.cumsum(per))), np.repeat(np.arange(len(b)), per)
    for a, z in slices(np.diff(offsets), 2 << 20):
        h, ends = shingles(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a])
        h, first = h.astype(np.uint32).view(np.int32), np.concatenate(([0], ends[:-1]))
        for lo in range(int(upto[a]), int(upto[z]), 4096):
            hi = min(lo + 4096, int(upto[z]))
            own, part = owner[lo:hi], [c[lo:hi] for c in cols]
            s, e = ends_of(*part)
            size = np.maximum(0, np.minimum(e, (ends - first)[own - a]) - s)
            at = np.concatenate(([0], np.cumsum(size)))
            values = h[np.arange(at[-1]) + np.repeat(first[own - a] + s - at[:-1], size)]
            yield ids[own], part, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def evidence(texts: DataFrame) -> DataFrame:
    """texts (doc, text, ivs) -> (doc, s, e, h): the shingles of the intervals asked for, 32 bits of each hash."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, (s, e), h in _cut_out(b, ["s", "e"], lambda s, e: (np.maximum(0, s), e)):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s), pa.array(e), h], names=["doc", "s", "e", "h"])

    return texts.select("doc", "text", "ivs").mapInArrow(go, "doc long, s long, e long, h array<int>")


def all_bounds(hit: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bounds() of rows end to end, row i from ends[i] to ends[i + 1]: (i, start, end) as columns."""
    size = np.diff(ends)
    some = np.flatnonzero(5 * np.diff(np.concatenate(([0], np.cumsum(hit)))[ends]) >= 4 * run)
    if not len(some):
        return some, some, some
    # Misses between rows that take more than the hits of all rows on their two sides can add.
    wide = int(size[some].max()) * 3 // 2 + 1
    at = np.arange(int(size[some].sum())) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    line = np.zeros(len(some) * wide, bool)
    line[at + np.repeat(np.arange(len(some)) * wide, size[some])] = hit[at + np.repeat(ends[some], size[some])]
    begin, end = bounds(line, run)
    return some[begin // wide], begin % wide, begin % wide + end - begin


def _keyed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists of 32-bit hashes, each with its list's number above it, and where each list begins and ends."""
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    values = np.asarray(lists.flatten()).view(np.uint32).astype(np.uint64)
    return np.repeat(np.arange(len(lists), dtype=np.uint64) << np.uint64(32), np.diff(ends)) | values, ends


def _among(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which keys are in others, too."""
    if not len(others):
        return np.zeros(len(keys), bool)
    others = np.sort(others)
    return others[np.minimum(np.searchsorted(others, keys), len(others) - 1)] == keys


def verified(pairs: DataFrame, run: int) -> DataFrame:
    """pairs (doc0, doc, as, bs, ha, hb) -> (doc, s, e, peer): the stretches of either interval that the other one has."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.slice(lo, 512)
                out: list[tuple[int, int, int, int]] = []
                da, db, sa, sb = (b.column(x).to_numpy().tolist() for x in range(4))
                (ka, ea), (kb, eb) = _keyed(b.column(4)), _keyed(b.column(5))
                for k, ends, other, doc, peer, at in ((ka, ea, kb, da, db, sa), (kb, eb, ka, db, da, sb)):
                    out += [(doc[i], max(0, at[i]) + s, max(0, at[i]) + e, peer[i]) for i, s, e in zip(*(x.tolist() for x in all_bounds(_among(k, other), ends, run)), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], pa.int64()) for x in range(4)], names=["doc", "s", "e", "peer"])

    return pairs.select("doc0", "doc", "as", "bs", "ha", "hb").mapInArrow(go, "doc long, s long, e long, peer long")


def whole_runs(texts: DataFrame, run: int) -> DataFrame:
    """texts (doc, text, begins, done) -> WINDOW rows of the runs that begin in one of the ranges `begins`; sig and salt are 96 bits of the whole run, c its begin; r is 0, and the
    row a mere witness, where the run is inside one of the intervals `done`. Within a batch all but the first of equal runs have that one beside them, or are left out if witnesses."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for a, z in slices(np.diff(offsets), 2 << 20):
                h, ends = shingles(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a])
                at, owner, base, news = [], [], [], []
                for i in range(a, z):
                    first, last = (int(ends[i - a - 1]) if i > a else 0), int(ends[i - a])
                    n = last - first - run + 1
                    if n <= 0:
                        continue
                    wanted, new = np.zeros(n, bool), np.ones(n, bool)
                    for x in b.column(2)[i].as_py():
                        wanted[x["s"] : x["e"] + 1] = True
                    for x in b.column(3)[i].as_py() or ():
                        new[x["s"] : max(x["s"], x["e"] - run + 1)] = False
                    p = np.flatnonzero(wanted)
                    at.append(p + first)
                    news.append(new[p])
                    owner.append(np.full(len(p), ids[i]))
                    base.append(np.full(len(p), first))
                if not at or not sum(map(len, at)):
                    continue
                p, doc, begin, new = (np.concatenate(x) for x in (at, owner, base, news))
                one = _ranges(h, p, p + run).view(np.int64)
                two = _ranges(h ^ (h >> np.uint64(17)) * _FUNC[31, 0], p, p + run).astype(np.uint32).view(np.int32)
                order = np.lexsort((doc, two, one))
                one, two, doc, c, new = one[order], two[order], doc[order], (p - begin)[order], new[order]
                k = _firsts(one, two)
                null = doc[k] == doc
                apart = np.flatnonzero(~null)
                null[apart[np.unique(k[apart], return_index=True)[1]]] = True
                zero, r = np.zeros(len(c), np.int64), np.where(new, run - 1, 0)
                cols, peer = [one, np.where(null, two, doc % 64), zero, doc, c, zero, r], [doc[k], c[k], zero, r[k]]
                keep = np.flatnonzero(null | new)
                for lo in range(0, len(keep), 1 << 18):
                    x = keep[lo : lo + (1 << 18)]
                    yield _window_rows([y[x] for y in cols], [y[x] for y in peer], null[x], zero[x])

    return texts.select("doc", "text", "begins", "done").mapInArrow(go, WINDOW)


def around(texts: DataFrame, run: int) -> DataFrame:
    """texts (doc, text, cs) -> (func, sig, blocks, inside, doc, c, s, h): the shingles around each window's c, from s on, as far as a repeat through c can be told there."""
    reach = 2 * run - 1  # a longer stretch of 80 % hits has a part shorter than this that is one, too

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, (func, sig, blocks, inside, c), h in _cut_out(b, ["func", "sig", "blocks", "inside", "c"], lambda *x: (np.maximum(0, x[-1] - reach), x[-1] + reach + 1)):
                cols = [pa.array(func), pa.array(sig), pa.array(blocks), pa.array(inside.astype(bool)), pa.array(doc), pa.array(c), pa.array(np.maximum(0, c - reach)), h]
                yield pa.RecordBatch.from_arrays(cols, names=["func", "sig", "blocks", "inside", "doc", "c", "s", "h"])

    return texts.select("doc", "text", "cs").mapInArrow(go, "func long, sig long, blocks long, inside boolean, doc long, c long, s long, h array<int>")


def partners(h: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, inside: np.ndarray, run: int) -> np.ndarray:
    """Which rows (end to end in h, `size` shingles each; groups and rows in order) can be one of a pair with a stretch. A stretch has 80 % of a run's shingles in common with one other row,
    so with all other documents of the group, too: rows that haven't so many can't have one, and rows with fewer different ones than any stretch of the group needs can't be the other. Only groups with a row outside are kept."""
    need = -(-run * 4 // 5)
    keep = np.zeros(len(size), bool)
    begin = np.concatenate(([0], np.cumsum(size)))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for lo, hi in _spread(first, len(size), 1 << 11):
        g, d = group[lo:hi] - group[lo], doc[lo:hi]
        n, m = hi - lo, int(g[-1]) + 1
        row = np.repeat(np.arange(n, dtype=np.uint64), size[lo:hi])
        bits = np.uint64(max(1, n.bit_length()))
        if m.bit_length() + 32 + int(bits) > 64:
            raise ValueError("a group of more rows than 32 bits can number")
        v = np.sort((((g.astype(np.uint64)[row.astype(np.int64)] << np.uint64(32)) | h[begin[lo] : begin[hi]]) << bits) | row)
        if not len(v):
            continue
        at = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.concatenate(([True], v[1:] >> bits != v[:-1] >> bits))
        start, owner = np.flatnonzero(new), d[at]
        common = np.repeat(np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start), np.diff(np.append(start, len(v))))
        other = common & np.concatenate(([True], v[1:] != v[:-1]))
        total, different = np.bincount(at[common], minlength=n), np.bincount(at[other], minlength=n)
        can = total >= need
        least = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(least, g[can], np.maximum(1, need - (total - different))[can])
        ok = can | (different >= least[g])
        outside = np.zeros(m, bool)
        outside[g[ok & ~inside[lo:hi]]] = True
        keep[lo:hi] = ok & outside[g]
    return keep


def _spread(first: np.ndarray, n: int, rows: int) -> list[tuple[int, int]]:
    """Ranges of whole groups, which begin at `first`, of about so many rows."""
    cuts = first[np.unique(np.searchsorted(first, np.arange(0, n, rows)).clip(max=len(first) - 1))].tolist()
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def _compared(h: list[np.ndarray], doc: np.ndarray, at: np.ndarray, inside: np.ndarray, side: np.ndarray | None, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, u, v) as columns: stretches [u, v) of row x that row y has, of all pairs of rows (of different sides, if given) of which one is outside; a row whose place `at` comes into a stretch is inside from then on."""
    need, n = -(-run * 4 // 5), len(h)
    if n < 2 or (doc == doc[0]).all():
        return
    before, inside = inside, inside.copy()
    size = np.array([len(x) for x in h])
    begin = np.concatenate(([0], np.cumsum(size)))
    ids = np.unique(np.concatenate(h), return_inverse=True)[1]
    place = np.zeros(int(ids.max()) + 1, np.int64)
    counts = None
    if n > 8:  # shingles by 11 bits of their hash: what two windows share is at most what these tell
        kind = np.float32 if n > 32 else np.int32  # threads of a matrix library are not worth it for few
        counts = np.bincount(np.repeat(np.arange(n) << 11, size) + (np.concatenate(h) & 2047), minlength=n << 11).reshape(-1, 2048).astype(kind)
        seen = (counts > 0).astype(kind)
    open_ = np.flatnonzero(~inside)
    for lo in range(0, len(open_), 256):
        part = open_[lo : lo + 256]
        may = (doc[part][:, None] != doc[None, :]) & (before[None, :] | (np.arange(n)[None, :] > part[:, None]))
        if side is not None:
            may &= side[part][:, None] != side[None, :]
        if counts is not None:
            may &= (counts[part] @ seen.T >= need) | (seen[part] @ counts.T >= need)
        for i, ok in zip(part.tolist(), may, strict=True):
            rest, most = np.flatnonzero(ok), 64
            own = ids[begin[i] : begin[i + 1]]
            different, turn = np.unique(own, return_inverse=True)
            while len(rest):
                if inside[i]:
                    rest = rest[~inside[rest]]
                js, rest, most = rest[:most], rest[most:], 256
                if not len(js):
                    break
                place[different] = np.arange(1, len(different) + 1)
                ends = np.concatenate(([0], np.cumsum(size[js])))
                theirs = place[ids[np.arange(ends[-1]) + np.repeat(begin[js] - ends[:-1], size[js])]]
                place[different] = 0
                has = np.zeros((len(js), len(different) + 1), bool)
                has[np.repeat(np.arange(len(js)), size[js]), theirs] = True
                k, u, v = all_bounds(has[:, turn + 1].ravel(), np.arange(len(js) + 1) * len(own), run)
                yield np.full(len(k), i), js[k], u, v
                inside[i] |= bool(((u <= at[i]) & (at[i] < v)).any())
                k, u, v = all_bounds(theirs > 0, ends, run)
                yield js[k], np.full(len(k), i), u, v
                inside[js[k][(u <= at[js[k]]) & (at[js[k]] < v)]] = True



def _joined(doc: np.ndarray, s: np.ndarray, e: np.ndarray, peer: np.ndarray) -> pa.RecordBatch:
    """Stretches of a document that overlap as one, with the smallest peer."""
    order = np.lexsort((s, doc))
    doc, s, e, peer = (x[order] for x in (doc, s, e, peer))
    apart = np.unique(doc, return_inverse=True)[1].astype(np.int64) << 40
    reach = np.maximum.accumulate(e + apart)
    first = np.flatnonzero(np.concatenate(([True], (s + apart)[1:] >= reach[:-1])))
    cols = (doc[first], s[first], np.maximum.reduceat(e, first), np.minimum.reduceat(peer, first))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["doc", "s", "e", "peer"])


def met(rows: DataFrame, run: int) -> DataFrame:
    """rows of around() -> (doc, s, e, peer): the stretches that windows of one signature have in common, by all pairs of which one is outside every repeat found so far."""
    b = F.pmod(F.xxhash64("doc", "c"), "blocks")
    pairs = rows.withColumn("b", b).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("func", "sig", F.least("b", "p").alias("ba"), F.greatest("b", "p").alias("bb"), "b", "inside", "doc", "c", "s", "h")
    keys = ["func", "sig", "ba", "bb"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys, 1 << 12):
            cols = [t.column(x).to_numpy() for x in keys]
            group = np.cumsum(np.concatenate(([0], np.any([c[1:] != c[:-1] for c in cols], axis=0))))
            b, doc, c, s, inside = (t.column(x).to_numpy() for x in ("b", "doc", "c", "s", "inside"))
            inside = inside.astype(bool)
            lists = t.column("h").combine_chunks()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            flat = np.asarray(lists.flatten())
            rows = np.flatnonzero(partners(flat.view(np.uint32), np.diff(ends), group, doc, inside, run))
            out = []
            for g in np.split(rows, np.flatnonzero(np.diff(group[rows])) + 1) if len(rows) else ():
                side = np.where(b[g] == cols[2][g[0]], 0, 1) if cols[2][g[0]] != cols[3][g[0]] else None
                h = [flat[ends[i] : ends[i + 1]] for i in g]
                out += [(doc[g[x]], s[g[x]] + u, s[g[x]] + v, doc[g[y]]) for x, y, u, v in _compared(h, doc[g], c[g] - s[g], inside[g], side, run) if len(x)]
            if out:
                yield _joined(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, "doc long, s long, e long, peer long")


IVS = "array<struct<s:bigint,e:bigint>>"


def _merged(ivs: Column) -> Column:
    """Sorted intervals with those that touch joined."""
    head = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    joined = lambda acc, x: F.concat(head(acc), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))
    return F.aggregate(ivs, F.array().cast(IVS), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), joined(acc, x)).otherwise(F.concat(acc, F.array(x))))


def _beside(docs: DataFrame, wanted: DataFrame, size: Column, most: int) -> DataFrame:
    """docs with what is wanted of them: broadcast, so that texts stay where they are, if its `size` (entries of up to 24 bytes) sums up to `most` bytes or less; else joined."""
    total = wanted.agg(F.sum(size)).first()[0] or 0
    return docs.join(F.broadcast(wanted) if total * 24 <= most else wanted, "doc")


def repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 50, hashes: int = 5, enough: int = 2, small: int = 64 << 20) -> DataFrame:
    """id, n_spans, n_words (in spans), spans (start:end in words, end exclusive, comma-joined), peer (smallest id of a document linked to), one row per row of df.

    small: up to so many bytes of wanted positions are broadcast to the texts, beyond that texts are joined to them."""
    ship(df.sparkSession)
    run = least - SHINGLE + 1
    given = df.select(df[id_col].alias("id"), df[text].cast("string").alias("text"))
    with tidy(df.sparkSession):
        plain = not given.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
        if plain:
            docs = given.select(F.col("id").cast("long").alias("doc"), "text")
        else:  # rows are documents by id and text, known by number
            docs = cut(cut(given.distinct()).select(F.monotonically_increasing_id().alias("doc"), "id", "text"))
        found = cut(_spans(docs.select("doc", "text").where("text is not null"), run, hashes, enough, small))
    per = found.groupBy("doc").agg(_merged(F.array_sort(F.collect_list(F.struct("s", (F.col("e") + SHINGLE - 1).alias("e"))))).alias("m"), F.min("peer").alias("peer"))
    if plain:
        out = given.select("id").join(per, given["id"].cast("long") == F.col("doc"), "left")
    else:
        names = docs.select("doc", "id", F.sha2("text", 256).alias("h"))
        peers = found.join(names.select(F.col("doc").alias("peer"), F.col("id").cast("long").alias("name")), "peer").groupBy("doc").agg(F.min("name").alias("peer"))
        per = names.join(per.drop("peer"), "doc").join(peers, "doc", "left")
        own = given.select(F.col("id").alias("__id"), F.sha2("text", 256).alias("__h"))
        out = own.join(per, own["__id"].eqNullSafe(per["id"]) & (own["__h"] == per["h"]), "left").drop("id").withColumnRenamed("__id", "id")
    m = F.coalesce("m", F.array().cast(IVS))
    words = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select(F.col("id").alias(id_col), F.size(m).cast("long").alias("n_spans"), words.alias("n_words"), F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"), "peer")


def _spans(docs: DataFrame, run: int, hashes: int, enough: int, small: int) -> DataFrame:
    """docs (doc, unique; text) -> (doc, s, e, peer): repeats in shingles, e exclusive."""
    links = store(link(compact(docs, run, hashes), run, near=True), "passages-links")
    # Intervals on a diagonal of two documents, near ones taken together, widened to a grid so that a document has few different ones.
    lo = lambda c: (F.floor(c / GRID) * GRID).cast("long")
    hi = lambda c: ((F.floor(c / GRID) + 1) * GRID).cast("long")
    cand = overlapping(links.where("func >= 0"), enough, run).groupBy("doc0", "doc", "diag", F.floor(F.col("s0") / PART).alias("part")).agg(F.min("s0").alias("s0"), F.max("e0").alias("e0"))
    cand = store(cand.select("doc0", "doc", lo(F.col("s0")).alias("as"), hi(F.col("e0")).alias("ae"), lo(F.col("s0") + F.col("diag")).alias("bs"), hi(F.col("e0") + F.col("diag")).alias("be")).distinct(), "passages-pairs")
    sides = cand.select(F.col("doc0").alias("doc"), F.col("as").alias("s"), F.col("ae").alias("e")).unionByName(cand.select("doc", F.col("bs").alias("s"), F.col("be").alias("e")))
    need = store(sides.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("ivs")), "passages-need")  # as many as the grid of one document allows
    shown = evidence(_beside(docs, need, F.size("ivs") + 1, small))
    ea = shown.select(F.col("doc").alias("doc0"), F.col("s").alias("as"), F.col("e").alias("ae"), F.col("h").alias("ha"))
    eb = shown.select("doc", F.col("s").alias("bs"), F.col("e").alias("be"), F.col("h").alias("hb"))
    spans = cut(verified(cand.join(ea, ["doc0", "as", "ae"]).join(eb, ["doc", "bs", "be"]), run).groupBy("doc", "s", "e").agg(F.min("peer").alias("peer")))
    # What partners could not decide: runs outside these stretches, whole, with all that share their node's signature.
    done = spans.groupBy("doc").agg(_merged(F.array_sort(F.collect_list(F.struct("s", "e")))).alias("done"))
    marks = links.where(F.col("func") == MARK).select("doc", "s0", "e0", F.col("diag").alias("sig")).distinct().join(done, "doc", "left")
    inside = F.exists(F.coalesce("done", F.array().cast(IVS)), lambda d: (d["s"] <= F.col("s0")) & (d["e"] >= F.col("e0") + run))
    open_ = marks.where(~inside).select("sig").distinct()
    wanted = marks.join(open_, "sig", "left_semi").groupBy("doc").agg(F.collect_set(F.struct(F.col("s0").alias("s"), F.col("e0").alias("e"))).alias("begins"), F.first("done").alias("done"))
    wanted = store(wanted, "passages-open")
    rest = link(whole_runs(_beside(docs, wanted, F.size("begins") + F.size(F.coalesce("done", F.array().cast(IVS))) + 1, small), run), run).where(F.col("func") == MARK)
    spans = cut(spans.unionByName(rest.select("doc", F.col("s0").alias("s"), (F.col("s0") + run).alias("e"), F.col("doc0").alias("peer")).groupBy("doc", "s", "e").agg(F.min("peer").alias("peer"))))
    # What is still outside: windows of all functions against all others of their signature.
    done = spans.groupBy("doc").agg(_merged(F.array_sort(F.collect_list(F.struct("s", "e")))).alias("done"))
    inside = F.exists(F.coalesce("done", F.array().cast(IVS)), lambda d: (d["s"] <= F.col("c")) & (d["e"] > F.col("c")))
    marks = links.where(F.col("func") <= NEAR).select((NEAR - F.col("func")).cast("long").alias("func"), F.col("diag").alias("sig"), "doc", F.col("s0").alias("c")).repartition("doc").distinct().join(done, "doc", "left").withColumn("inside", inside).drop("done")
    sizes = marks.groupBy("func", "sig").agg(F.count("*").alias("n"), F.min("inside").alias("all")).where("not all").select("func", "sig", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    wanted = store(marks.join(sizes, ["func", "sig"]).groupBy("doc").agg(F.collect_list(F.struct("func", "sig", "c", "blocks", "inside")).alias("cs")), "passages-near")
    discard(links, cand, need)
    return spans.unionByName(met(around(_beside(docs, wanted, 2 * F.size("cs") + 1, small), run), run).groupBy("doc", "s", "e").agg(F.min("peer").alias("peer")))
