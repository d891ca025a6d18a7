"""Byte-level BPE encoding and decoding by vectorised pre-tokenisation.

Pieces are found without a regular expression: every code point gets a class, every class is a
transition function of a small automaton, and the state before each code point is the composition of
all functions before it. Composition is associative, so it is computed as a blocked scan over table
lookups (`_scan`). The pieces, as slices of the UTF-8 buffer, are dictionary-encoded; each distinct piece
is merged once per worker and cached. Token byte lengths give the offsets from which text is decoded.

Defined results: null text is treated as empty; an empty text has no tokens, and decodes to no bytes.
Repeated rows give repeated results; other columns, whatever their names, pass through only when
asked for with `keep`. Texts are processed whole in slices bounded by bytes, a longer text alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import ship

# Symbols: letter, number, other, space, other white space, apostrophe of a contraction with one / two letters.
L, N, O, SP, WS, A1, A2 = range(7)
# States: boundary, letters, numbers, others, after space, after other white space, two / one letters to go.
S0, SL, SN, SO, SSP, SWS, C2, C1 = range(8)
NSYM, NST = 7, 8
BLOCK = 64
NONE = np.int32(2**31 - 1)


def _step(s: int, y: int) -> int:
    if y == L:
        return {C2: C1, C1: S0}.get(s, SL)
    if y == N:
        return SN
    if y == SP:
        return SSP
    if y == WS:
        return SWS
    if y == O or s in (SO, SSP):
        return SO
    return C1 if y == A1 else C2


def _starts(s: int, y: int) -> bool:
    """Whether a piece starts here; the last white space before other text is decided by the caller."""
    if y == L:
        return s not in (SL, SSP, C1, C2)
    if y == N:
        return s not in (SN, SSP)
    if y in (SP, WS):
        return s not in (SSP, SWS)
    return s not in (SO, SSP)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the generators, table of compositions, and each function's value at the start state."""
    gens = [tuple(_step(s, y) for s in range(NST)) for y in range(NSYM)]
    gens += [tuple(g[S0] for _ in range(NST)) for g in gens]  # the same symbol as first of a text
    ident = tuple(range(NST))
    ids, todo = {ident: 0}, [ident]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    fs = list(ids)
    comp = np.array([[ids[tuple(b[x] for x in a)] for b in fs] for a in fs], dtype=np.uint16)
    return np.array([ids[g] for g in gens], np.uint16), comp, np.array(fs, np.uint8)


_GEN, _COMP, _FUN = _monoid()
_M = len(_COMP)
_COMPF = np.ascontiguousarray(_COMP.ravel())
_START = np.array([[_starts(s, y) for y in range(NSYM)] for s in range(NST)], dtype=bool).ravel()
_CLASS: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of each code point, from Unicode general categories and White_Space."""
    global _CLASS
    if _CLASS is None:
        t = np.full(0x110000, O, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                t[cp] = L
            elif c == "N":
                t[cp] = N
        # Unicode White_Space.
        for cp in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            t[cp] = WS
        t[0x20] = SP
        _CLASS = t
    return _CLASS


def _scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of function ids."""
    n = len(f)
    if n <= BLOCK:
        out, acc = np.empty(n, np.uint16), 0
        for i in range(n):
            acc = _COMPF[acc * _M + int(f[i])]
            out[i] = acc
            acc = int(acc)
        return out
    rows = -(-n // BLOCK)
    pad = np.zeros(rows * BLOCK, np.uint16)
    pad[:n] = f
    cols = np.ascontiguousarray(pad.reshape(rows, BLOCK).T)
    acc = cols[0].astype(np.int32)
    for j in range(1, BLOCK):
        acc = _COMPF[acc * _M + cols[j]].astype(np.int32)
        cols[j] = acc
    carry = np.zeros(rows, np.int32)
    carry[1:] = _scan(cols[-1])[:-1]
    return np.ascontiguousarray(_COMPF[carry[None, :] * _M + cols].T).ravel()[:n]


def piece_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a piece starts. first: flags of the first code point of each text."""
    n = len(cps)
    sym = class_table()[cps]
    inside = np.empty(n, bool)  # the next code point is of the same text
    inside[:-1] = ~first[1:]
    inside[-1:] = False
    at = np.flatnonzero((cps == 0x27) & inside)
    if len(at):
        a = cps[at + 1]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        sym[at[one]] = A1
        two = at[~one]
        two = two[two + 2 < n]
        two = two[inside[two + 1]]
        a, b = cps[two + 1], cps[two + 2]
        ok = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        sym[two[ok]] = A2
    f = _GEN[sym + np.where(first, NSYM, 0).astype(np.uint8)]
    after = _FUN[_scan(f), S0]
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[first] = S0
    flags = _START[before * np.uint8(NSYM) + sym]
    white = (sym == SP) | (sym == WS)
    follows = np.zeros(n, bool)
    follows[:-1] = inside[:-1] & ~white[1:]
    return flags | (white & follows)


class Codec:
    """Ranks, pair table and piece cache; one per worker process and vocabulary."""

    CACHE = 200_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.vocab[r] = b
        self.vlen = np.fromiter(map(len, self.vocab), np.int64, len(self.vocab))
        self.vstart = np.concatenate(([0], np.cumsum(self.vlen)[:-1]))
        self.blob = np.frombuffer(b"".join(self.vocab), np.uint8)
        keys, vals = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    vals.append(r)
        order = np.argsort(k := np.array(keys, np.int64))
        self.keys, self.vals = k[order], np.array(vals, np.int32)[order]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[bytes, bytes] = {}

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.vals[at], NONE)

    def _merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """All pieces at once: in every round each piece merges its leftmost pair of least rank."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte[raw]
        cols = np.arange(width)
        rank = self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rank[cols[None, : width - 1] >= size[:, None] - 1] = NONE
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        while len(rows):
            pos = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), pos]
            done = best == NONE
            if done.any():
                for r, x, k in zip(rows[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[r] = x[:k].astype("<u4").tobytes()
                go = ~done
                rows, ids, rank, size, pos, best = rows[go], ids[go], rank[go], size[go], pos[go], best[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, pos] = best
            shift = np.minimum(cols[None, :] + (cols[None, :] > pos[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            size = size - 1
            shift = np.minimum(cols[None, : width - 1] + (cols[None, : width - 1] > pos[:, None]), width - 2)
            rank = np.take_along_axis(rank, shift, 1)
            rank[:, -1] = NONE
            left = pos > 0
            rank[k[left], pos[left] - 1] = self._pair(ids[k[left], pos[left] - 1], best[left])
            right = pos < size - 1
            rank[k[right], pos[right]] = self._pair(best[right], ids[k[right], pos[right] + 1])
            rank[k[~right], np.minimum(pos[~right], width - 2)] = NONE
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """One piece with a heap and a linked list: n log n."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, vocab = len(ids), self.ranks, self.vocab
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (r := ranks.get(vocab[ids[i]] + vocab[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            if ids[i] != x or nxt[i] >= n or ids[nxt[i]] != y:
                continue
            j = nxt[i]
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers, by way of the cache."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if new:
            if len(cache) + len(new) > self.CACHE:  # bounded memory; what is dropped is merged again when needed
                cache.clear()
                new = pieces
            by: dict[int, list[bytes]] = {}
            for p in new:
                if len(p) == 1:
                    cache[p] = self.byte[p[0]].astype("<u4").tobytes()
                elif (r := self.ranks.get(p)) is not None:
                    cache[p] = r.to_bytes(4, "little")
                elif len(p) > 64:
                    cache[p] = self._merge_long(p)
                else:
                    by.setdefault(next(w for w in (8, 16, 32, 64) if len(p) <= w), []).append(p)
            for width, group in by.items():
                cache.update(zip(group, self._merge_short(group, width), strict=True))
        return [cache[p] for p in pieces]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: UTF-8 of several texts end to end, ends: where each ends. Returns ids, and each text's end in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], ends[:-1]))
        first = np.zeros(len(cps), bool)
        first[np.searchsorted(at, begins[ends > begins])] = True
        begin = at[piece_starts(cps, first)]
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        index = pieces.indices.to_numpy()
        coded = self.merge(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        flat = np.frombuffer(b"".join(coded), "<u4")
        where, count = (np.cumsum(size) - size)[index], size[index]
        total = np.cumsum(count)
        ids = flat[np.repeat(where - (total - count), count) + np.arange(total[-1])]
        upto = np.searchsorted(begin, ends)
        return ids, np.concatenate(([0], total))[upto]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids end to end, and the byte offset at which each id's bytes end."""
        count = self.vlen[ids]
        total = np.cumsum(count)
        if not len(ids):
            return np.zeros(0, np.uint8), total
        return self.blob[np.repeat(self.vstart[ids] - (total - count), count) + np.arange(total[-1])], total


def load_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}


_CODECS: dict[str, Codec] = {}


def codec(blob: bytes) -> Codec:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(blob))
    return _CODECS[key]


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes together, a longer row alone."""
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string column; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    col = pa.concat_arrays([col]) if col.offset else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8), offsets


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "ids_le": T.BinaryType(),
    "ends": T.ArrayType(T.LongType(), False),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
}


def encode(df: DataFrame, rank_file: str, text: str = "text", keep: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("ids",), slice_bytes: int = 1 << 20) -> DataFrame:
    """The `keep` columns and, of OUTPUTS: ids; ids_le, their little-endian bytes; ends, the byte offset at which
    each token's bytes end; decoded, the bytes that the ids decode to; n_tokens."""
    spark = df.sparkSession
    ship(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB whatever the corpus
    keep, outputs = list(keep), list(outputs)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            data, offsets = utf8(b.column(len(keep)))
            for lo, hi in slices(np.diff(offsets), slice_bytes):
                part = data[offsets[lo] : offsets[hi]]
                ids, ends = c.encode(part, offsets[lo + 1 : hi + 1] - offsets[lo])
                cuts = np.concatenate(([0], ends))
                cols: list[pa.Array] = [b.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                back = byte_ends = None
                if "decoded" in outputs or "ends" in outputs:
                    back, byte_ends = c.decode(ids)
                    at = np.concatenate(([0], byte_ends))[cuts]
                for o in outputs:
                    if o == "ids":
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    elif o == "ids_le":
                        cols.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]))
                    elif o == "ends":
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(byte_ends - np.repeat(at[:-1], np.diff(cuts)))))
                    elif o == "decoded":
                        cols.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(back)]))
                    else:
                        cols.append(pa.array(np.diff(cuts)))
                yield pa.RecordBatch.from_arrays(cols, names=keep + outputs)

    return df.select(*[df[k] for k in keep], df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and `decoded`, the bytes that the array of ids decodes to; null gives no bytes."""
    spark = df.sparkSession
    ship(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            rows = [c.decode(np.array(x or [], np.int64))[0].tobytes() for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(rows, pa.binary())], names=[*keep, "decoded"])

    return df.select(*[df[k] for k in keep], df[ids].alias("__ids")).mapInArrow(run, schema)
