"""Vector best-fit packing of tokenised documents into sequences.

Every sequence has three capacities: tokens, documents, and attention cost (the sum of the squares of its pieces' lengths, what
attention inside documents costs). A piece takes its length, one document and its length squared of them, and goes where all three fit:

* rule "norm": of the open sequences the one whose weighted residual, as fractions of the capacities, is shortest after the piece;
* rule "dot": one sequence after the other is filled, each time with the piece whose demand has the largest weighted dot product with its residual;
* rule "fewest": both are planned, the plan of fewer sequences is taken.

Pieces of one length are alike, so the plan is made for lengths and their counts, longest first. Sequences with the same residual are one class, a
few ranges of sequence numbers, and a step of the plan gives `per` pieces of one length to each sequence of a range: what best-fit does piece by piece,
in steps that depend on the lengths and residuals that occur (at most `tokens` lengths) and not on the number of documents. On the driver are the counts by length and the steps only.
Pieces are numbered inside their length by two-level counts (buckets of bounded size), so a length that a third of all pieces have is no single task's work; a
piece's length and number give its step, and thereby its sequence and offset.

Token ids come from a `tokenizers` vocabulary. Texts are cut at white space and where the vocabulary's pattern always cuts between ASCII characters; each distinct
piece of text is encoded once a worker and kept in a bounded cache.

Defined results: null text is empty: it has its end id only. Repeated and null ids are packed row by row. A document longer than a sequence, and only that, is cut into pieces of `tokens`
ids (of the root of `cost`, if that is less), the last may be shorter. Other columns are ignored, so their names can't clash. Empty tables give no rows.
pack() gives a null sequence to pieces of no tokens (null or below 1) and to pieces that fit no empty sequence.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, utf8
from .runtime import ship, store

# Classes of bytes: white space, letter, digit, punctuation, apostrophe, beyond ASCII.
WHITE, LETTER, DIGIT, PUNCT, APOSTROPHE, HIGH = range(6)
_CLASS = bytes(WHITE if b in b" \t\n\r\x0b\x0c" else HIGH if b > 127 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else APOSTROPHE if b == 39 else PUNCT for b in range(256))


def _cut_between(a: int, b: int) -> bool:
    """Whether a cut between two neighbours never changes ids: no pattern match, no normal form and no lower-casing crosses it.
    An apostrophe may begin a contraction, and characters beyond ASCII may be of any kind or combine with the one before."""
    if WHITE in (a, b):
        return True
    if HIGH in (a, b) or (a, b) == (APOSTROPHE, LETTER) or {a, b} == {PUNCT, APOSTROPHE}:
        return False
    return a != b or a == DIGIT


#: By 8 times a byte's class plus the next one's: 1 if a piece of text begins at the next, 2 if one ends before it, 3 if both.
_CUT = bytes(2 * (a != WHITE) if b == WHITE else (1 + 2 * (a != WHITE) if _cut_between(a, b) else 0) for a, b in (divmod(i, 8) for i in range(256)))
#: One match of the vocabulary's pattern: letters whose lower case and normal form are letters, one digit, or ASCII punctuation.
_ONE = re.compile(rb"[A-Za-z]+|[0-9]|[!-&(-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+|(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+")


class Tokens:
    """A vocabulary with a bounded cache of encoded pieces of text; one per worker process."""

    CACHE = 400_000
    CACHE_BYTES = 16 << 20  # of pieces and ids: text without cuts, such as Japanese, makes long pieces

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.held = 0  # bytes of pieces and ids in the cache

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        e = self.tokenizer.encode([p.decode("utf-8") for p in pieces], is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(pieces)), "right") * 4
        return self._parts(np.array(e.ids, "<u4"), ends)

    @staticmethod
    def _parts(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        blob, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_single(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of one match each, as one text: each ends with an id that is the end of a word."""
        e = self.tokenizer.encode_batch_fast([b" ".join(pieces).decode("utf-8")], add_special_tokens=False)[0]
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return self._parts(ids, ends * 4) if len(ends) == len(pieces) else self._encode(pieces)

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian unsigned 32-bit."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if new:
            if len(cache) + len(new) > self.CACHE or self.held + sum(map(len, new)) > self.CACHE_BYTES:  # bounded memory: what these texts share with those before stays, the rest is encoded again when needed
                cache = self.cache = {p: cache[p] for p in pieces if p in cache}
                self.held = sum(map(len, cache)) + sum(map(len, cache.values()))
            one = _ONE.fullmatch
            single = [p for p in new if one(p)]
            rest = list(set(new).difference(single)) if len(single) < len(new) else []
            for group, how in ((single, self._encode_single), (rest, self._encode)):
                for i in range(0, len(group), 4096):
                    part = group[i : i + 4096]
                    ids = how(part)
                    cache.update(zip(part, ids, strict=True))
                    self.held += sum(map(len, part)) + sum(map(len, ids))
        return [cache[p] for p in pieces]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: UTF-8 of several texts end to end, ends: where each ends. Returns ids, and each text's end in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        kind = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
        cut = np.zeros(len(data) + 1, np.uint8)
        cut[1:-1] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_CUT), np.uint8)
        texts = np.append(0, ends[:-1])
        texts = texts[texts < len(data)]
        cut[texts] = (kind[texts] != WHITE) + 2 * ((kind[texts - 1] != WHITE) & (texts > 0))
        cut[-1] = 2 * (kind[-1] != WHITE)
        begin, stop = np.flatnonzero(cut & 1), np.flatnonzero(cut & 2)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        offsets = np.append(np.stack([begin, stop], 1).ravel(), stop[-1]).astype(np.int32)
        gaps = pa.Array.from_buffers(pa.binary(), 2 * len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        pieces = gaps.take(pa.array(np.arange(0, 2 * len(begin), 2, dtype=np.int32))).dictionary_encode()
        index = pieces.indices.to_numpy()
        coded = self.lookup(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        flat = np.frombuffer(b"".join(coded), "<u4")
        where, count = (np.cumsum(size) - size)[index], size[index]
        total = np.cumsum(count)
        ids = flat[np.repeat(where - (total - count), count) + np.arange(total[-1])]
        return ids, np.concatenate(([0], total))[np.searchsorted(begin, ends)]


_TOKENS: dict[str, Tokens] = {}


def tokens_of(vocabulary: bytes) -> Tokens:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(vocabulary)
    return _TOKENS[key]


def pieces(df: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text: str = "text", longest: int = 4096, end_id: int = 1, with_ids: bool = False, slice_bytes: int = 1 << 20) -> DataFrame:
    """One row per piece: id, piece (from 0), start (ids of its document before it), length, ids_crc32; with_ids: ids_le too, the ids as little-endian bytes."""
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary_file, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a vocabulary file: about 2 MB whatever the corpus
    more = [T.StructField("ids_le", T.BinaryType())] if with_ids else []
    whole = T.LongType()
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", whole), T.StructField("length", whole), T.StructField("ids_crc32", whole), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens_of(vocabulary.value)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(np.diff(offsets), slice_bytes):
                ids, ends = t.encode(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends = ends + np.arange(1, hi - lo + 1)
                total = np.diff(ends, prepend=0)
                n = -(-total // longest)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * longest
                length = np.minimum(total[row] - start, longest)
                at = (ends - total)[row] + start
                blob = memoryview(ids.tobytes())
                parts = [blob[x : x + y] for x, y in zip((at * 4).tolist(), (length * 4).tolist(), strict=True)]
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(map(bytes, parts), pa.binary())] if with_ids else []), names=schema.names)

    return df.select(df[id_col].alias("id"), df[text].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


# --- the plan ----------------------------------------------------------------------------------------------------------

#: A step: pieces numbered first .. first + n - 1 of a length go to sequences from `bin` on, `per` in each, the first of them at `offset`.
Step = tuple[int, int, int, int, int, int]  # length, first, n, bin, per, offset


def fits(length: int, tokens: int, docs: int, cost: int) -> int:
    """How many pieces of a length a residual holds."""
    return min(tokens // length, docs, cost // (length * length))


def plan_norm(counts: dict[int, int], tokens: int, docs: int, cost: int, weights: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[list[Step], int]:
    """Best-fit by residual norm, longest pieces first: (steps, number of sequences)."""
    full = np.array([tokens, docs, cost], float)
    w = np.array(weights, float) / full**2
    left = np.zeros((64, 3), np.int64)  # residuals of classes; a class without ranges has no tokens left
    ranges: list[list[tuple[int, int]]] = []  # of sequences: first, number
    known: dict[tuple[int, int, int], int] = {}
    steps: list[Step] = []
    bins = 0

    def put(state: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal left
        i = known.get(state)
        if i is None:
            i = known[state] = len(ranges)
            if i == len(left):
                left = np.concatenate([left, np.zeros_like(left)])
            ranges.append([])
        left[i] = state
        ranges[i].append((first, n))

    for length in sorted(counts, reverse=True):
        rest, first = counts[length], 0
        need = np.array([length, 1, length * length])
        while rest:
            open_ = left[: len(ranges)]
            able = np.flatnonzero((open_ >= need).all(axis=1))
            if len(able):
                i = int(able[np.argmin((w * (open_[able] - need) ** 2).sum(axis=1))])
                r, q, a = map(int, left[i])
                start, n = ranges[i].pop()
                if not ranges[i]:
                    left[i] = 0
            else:
                r, q, a = tokens, docs, cost
                start, n = bins, -(-rest // fits(length, r, q, a))
                bins += n
            # A sequence that takes a piece is then the best for the next one: all its residuals are less.
            per = fits(length, r, q, a)
            for k, m in ((per, min(n, rest // per)), (rest % per, 1)):
                if k and m and n and rest:
                    m = min(m, n)
                    steps.append((length, first, m * k, start, k, tokens - r))
                    put((r - k * length, q - k, a - k * length * length), start, m)
                    first, rest, start, n = first + m * k, rest - m * k, start + m, n - m
            if n:
                put((r, q, a), start, n)
    return steps, bins


def plan_dot(counts: dict[int, int], tokens: int, docs: int, cost: int, weights: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[list[Step], int]:
    """Sequences filled one after the other by dot product: (steps, number of sequences). A filling is repeated as often as the counts allow."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    rest = np.array([counts[int(x)] for x in lengths], np.int64)
    used = np.zeros_like(rest)
    full = np.array([tokens, docs, cost], float)
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)
    w = need * (np.array(weights, float) / full**2)
    steps: list[Step] = []
    bins = 0
    while (rest > 0).any():
        r, spare, filling = np.array([tokens, docs, cost], np.int64), rest.copy(), []
        while len(able := np.flatnonzero((spare > 0) & (need <= r).all(axis=1))):
            # All demands grow with the length, so as the residual shrinks the same length stays the best while it fits.
            i = int(able[np.argmax(w[able] @ r)])
            k = min(fits(int(lengths[i]), *map(int, r)), int(spare[i]))
            filling.append((i, k, tokens - int(r[0])))
            r, spare[i] = r - k * need[i], spare[i] - k
        times = min(int(rest[i]) // k for i, k, _ in filling)
        for i, k, offset in filling:
            steps.append((int(lengths[i]), int(used[i]), times * k, bins, k, offset))
            used[i] += times * k
            rest[i] -= times * k
        bins += times
    return steps, bins


def plan(counts: dict[int, int], tokens: int, docs: int, cost: int, rule: str = "fewest", weights: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[list[Step], int]:
    made = [f(counts, tokens, docs, cost, weights) for name, f in (("norm", plan_norm), ("dot", plan_dot)) if rule in (name, "fewest")]
    return min(made, key=lambda x: x[1])


def pack(df: DataFrame, tokens: int = 4096, docs: int | None = None, cost: int | None = None, rule: str = "fewest", weights: Sequence[float] = (1.0, 1.0, 1.0), bucket: int = 1000, most_buckets: int = 100_000, small: int = 1_000_000) -> DataFrame:
    """df, which has a column `length`, with sequence_id and offset. docs, cost: by default what no sequence of so many tokens can exceed.

    A length has buckets of about `bucket` rows, or `most_buckets` larger ones. small: up to so many buckets are broadcast with the number of rows before them; beyond, they are joined."""
    docs, cost = docs or tokens, cost or tokens * tokens
    most = min(tokens, math.isqrt(cost))
    ship(df.sparkSession)
    # Written first, with a number per row: what is counted and what is placed are then the same rows, whatever executor is lost.
    rows = store(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df["length"].cast("long").alias("length"), F.monotonically_increasing_id().alias("rid")), "packing")
    sized = rows.where(F.col("length").between(1, most))
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    steps, _ = plan(counts, tokens, docs, cost, rule, weights)
    buckets = {x: min(-(-n // bucket), most_buckets) for x, n in counts.items()}
    parts = df.sparkSession.createDataFrame(list(buckets.items()), "length long, buckets long")
    spread = rows.join(F.broadcast(parts), "length", "left").withColumn("bucket", F.pmod(F.xxhash64("rid"), F.coalesce("buckets", F.lit(1))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = spread.where("buckets is not null").groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid"))
    placed = spread.where("buckets is not null").withColumn("number", number).join(F.broadcast(per) if sum(buckets.values()) <= small else per, ["length", "bucket"])
    placed = placed.select("row", "length", (F.col("base") + F.col("number") - 1).alias("rank"))
    table = df.sparkSession.sparkContext.broadcast(np.array(sorted(steps), np.int64).reshape(-1, 6))
    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        keys = (s[:, 0] << 44) + s[:, 1]
        for b in batches:
            if len(b):
                length, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
                x = s[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
                nth = rank - x[:, 1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 3] + nth // x[:, 4]), pa.array(x[:, 5] + nth % x[:, 4] * length)], names=schema.names)

    out = placed.mapInArrow(run, schema)
    none = rows.where(~F.coalesce(F.col("length").between(1, most), F.lit(False))).select("row", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return out.unionByName(none).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, n_tokens, ids_le: whole sequences of pack()'s rows with `ids_le`. A group is one sequence, bounded by its capacity."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids_le")))
    out = packed.where("sequence_id is not null").groupBy("sequence_id").agg(part.alias("parts"), F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"))
    return out.select("sequence_id", "n_pieces", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids_le"])).alias("ids_le"))
