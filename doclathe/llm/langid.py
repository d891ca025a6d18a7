"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 code points) of the whole text, lower-cased, with everything but letters read as one
space; weights are (1 + log tf) * idf, scaled to length one. Document frequencies are counted over all labelled training rows, on the
executors. The classifier is fitted on at most about `train_rows` labelled rows (chosen by hash, evenly by language; the only bounded
sample here) with follow-the-regularised-leader and elastic-net penalties, so most weights are exactly zero. A fifth of the sample is
kept back to calibrate the softmax by one temperature. Model and frequencies have a fixed size, `DIM` by languages.

Defined results: null texts and texts without a letter are `und` with score 0. With no labelled rows everything is `und`. One language:
it is always predicted, score 1. Repeated rows weigh as often as they occur. Only id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import L, class_table
from .runtime import ship

BITS = 15
DIM = 1 << BITS
ORDERS = 3
CHUNK = 1 << 20
# Odd multipliers of the n-gram hash.
MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and how often each occurs; nothing if there is no letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, parts, carry, letters = class_table(), [], np.array([32], np.uint32), False
    dense, many = None, len(text) > 256
    for lo in range(0, len(text), CHUNK):
        cps = np.frombuffer(text[lo : lo + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        isl = table[cps] == L
        letters = letters or bool(isl.any())
        cps = np.where(isl, cps, 32).astype(np.uint32)
        both = np.concatenate((carry, cps))
        k = len(carry)
        fresh = np.ones(len(both), bool)
        fresh[k:] = (both[k:] != 32) | (both[k - 1 : -1] != 32)
        both = both[fresh]
        h, idx = np.zeros(len(both), np.uint32), []
        for n in range(ORDERS):
            if len(both) - n <= 0:
                break
            h = (h[: len(both) - n] ^ both[n:]) * MULT[n]
            h ^= h >> np.uint32(15)
            new = max(0, k - n)  # grams that end in the carried part were counted before
            idx.append((h[new:] * MULT[2]) >> np.uint32(32 - BITS))
        got = np.concatenate(idx)
        if many:
            part = np.bincount(got, minlength=DIM)
            dense = part if dense is None else dense + part
        else:
            parts.append(got)
        carry = both[-(ORDERS - 1) :]
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if dense is not None:
        nz = np.flatnonzero(dense)
        return nz, dense[nz]
    nz, cnt = np.unique(np.concatenate(parts), return_counts=True)
    return nz.astype(np.int64), cnt


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    w: np.ndarray  # DIM + 1 by languages; the last row is the bias
    temperature: float = 1.0

    def vector(self, nz: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        x = (1 + np.log(cnt)) * self.idf[nz]
        return x / np.sqrt(x @ x)

    def logits(self, nz: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        return self.vector(nz, cnt) @ self.w[nz] + self.w[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        nz, cnt = ngram_counts(text)
        if not len(nz) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(nz, cnt) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, model: Model, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights by FTRL-proximal: per coordinate, the closed-form minimum of the linearised losses so far plus l1 |w| + l2 w^2 / 2."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    xs = [(np.append(nz, DIM), np.append(model.vector(nz, c), 1.0), y) for nz, c, y in rows]

    def solve(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in xs:
            zz, nn = z[at], n[at]
            w = solve(zz, nn)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            n2 = nn + g * g
            z[at] = zz + g - (np.sqrt(n2) - np.sqrt(nn)) / alpha * w
            n[at] = n2
    return solve(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    nll = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if nll(a) <= nll(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", train_rows: int = 4000, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> Model:
    """Learn from df's rows with a label. train_rows: bound of the rows that fit the weights, in expectation; document frequencies take all rows."""
    ship(df.sparkSession)
    d = df.select(df[id_col].cast("string").alias("id"), df[text].cast("string").alias("text"), df[label].cast("string").alias("label")).where("label is not null")
    per = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}  # one row per language
    langs = sorted(per)
    if not langs:
        return Model([], np.ones(DIM), np.zeros((DIM + 1, 0)))
    each = train_rows / len(langs)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, docs = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0):
                nz, _ = ngram_counts(t.as_py())
                df_[nz] += 1
                docs += len(nz) > 0
        nz = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(nz, DIM)), pa.array(np.append(df_[nz], docs))], names=["f", "n"])

    got = d.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(DIM + 1)
    freq[got["f"].to_numpy()] = got["n"].to_numpy()
    idf = np.log((1 + freq[DIM]) / (1 + freq[:DIM])) + 1

    rate = F.coalesce(*[F.when(F.col("label") == x, F.lit(min(1.0, each / per[x]))) for x in langs])
    order = F.xxhash64("id", "label")
    sample = d.withColumn("o", order).where(F.pmod(F.col("o"), F.lit(1 << 30)) < rate * (1 << 30)).select("o", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [ngram_counts(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32) for x, _ in both], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in both], pa.list_(pa.int32()))], names=["o", "label", "nz", "cnt"])

    rows = sample.mapInArrow(features, "o long, label string, nz array<int>, cnt array<int>").toArrow()
    model = Model(langs, idf, np.zeros((DIM + 1, len(langs))))
    place = {x: i for i, x in enumerate(langs)}
    data = []
    for i in np.argsort(rows["o"].to_numpy(), kind="stable").tolist():
        nz = np.array(rows["nz"][i].values, np.int64)
        if len(nz):
            data.append((nz, np.array(rows["cnt"][i].values, np.float64), place[rows["label"][i].as_py()]))
    fit, held = ([r for j, r in enumerate(data) if j % 5], data[::5]) if len(data) >= 20 else (data, [])
    model.w = ftrl(fit, len(langs), model, alpha, beta, l1, l2, epochs)
    if held:
        model.temperature = calibrate(np.array([model.logits(nz, c) for nz, c, _ in held]), np.array([y for _, _, y in held]))
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The `keep` columns, lang_pred, score; `names` renames the last two where columns kept have such names."""
    spark = df.sparkSession
    ship(spark)
    # DIM by languages, stored narrow: a size that doesn't depend on the rows.
    shared = spark.sparkContext.broadcast((model.langs, model.idf.astype(np.float32), model.w.astype(np.float32), model.temperature))
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, *names])

    return df.select(*[df[k] for k in keep], df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training; a null id counts as the empty text, so such rows are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
