"""Lexical search, prefix trie and packing against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doclathe.llm import lexical, packing, turns
from doclathe.llm.registry import vocabulary_file

DOCS = "doc_id long, text string, score long, rank int, length long, piece int, query long, term string, row long, id string"
random.seed(5)
SYLLABLES = ["an", "the", "re", "ü", "ção", "日本", "x9", "o"]


def word():
    return "".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3)))


def text(n):
    return "".join(word() + random.choice([" ", ", ", ".\n", "-", "  ", "'s "]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1, "x", 1, "x") for i, t in rows], DOCS)


# 11 ---------------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(docs, items, k):
    own = [(i, Counter(brute_terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, q in items:
        found = []
        for doc, c in own:
            n, s = sum(c.values()), 0
            m = 100 - 25 + (25 * n * n_docs) // total
            for t in brute_terms(q):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, doc is None, doc, s))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, s) for r, (_, _, doc, s) in enumerate(found[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, text(random.randint(1, 60))) for i in range(300)]
    rows += [(400 + i, "Same THE words. an o") for i in range(40)] + [(7, rows[7][1]), (None, "the an o x9"), (500, None), (501, ""), (502, " .,;"), (503, text(30000)), (9, None)]
    return rows


def test_search_equals_brute_force(spark, corpus):
    items = [(i, text(random.randint(1, 12))) for i in range(25)] + [(30, None), (31, ""), (32, "nothingofthis"), (33, "the THE the an"), (34, "a\0b same"), (None, "words o")]
    docs = documents(spark, corpus).repartition(5)
    queries = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, term string, row long")
    want = sorted(map(repr, brute_search(corpus, items, 7)))
    for more in ({}, {"window": 16}, {"block_bytes": 700, "window": 50}):
        got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(docs, queries, k=7, **more).collect()]
        assert sorted(map(repr, got)) == want, more
    # Repeated queries have their rows each; nothing asked or nothing to search gives none.
    twice = lexical.search(docs, queries.where("item_id = 33").union(queries.where("item_id = 33")), k=3)
    assert sorted(r["rank"] for r in twice.collect()) == [1, 1, 2, 2, 3, 3]
    assert lexical.search(docs, queries.where("item_id in (30, 31, 32)")).collect() == []
    assert lexical.search(docs.limit(0), queries).collect() == []
    assert lexical.search(docs, queries.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# 12 ---------------------------------------------------------------------------------------------------------------------


def brute_trie(convs):
    """convs: id -> tuple of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in convs.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(map(repr, out))


def rebuilt(rows):
    own = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, r or "", t or ""))
    own = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in own.items()}
    return {c: own.get(c - c % 20, ())[: zlib.crc32(str(c).encode()) % 4] + p[zlib.crc32(str(c).encode()) % 4 :] for c, p in own.items()}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, path string, key string")


def trie_rows(spark, rows, **more):
    own = turns.paths(conversations(spark, rows)).cache()
    c = F.col("conv_id")
    full = turns.with_heads(own, own.where("conv_id % 20 = 0"), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, most=3)
    return sorted(repr(tuple(r)) for r in turns.trie(full, **more).collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in range(300):
        if c % 7 == 3 and c % 20:  # copies and common beginnings
            p = [("system", "be kind")] + [("user", "hi there")] * rng.randint(0, 4)
        elif c % 3 == 0:
            p = [("system", "be kind"), ("user", rng.choice(["one two", "three", ""])), ("assistant", rng.choice(["yes", "no no"]))] * rng.randint(1, 3)
        else:
            p = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b b", None, "c c c"])) for _ in range(rng.randint(1, 6))]
        rows += [(c, k, *x) for k, x in enumerate(p)]
    rows += [(1000, k, "user", "deep talk") for k in range(400)] + [(1001, k, "user", "deep talk") for k in range(300)]
    rows += [(1005, None, "user", "first"), (1005, 0, "user", "second"), (None, 0, "user", "nobody"), (1007, 0, "user", "x"), (1007, 0, "user", "x")]
    return [r for r in rows if r[0] not in (60, 80)]  # two whose heads others miss


@pytest.mark.parametrize("more", [{"parts": 1, "held": 10**9}, {"parts": 7}, {"parts": 60, "fan": 3, "small": 0}])
def test_trie_equals_brute_force(spark, talks, more, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", 3)
    if more["parts"] == 1:
        monkeypatch.setattr(spark.conf, "get", lambda *a, f=spark.conf.get: "1" if a[0] == "spark.sql.shuffle.partitions" else f(*a))
    assert trie_rows(spark, talks, **more) == brute_trie(rebuilt(talks))


def test_trie_edges(spark):
    assert trie_rows(spark, []) == []
    same = [(c, k, "user", "x y") for c in range(1, 200) if c % 20 for k in range(4)]
    assert trie_rows(spark, same, parts=9) == brute_trie(rebuilt(same))
    one = [(1, 0, "user", "x")]  # its head is missing, so it has no turn left
    assert trie_rows(spark, one) == brute_trie(rebuilt(one))


def test_runs_merge_in_order_with_their_common_lengths():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(tuple(rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 6))), i) for i in range(rng.randint(0, 40))]
        k = rng.randint(1, 7)
        runs = []
        for part in (sorted(rows[i::k]) for i in range(k)):
            runs.append([(p, i, turns.shared(part[j - 1][0], p) if j else 0) for j, (p, i) in enumerate(part)])
        got = [(runs[r][i][:2], lcp) for r, i, lcp in turns.merged(runs)]
        assert [x for x, _ in got] == sorted(rows)
        assert [lcp for _, lcp in got] == [turns.shared(a[0], b[0]) for a, b in zip([((), 0)] + sorted(rows), sorted(rows))]


# 13 ---------------------------------------------------------------------------------------------------------------------


def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


NASTY = [
    "don't 'tis rock'n'roll ''s x.'s (\"'re\") it's", "a\x1cb \x85 c\xa0d e​f", "é ≠ ño Å Å", "İstanbul DŽ ŉ ß ẞ Σίσυφος ΑΣ", "x9y10 ½ ٣ Ⅷ 12ab", "<|endoftext|> a<|startoftext|>b", "日本語テキスト。「です」—…", "😀👩‍👩‍👧 é.b,ç",
    "", None, "   ", "a" * 300, "é" * 200, "\x00\x01 tab\tnew\nline\r\x0b\x0c end", "ͅx ǰ ΐ fi", "-- -' '- _a_ #1!",
]


def test_ids_equal_the_library(spark):
    rng = random.Random(8)
    alphabet = [c for t in NASTY if t for c in t] + list(" '.,-") * 4
    texts = NASTY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)] + [text(40) for _ in range(40)]
    got = packing.pieces(documents(spark, list(enumerate(texts))).repartition(3), vocabulary_file(), longest=50, with_ids=True).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        by[r["doc_id"]].append(r)
    lib = library()
    for i, t in enumerate(texts):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        blob = b"".join(x.to_bytes(4, "little") for x in want)
        assert b"".join(bytes(r["ids_le"]) for r in by[i]) == blob, t
        assert [(r["start"], r["length"]) for r in by[i]] == [(s, min(50, len(want) - s)) for s in range(0, len(want), 50)]
        assert [r["ids_crc32"] for r in by[i]] == [zlib.crc32(blob[s * 4 : s * 4 + 200]) for s in range(0, len(want), 50)]


def test_cache_of_pieces_is_bounded_by_bytes():
    """Long pieces, few enough for the bound on their number, must not fill a worker's memory."""
    with open(vocabulary_file(), "rb") as f:
        t = packing.Tokens(f.read())
    t.CACHE_BYTES = 200_000
    lib, rng = library(), random.Random(3)
    for _ in range(40):
        s = "".join(rng.choice("日本語テキスト") for _ in range(3000))
        data = np.frombuffer(s.encode(), np.uint8)
        assert t.encode(data, np.array([len(data)]))[0].tolist() == lib.encode(s, add_special_tokens=False).ids
        assert sum(map(len, t.cache)) + sum(map(len, t.cache.values())) <= 200_000


def sequential(lengths, tokens, docs, cost):
    """Best-fit decreasing by residual norm, piece by piece."""
    bins = []
    for x in sorted(lengths, reverse=True):
        need = (x, 1, x * x)
        able = [b for b in bins if all(r >= n for r, n in zip(b, need))]
        if able:
            best = min(able, key=lambda b: sum(((r - n) / c) ** 2 for r, n, c in zip(b, need, (tokens, docs, cost))))
        else:
            bins.append(best := [tokens, docs, cost])
        for i in range(3):
            best[i] -= need[i]
    return len(bins)


def check_packing(rows, tokens, docs, cost):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens and len(parts) <= docs and sum(x * x for _, x in parts) <= cost
    return len(by)


@pytest.mark.parametrize("tokens,docs,cost", [(64, None, None), (64, 3, None), (100, 40, 3000), (64, 2, 900), (7, 1, 49)])
def test_packing_keeps_every_capacity_and_equals_best_fit(spark, tokens, docs, cost):
    rng = random.Random(tokens)
    most = min(tokens, math.isqrt(cost or tokens * tokens))
    lengths = [rng.randint(1, most) for _ in range(700)] + [most // 2 + 1] * 500 + [1] * 150
    df = spark.createDataFrame([(i % 600, x, "a") for i, x in enumerate(lengths)], "doc_id long, length long, bucket string").repartition(4)
    bins = {}
    for rule in ("norm", "dot", "fewest"):
        got = packing.pack(df, tokens, docs, cost, rule, bucket=50, small=0 if rule == "dot" else 10**6).collect()
        assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i % 600, x) for i, x in enumerate(lengths))
        bins[rule] = check_packing(got, tokens, docs or tokens, cost or tokens * tokens)
    assert bins["norm"] == sequential(lengths, tokens, docs or tokens, cost or tokens * tokens)
    assert bins["fewest"] == min(bins["norm"], bins["dot"])


def test_packing_edges_and_whole_sequences(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 65), (4, 64), (None, 5), (None, 5)], "doc_id long, length long")
    got = sorted((r["length"] or 0, r["sequence_id"] is None, r["offset"]) for r in packing.pack(df, 64).collect())
    assert got == [(0, True, None), (0, True, None), (5, False, 0), (5, False, 5), (64, False, 0), (65, True, None)]
    assert packing.pack(df.limit(0), 64).collect() == []
    docs = documents(spark, [(i, text(random.randint(0, 40))) for i in range(60)])
    packed = packing.pack(packing.pieces(docs, vocabulary_file(), longest=64, with_ids=True), 64).cache()
    whole = {r["sequence_id"]: bytes(r["ids_le"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] * 4 : (r["offset"] + r["length"]) * 4] == bytes(r["ids_le"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in packed.collect())
