"""Secret scan with multipart credential linking.

Strong spans are reported on their own: `assign`, `access` and `hex` (see BASE). Weak parts are not:
an access identifier (`user = ...`, a short `AKIA` key), a secret (short values, any of `pwd` and `pass`, which `assign` doesn't know, or
high-entropy ones) or an endpoint
(a URL, `host = ...`). A weak part is reported only if both of the other two roles occur in its scope, a
paragraph, with at most `reach` code points between the two: an interval join of parts by role. Parts are kept sorted by start with the last end
so far, so each join is a binary search in the neighbouring role, however long parts are and whichever comes first; no pairs are emitted, and
work stays n log n in the parts of a text however many there are.

Defined results: null and empty texts have no spans. Texts are scanned whole. Repeated rows give repeated rows.
Columns besides id and text are ignored, so their names can't clash.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")

# Weak parts, by role.
WEAK = (
    ("weak_access", "access", re.compile(r"""(?:user(?:name)?|login|account|client_?id|key_?id|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|AKIA[A-Z0-9]{1,11}(?![A-Z0-9])""", re.I | re.A)),
    ("weak_secret", "secret", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,7})(?![A-Za-z0-9+/_.=-])|(?i:pwd|pass)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})|(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}={0,2}""", re.A)),
    ("weak_endpoint", "endpoint", re.compile(r"""[a-z][a-z0-9+.-]{1,11}://[^\s"'<>]+|(?:host|hostname|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+\.[A-Za-z0-9.-]+(?::[0-9]+)?""", re.A | re.I)),
)
KINDS = (*BASE, *(k for k, _, _ in WEAK))
ROLE = {"assign": "secret", "access": "access", "hex": "secret"} | {k: r for k, r, _ in WEAK}
ROLES = ("access", "secret", "endpoint")
SPAN = "struct<kind:string,start:int,end:int,link:int>"
_BLANK = re.compile(r"\n[ \t\r]*\n")
_MAY_BE_WEAK = re.compile(r"""[:=]""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def weak_spans(text: str, strong: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    if not strong and not _MAY_BE_WEAK.search(text):
        return []
    parts = [(m.start(), 3 + i, m.end()) for i, (_, _, rx) in enumerate(WEAK) for m in rx.finditer(text)]
    if not parts:
        return []
    merged: list[tuple[int, int]] = []  # what strong spans cover; a weak part inside is already reported
    for s, _, e in strong:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    lows = [s for s, _ in merged]

    def covered(s: int, e: int) -> bool:
        i = bisect.bisect_left(lows, e) - 1
        return i >= 0 and merged[i][1] > s

    parts = [p for p in parts if not covered(p[0], p[2])]
    if not parts:
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    scope = lambda s: bisect.bisect_right(breaks, s)
    near: dict[tuple[str, int], tuple[list[int], list[int]]] = {}  # by role and scope: starts in order, and the last end so far
    for s, k, e in sorted([*strong, *parts]):
        starts, ends = near.setdefault((ROLE[KINDS[k]], scope(s)), ([], []))
        starts.append(s)
        ends.append(max(e, ends[-1]) if ends else e)

    def joined(role: str, at: int, s: int, e: int) -> bool:
        """Whether a part of the role begins before [s, e) ends and ends after it begins, both by `reach` at most."""
        starts, ends = near.get((role, at), ((), ()))
        i = bisect.bisect_right(starts, e + reach)
        return i > 0 and ends[i - 1] >= s - reach

    return [(s, k, e) for s, k, e in parts if all(joined(r, scope(s), s, e) for r in ROLES if r != ROLE[KINDS[k]])]


def links(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[int | None]:
    """For each span (in order) the start of the first one that it is linked with, by way of others: spans of a paragraph with no more than `reach` code points between one and the next.
    None for strong spans without a weak one."""
    if all(k < len(BASE) for _, k, _ in spans):
        return [None] * len(spans)
    breaks = [m.start() for m in _BLANK.finditer(text)]
    out: list[int | None] = []
    begin, end, scope, first = 0, -1, -1, 0
    for i, (s, _, e) in enumerate([*spans, (len(text) + reach + 1, 0, 0)]):
        own = bisect.bisect_right(breaks, s)
        if i == 0 or own != scope or s > end + reach:
            out += [begin if any(k >= len(BASE) for _, k, _ in spans[first:i]) else None] * (i - first)
            begin, end, scope, first = s, e, own, i
        end = max(end, e)
    return out


def find(text: str | None, reach: int = 400) -> list[tuple[int, int, int]]:
    if not text:
        return []
    strong = base_spans(text)
    return sorted(strong + weak_spans(text, strong, reach))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    """id, spans: array of (kind, start, end, link) by start, then kind; offsets are code points, end exclusive; link is the same for spans of a text that are linked (see links())."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    typ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("link", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            found = []
            for t in texts:
                spans = find(text_ := t.as_py(), reach)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "link": x} for (s, k, e), x in zip(spans, links(text_ or "", spans, reach), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, typ)], names=[id_col, "spans"])

    return df.select(df[id_col], df[text].cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, spans array<{SPAN}>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash and joined spans of scan()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[n(k) for k in BASE], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
