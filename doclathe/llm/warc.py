"""WARC archives: writing, reading, and revisit resolution.

Records are bytes: payloads of any kind, HTTP status lines and headers, and records that aren't responses (warcinfo, request, metadata, ...) come back as they were.
They are written by Spark's text writer, which writes the bytes of a string as they are and whose line separator closes a record, so archives go to any
file system that Spark writes; one gzip stream a file. `.gz` archives are read as a stream, too, by Spark's text reader: it cuts at what may be the begin of a record, and what Content-Length says
belongs together is put together again, so no more than a record and one batch of rows is held, however large the archive. Archives that aren't compressed are read whole (up to 2 GB), since Spark would
split them inside records. Resolution shuffles headers only: they are
aggregated by payload digest to one original each (partial aggregation, so a hot digest is a row per task), joined back to name the original of
every other record, and the archives are written anew, with fresh headers, payloads only in originals.

Defined results: a null payload is empty; a null URL leaves the header out; line breaks in URLs are dropped. Records with equal payload and equal id are told apart by file and offset:
one is the response. A revisit whose original isn't in the archives keeps what it refers to. A payload is what follows the HTTP headers, in whatever transfer encoding. No records: no archives, no rows. Columns besides the named are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "file string, offset long, record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string"
#: What else a record is made of: its content type, other WARC headers, and what stands before the payload.
REST = "content_type string, other string, http binary"
START = b"WARC/1."
_OWN = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "warc-block-digest", "warc-profile", "warc-refers-to", "content-type", "content-length"}


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits are four of base 32."""
    h = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value, "[\r\n]", ""), F.lit(CRLF)), F.lit(""))


def write(records: DataFrame, path: str, records_per_file: int = 4096) -> None:
    """records: record_id, record_type, target_uri, date, payload (string or binary; for revisits null), payload_digest, refers_to, and, if there, REST's columns;
    without them records are HTTP responses of HTML."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    revisit = F.col("record_type") == "revisit"
    if "http" in records.columns:
        http, kind, other = F.coalesce("http", F.lit("").cast("binary")), F.col("content_type"), F.coalesce("other", F.lit(""))
    else:
        length = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF)))
        http, kind, other = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), length, F.lit(CRLF)).cast("binary"), F.lit("application/http;msgtype=response"), F.lit("")
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")), _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        other, _line("Content-Type", kind), _line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF),
    )
    text = records.withColumn("block", block).select(F.concat(head.cast("binary"), "block").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def header(lines: bytes) -> dict[str, str]:
    """A record's headers by lower-case name; `other` are the lines of those that aren't among _OWN."""
    head, other = {}, ""
    for line in lines.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
        k, _, v = text.partition(":")
        head[k.strip().lower()] = v.strip()
        if k.strip().lower() not in _OWN:
            other += text + CRLF
    if "content-length" not in head:
        raise ValueError("a record without Content-Length")
    return head | {"other": other}


def records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(file, offset, headers, block) from the pieces of files, each in order, that are cut before every START that follows an empty line."""
    name, at, held = None, 0, b""
    for path, piece in pieces:
        if path != name:
            if held.strip():
                raise ValueError(f"{name}: the record at byte {at} is cut short")
            name, at, held = path, 0, b""
            if piece.strip() and not piece.startswith(START):
                raise ValueError(f"{path}: no record at byte 0")
        elif held:  # a piece that only looked like a record's begin
            held += b"\r\n\r\n" + START
        else:
            held = START
        held += piece
        if not held.strip():
            held = b""
            continue
        lines, gap, block = held.partition(b"\r\n\r\n")
        head = header(lines)
        n = int(head["content-length"])
        if gap and len(block) >= n:
            yield path, at, head, block[:n]
            at, held = at + len(held) + 4, b""
    if held:
        raise ValueError(f"{name}: the record at byte {at} is cut short")


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers with lower-case names, block) of each record of an archive, compressed or not."""
    content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    first, *rest = content.split(b"\r\n\r\n" + START)
    for _, at, head, block in records(("", x) for x in (first, *rest)):
        yield at, head, block


def read(spark: SparkSession, path: str, payload: bool | str = True) -> DataFrame:
    """HEADER's columns and, if asked for, payload (string; null for revisits), or for "bytes" REST's columns and payload as binary. payload_digest and payload_bytes are of the payload as
    read; for a revisit the digest is its header's and the length null."""
    ship(spark)
    raw = payload == "bytes"
    fields = HEADER + (f", {REST}, payload binary" if raw else ", payload string" if payload else "")
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.int64() if "long" in x else pa.binary() if "binary" in x else pa.string() for x in fields.split(", ")]

    def rows(found: Iterator[tuple[str, int, dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        out: list[tuple] = []
        size = 0
        for file, at, h, block in found:
            kind, mime = h.get("warc-type", ""), h.get("content-type")
            cut = block.find(b"\r\n\r\n") + 4 if "application/http" in (mime or "") and kind in ("response", "revisit") else 0
            http, body = (block[:cut], block[cut:]) if cut > 3 else (b"", block)
            told = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            full = kind != "revisit"
            own = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else told
            row = (file, at, h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri"), h.get("warc-date"), own, len(body) if full else None, h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None)
            if raw:
                row += (mime, h["other"], http if full else block, body if full else None)
            elif payload:
                row += (body.decode("utf-8", "replace") if full else None,)
            out.append(row)
            size += len(block) if payload else 100
            if size > 4 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(records((p.as_py(), x.as_py()) for b in batches for p, x in zip(b.column(0), b.column(1), strict=True)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows((p.as_py(), *r) for b in batches for p, x in zip(b.column(0), b.column(1), strict=True) for r in parse(x.as_py()))

    files = lambda fmt, keep: spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", keep)
    packed = files("text", "*.gz").option("lineSep", END + START.decode()).load(path).select("_metadata.file_path", F.col("value").cast("binary"))
    plain = files("binaryFile", "*[!z]").load(path).select("path", "content")
    return packed.mapInArrow(stream, fields).unionByName(plain.mapInArrow(whole, fields))


def resolve(headers: DataFrame, order: Column, min_bytes: int = 0) -> DataFrame:
    """file, offset, new_type, new_refers_to, new_digest: of equal payloads of min_bytes or more the record of the greatest `order` is the response."""
    whole = (F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)
    first = headers.where(whole).groupBy("payload_digest").agg(F.max(F.struct(order.alias("o"), "record_id", "file", "offset")).alias("x")).select("payload_digest", F.col("x.record_id").alias("orig"), F.col("x.file").alias("ofile"), F.col("x.offset").alias("ooffset"))
    j = headers.join(first, "payload_digest", "left")
    linked = F.col("orig").isNotNull() & ~((F.col("file") == F.col("ofile")) & (F.col("offset") == F.col("ooffset"))) & (whole | (F.col("record_type") == "revisit"))
    return j.select("file", "offset", F.when(linked, "revisit").otherwise(F.col("record_type")).alias("new_type"), F.when(linked, F.col("orig")).otherwise(F.col("refers_to")).alias("new_refers_to"), F.col("payload_digest").alias("new_digest"))


def dedup_archives(spark: SparkSession, source: str, target: str, order: Column | None = None, min_bytes: int = 0) -> None:
    """Write the archives of `source` to `target` with each payload once. order: by default the record id's number, else the id."""
    order = order if order is not None else F.struct(F.regexp_extract("record_id", r"(-?\d+)$", 1).try_cast("bigint"), F.col("record_id"))
    decided = resolve(read(spark, source, payload=False), order, min_bytes)
    # Payloads are dealt by file and offset, unique keys, not by digest.
    found = read(spark, source, "bytes").join(decided, ["file", "offset"])
    write(found.select("record_id", F.col("new_type").alias("record_type"), "target_uri", "date", F.when(F.col("new_type") != "revisit", F.col("payload")).alias("payload"), F.col("new_digest").alias("payload_digest"), F.col("new_refers_to").alias("refers_to"), "content_type", "other", "http"), target)


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages."""
    p = F.coalesce(pages[html].cast("string"), F.lit(""))
    return pages.select(F.concat(F.lit("urn:page:"), F.coalesce(pages[id_col].cast("string"), F.lit("null"))).alias("record_id"), F.lit("response").alias("record_type"), pages[url].cast("string").alias("target_uri"), F.lit(date).alias("date"), p.alias("payload"), base32_sha1(p).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"))


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Headers of archives with the payload length of every revisit, joined from its original."""
    h = read(spark, path, payload=False)
    orig = h.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("orig_bytes"))
    rev = h.where("record_type = 'revisit'").join(orig, "payload_digest", "left").withColumn("payload_bytes", F.col("orig_bytes")).select(*h.columns)
    return h.where("record_type <> 'revisit'").unionByName(rev)
