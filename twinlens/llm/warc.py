"""Operator 6: WARC archives, written and read back.

Writing: a record per page in WARC/1.1 form, through Spark's text sink (gzip), whose line separator is the blank line
that ends a record; so files appear by the committer's rules and a lost task leaves nothing behind. Equal payloads: the
smallest id is the ``response``, the others are ``revisit`` records without a payload.

Reading by boundary-chain verification: each task looks for the version line at every offset of its stretch of a file and
emits a candidate with the offset that its Content-Length makes the successor. Pointer jumping from the file starts
keeps the candidates that are reachable; a version line inside a payload is never reached. A head may be of any length
(a url is written whole), and a file whose chain does not end at its size (damaged, or cut short) is an error. The links of a file, two
integers a candidate, meet in one task; the reader's limit on a file's size bounds them. Jumps double, so n candidates
take about log2 n rounds.

Null html is the empty payload. Rows with repeated ids make records each: every row of a payload's smallest id is a
response, and a row revisits by its own payload only. Null ids are larger than all others; where a payload has null ids
alone, each is a response. Extra columns are not written. An empty table gives no records. Line ends in a url are
percent-encoded in its header.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .common import bare, salted_join, scratch_path, stored

_MAGIC = b"WARC/1.1\r\n"
_VERSION, _LENGTH = re.compile(re.escape(_MAGIC)), re.compile(rb"\r\nContent-Length: *(\d+)", re.I)
#: Records of a file, bytes of a page that goes into the files of large ones, bytes that such a file is to hold (the
#: reader takes 2 GB), and bytes of a reading task's stretch.
FILE_RECORDS, LARGE, FILE_BYTES, STRETCH = 2048, 512 << 10, 512 << 20, 4 << 20
#: The alphabet of RFC 4648 base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of 20 bytes given in hex: 8 groups of 20 bits, 4 characters each."""
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.get(F.lit(list(_BASE32)), F.shiftright(bits, shift).bitwiseAND(31)))
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page."""
    payload = F.encode(bare(F.col("html")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32(F.sha1("payload"))})
    large = stored(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"), "warc-digests")
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    members = salted_join(large.select("page_id", "payload_digest"), groups, "payload_digest", 16, "inner", "page_id")
    later = members.where("page_id is null or page_id > _first").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("_first").alias("refers_to")).distinct()
    out = rows.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write(rows: DataFrame, path: str) -> None:
    """Write ``records`` as WARC files under ``path``. Large ones go into files of their own, so that no file outgrows the reader."""
    first = F.col("record_type") == "response"
    length = F.when(first, F.col("payload_bytes")).otherwise(0)
    refers = F.when(first, "").otherwise(F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n")))
    url = F.replace(F.replace(bare(F.col("url")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\n"), refers, F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(first, F.decode(F.col("payload"), "UTF-8")).otherwise("")
    # what a record takes before compression; its head without the url stays below the constant
    size = F.octet_length(body) + F.octet_length(url) + F.lit(512)
    seen = Observation("warc")

    def put(some: DataFrame, most: int) -> None:
        lines = some.select(F.concat(head, body).alias("value"))
        lines.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).option("compression", "gzip").text(path)

    put(rows.observe(seen, F.max(size).alias("most")).where(size < LARGE), FILE_RECORDS)
    most = seen.get.get("most") or 0
    if most >= LARGE:
        put(rows.where(size >= LARGE), max(1, FILE_BYTES // most))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[tuple[int, int, int]]]]:
    """Of each stretch of each file: (start, next, end of the head) at every place of the version line."""
    for b in batches:
        for i in range(b.num_rows):
            data = b.column(1)[i].as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            stop, size = -1, None
            for begin in range(0, len(data), STRETCH):
                found = []
                for m in _VERSION.finditer(data, begin, begin + STRETCH + len(_MAGIC) - 1):
                    at = m.start()
                    # candidates within one head share its end, and what is found once is not looked for again
                    if stop < at:
                        stop = data.find(b"\r\n\r\n", at)
                        if stop < 0:
                            break
                        size = _LENGTH.search(data, at, stop)
                    elif size and size.start() < at:
                        size = _LENGTH.search(data, at, stop)
                    if size:
                        found.append((at, stop + 4 + int(size[1]) + 4, stop))
                yield b.column(0)[i].as_py(), data, found


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates' starts and successors, packed, and the file's size, a row for each stretch."""
    for name, data, found in _found(batches):
        at = np.array([(x[0], x[1] if x[1] <= len(data) else -1) for x in found], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at[:, 0].tobytes()], pa.binary()), pa.array([at[:, 1].tobytes()], pa.binary()), pa.array([len(data)], pa.int64())], ["file", "starts", "nexts", "size"])


def reachable(table: pa.Table) -> pa.Table:
    """The starts on the chain from offset 0 of one file, by pointer jumping: round k marks what 2^k successors more reach."""
    start, after = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.int64) for c in ("starts", "nexts"))
    order = np.argsort(start)
    start, after = start[order], after[order]
    to = np.searchsorted(start, after)
    to = np.append(np.where((to < len(start)) & (np.append(start, -1)[np.minimum(to, len(start))] == after), to, len(start)), len(start))
    marked = np.append(start == 0, False)
    while True:
        new = marked.copy()
        new[to[marked]] = True
        new[-1] = False
        if (new == marked).all() and (to == len(start)).all():
            on = marked[:-1]
            if not on.any() or after[on][-1] != table.column("size")[0].as_py():
                raise ValueError(f"the records of {table.column('file')[0].as_py()} do not end at its size: damaged or cut short")
            kept = start[on]
            return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(kept), pa.string()), "start": pa.array(kept, pa.int64())})
        marked, to = new, to[to]


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The records of the archives under ``path``: file, start, head and body; with ``digest`` the body's size and SHA-1 in its stead."""

    def records_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data, found in _found(batches):
            for k in range(0, len(found), 256):
                own = found[k : k + 256]
                body = [data[x[2] + 4 : max(x[2] + 4, x[1] - 4)] for x in own]
                more = [pa.array([len(x) for x in body], pa.int64()), pa.array([hashlib.sha1(x).digest() for x in body], pa.binary())] if digest else [pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array([x[0] for x in own], pa.int64()), pa.array([data[x[0] : x[2]].decode("utf-8", "replace") for x in own]), *more], names)

    names = ["file", "start", "head", *(("size", "sha1") if digest else ("body",))]
    kept = _files(spark, path).mapInArrow(links, "file string, starts binary, nexts binary, size long").groupBy("file").applyInArrow(reachable, "file string, start long")
    every = _files(spark, path).mapInArrow(records_, "file string, start long, head string, " + ("size long, sha1 binary" if digest else "body binary"))
    return every.join(kept, ["file", "start"], "left_semi").select(*names)


def field(name: str) -> Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    # the full payload's figures are checked where the payload is here, and else read from the revisit's header
    whole = field("WARC-Type") == "response"
    return read(spark, path, digest=True).select(
        F.regexp_extract("head", r"WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.when(whole, F.col("size")).otherwise(field("X-Payload-Length").try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(whole, base32(F.lower(F.hex("sha1")))).otherwise(F.substring(field("WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(~whole, F.regexp_extract("head", r"WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long")).alias("refers_to"),
    )
