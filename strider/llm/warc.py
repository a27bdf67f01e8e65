"""WARC: writing archives with segmented records and reading them back by segment reassembly.

`archive` writes one WARC/1.1 record per page: an HTTP response in chunked transfer framing, or a revisit that refers to
the response with the same payload. A block longer than SEGMENT bytes is split: the first segment carries
WARC-Segment-Number 1, the rest are continuation records with the origin's id, and the last one the total length. Every
record is a gzip member of its own. Members carry MARK as their header comment, so Spark's text source can split an
archive of any size between records.

`restore` inflates records, checks each member's checksum and length, passes whole records on, groups segments by origin
id, orders them by segment number, verifies that none is missing and that the total length is right, decodes the chunked
framing, and returns the payloads' lengths and digests; `payloads` returns the payloads as well. Both look up the response
that a revisit refers to: length and payload are the response's, and a revisit whose digest is not its response's has a
problem. Archives of other writers (*.gz, with any members) are read file by file.

Scale: payload digests are grouped with partial aggregation (a payload that a third of all pages share is one group of
ids, never of payloads); html is shuffled once, by page id, to meet its record type in a hash join on the other, small
side, without a sort, and is written through Spark's writer to the shared folder. A file holds what a task writes, at most
FILE_RECORDS records of about SEGMENT bytes (1 GB); reading holds one record at a time. What was read is written once:
blocks of segments, and of whole records only what was found in them. Only segments are shuffled, and a group is one page.

Defined cases: null html is an empty payload; null or empty url gives no target uri, nor does one over URI_BYTES; rows
equal in page id and payload are records of their own, numbered; of equal payloads the largest page id is the response
(each of its rows, if it has several), null page ids come last; page ids must be integers; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.llm.common import BATCH_BYTES, bounded_batches, integer_ids, table
from strider.storage import remove, shared_dir, written

SEGMENT, CHUNK, FILE_RECORDS, MIN_REVISIT, URI_BYTES, LEVEL = 16_384, 4_096, 65_536, 0, 65_536, 1
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"
#: The comment in a member's header; long enough not to occur by chance.
MARK = "strider/record/7Zq0vK2mXw9TbR4s"
#: Header of a member with a comment; what ends one: the last byte of its length, zero below 16 MB, is the writer's line
#: separator.
_MEMBER, LAST = b"\x1f\x8b\x08\x10\0\0\0\0\0\xff", "\0"


def base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, _sha, _refers (null for responses), _n (how many rows), one row per page id and payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.sha1(F.encode(body, "UTF-8")).alias("_sha"), (F.octet_length(body) >= min_bytes).alias("_big"))
    ids = ids.groupBy("page_id", "_sha", "_big").agg(F.count(F.lit(1)).alias("_n"))
    first = ids.where("_big").groupBy("_sha").agg(F.max("page_id").alias("_response"))
    return ids.join(first, "_sha", "left").select("page_id", "_sha", F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response")).alias("_refers"), "_n")


def record_id(page_id, sha: str, copy) -> str:
    h = hashlib.md5(f"{page_id}/{sha}/{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields) + CRLF).encode()


def chunked(raw: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk without its end")
        at = end + 4 + n


def records(page_id, url: str | None, html: str | None, sha: str, copy: int, refers, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of a page; sha: of the payload, in hex."""
    raw = (html or "").encode()
    rid = record_id(page_id, sha, copy)
    uri = "".join(c for c in url or "" if c not in "\r\n")
    uri = uri if len(uri.encode()) <= URI_BYTES else ""
    base = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("X-Page-Id", "" if page_id is None else page_id)] + ([("WARC-Target-URI", uri)] if uri else []) + [("WARC-Payload-Digest", f"sha1:{base32(sha)}"), ("X-Payload-Length", len(raw)), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        fields = [("WARC-Type", "revisit"), *base, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, sha, 1)), ("X-Refers-To-Page", refers), ("Content-Length", len(http))]
        return [_head(fields) + http + RECORD_END]
    block = http + chunked(raw)
    if len(block) <= segment:
        return [_head([("WARC-Type", "response"), *base, ("Content-Length", len(block))]) + block + RECORD_END]
    out = []
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for i, piece in enumerate(pieces, 1):
        if i == 1:
            fields = [("WARC-Type", "response"), *base, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, sha, f"{copy}-{i}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", i)]
            if i == len(pieces):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_head([*fields, ("Content-Length", len(piece))]) + piece + RECORD_END)
    return out


def member(record: bytes) -> bytes:
    """A gzip member with MARK as comment."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return b"".join((_MEMBER, MARK.encode(), b"\0", deflate.compress(record), deflate.flush(), zlib.crc32(record).to_bytes(4, "little"), len(record).to_bytes(4, "little")))


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Writes the archives to a folder."""
    bounded_batches(pages.sparkSession)
    integer_ids(pages, "page_id")
    body = F.coalesce(F.col("html"), F.lit(""))
    key = lambda df: df.withColumn("_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    said = key(roles(pages, min_bytes)).select("_key", "_sha", "_refers", "_n").hint("shuffle_hash")
    rows = key(pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("_sha"))).join(said, ["_key", "_sha"])
    # only rows that are equal in id and payload have to be numbered
    one = rows.where("_n = 1").select("page_id", "url", "html", "_sha", F.lit(1).alias("_copy"), "_refers")
    several = rows.where("_n > 1").select("page_id", "url", "html", "_sha", F.row_number().over(W.partitionBy("_key", "_sha").orderBy("url")).alias("_copy"), "_refers")

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records(*row):
                    held.append(member(record)[: -len(LAST)])
                    size += len(held[-1])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    members = one.unionByName(several).mapInArrow(run, "value binary").select(F.col("value").cast("string"))  # bytes as they are
    members.write.option("lineSep", LAST).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes):
    """(fields, block) of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + len(RECORD_END)


def inflated(value: bytes) -> bytes | None:
    """The record in what stands between two marks: the rest of a member and the beginning of the next one's header."""
    if value[:1] != b"\0":
        return None  # what stands before the first mark of a file
    inflate = zlib.decompressobj(-15)
    out = inflate.decompress(value[1:])
    end = inflate.unused_data
    if not inflate.eof or zlib.crc32(out) != int.from_bytes(end[:4], "little") or len(out) != int.from_bytes(end[4:8], "little"):
        raise ValueError("a damaged member")
    return out


def members(data: bytes):
    """The contents of the gzip members of a file, one by one."""
    while data:
        inflate = zlib.decompressobj(31)
        yield inflate.decompress(data)
        data = inflate.unused_data


#: What was found in a record: of a whole one the result, of a segment (number > 0) its block.
FOUND = "origin string, number int, total long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, block binary, refers_id string, problem string, payload binary"
_FOUND = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()), ("refers_id", pa.string()), ("problem", pa.string()), ("payload", pa.binary())])


def _segment(f: dict, block: bytes) -> tuple:
    long = lambda k: int(f[k]) if f.get(k) else None
    return (f.get("warc-segment-origin-id", f["warc-record-id"]), long("warc-segment-number") or 0, long("warc-segment-total-length"), long("x-page-id"), f["warc-type"], long("x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:"), long("x-payload-length"), block, f.get("warc-refers-to"))


def whole(parts: list[tuple]) -> tuple:
    """page_id, payload length and digest, type, referred page, problem and payload of one record, from its segments."""
    parts = sorted(parts, key=lambda p: p[1])
    first, block, problem, payload = parts[0], b"".join(p[8] for p in parts), None, None
    if len(parts) > 1 or first[1]:
        if [p[1] for p in parts] != list(range(1, len(parts) + 1)):
            problem = "missing segment"
        elif parts[-1][2] != len(block):
            problem = "wrong total length"
    n, digest = first[7], first[6]
    if first[4] == "response" and not problem:
        head, _, body = block.partition(b"\r\n\r\n")
        try:
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != first[6]:
                problem = "wrong digest"
        except ValueError:
            problem = "broken framing"
    return first[3], n, digest, first[4], first[5], problem, payload


def _result(parts: list[tuple], keep: bool) -> tuple:
    """A row of FOUND without a block."""
    page_id, n, digest, kind, refers, problem, payload = whole(parts)
    return parts[0][0], 0, None, page_id, kind, refers, digest, n, None, next((p[9] for p in parts if p[9]), None), problem, payload if keep else None


def found_records(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """FOUND of every record in the archives; payloads are null unless kept."""
    bounded_batches(spark)

    def rows_of(data: bytes):
        for fields, block in parse(data):
            part = _segment(fields, block)
            yield (*part, None, None) if part[1] else _result([part], keep)

    def read(contents):
        def run(batches):
            for batch in batches:
                rows, size = [], 0
                for value in batch.column(0):
                    for data in contents(value.as_py()):
                        for row in rows_of(data):
                            rows.append(row)
                            size += len(row[8] or b"") + len(row[11] or b"")
                            if size >= BATCH_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)
                                rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

        return run

    own = spark.read.option("lineSep", MARK).option("pathGlobFilter", "part-*.txt").text(path).select(F.col("value").cast("binary"))
    other = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return own.mapInArrow(read(lambda v: [x] if (x := inflated(v)) is not None else []), FOUND).unionByName(other.mapInArrow(read(members), FOUND))


def _resolved(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    out = shared_dir(spark)
    found = written(found_records(spark, path, keep), f"{out}/found")

    def group(t: pa.Table) -> pa.Table:
        rows = [_result(list(zip(*(c.to_pylist() for c in t.columns[:10]))), keep)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

    bounded_batches(spark)
    put = found.where("number > 0").groupBy("origin").applyInArrow(group, FOUND)
    read = written(found.where("number = 0").unionByName(put).drop("number", "total", "block"), f"{out}/records")
    remove(spark, f"{out}/found")
    own, again = read.where("record_type <> 'revisit'"), read.where("record_type = 'revisit'")
    response = own.where("record_type = 'response'").dropDuplicates(["origin"]).select(F.col("origin").alias("refers_id"), F.struct("payload_digest", "payload_bytes", "problem", "payload").alias("_r"))
    wrong = F.when(F.col("_r").isNull(), "missing response").when(F.col("_r.problem").isNotNull(), "broken response").when(F.col("_r.payload_digest") != F.col("payload_digest"), "wrong digest")
    got = lambda c, other: F.when(wrong.isNull(), F.col(f"_r.{c}")).otherwise(other).alias(c)
    again = again.join(response, "refers_id", "left").select("page_id", got("payload_bytes", F.col("payload_bytes")), "payload_digest", "record_type", "refers_to", F.coalesce("problem", wrong).alias("problem"), got("payload", F.lit(None)))
    return own.select(again.columns).unionByName(again)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The columns of `restore` and the payload; null where none could be read."""
    return _resolved(spark, path, True)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and what is wrong with the record, if anything."""
    return _resolved(spark, path, False).drop("payload")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    archive(table(spark, sf_dir, "pages"), path)
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record of page "), F.col("page_id").cast("string"), F.lit(": "), F.col("problem"))))
    return restore(spark, path).select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS response FROM p GROUP BY h),
bits AS (SELECT h, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (instr('0123456789abcdef', substr(h, CAST(j AS INT) + 1, 1)) - 1), 4), '' ORDER BY j) AS b FROM m, range(40) r(j) GROUP BY h),
b32 AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(b, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(b, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1), '' ORDER BY i) AS d FROM bits, range(32) s(i) GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN m USING (h) JOIN b32 USING (h)"""

QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": ORACLE_SQL}
