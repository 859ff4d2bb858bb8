"""WARC archives: a writer, and a reader that salvages what it can from damaged ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import new_path, stored, tidy

#: Bytes of payload that one archive file holds in the mean.
FILE_BYTES = 32 << 20
#: Digests of repeated payloads that may be sent to every task (about 60 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
#: A gzip member without content.
_EMPTY = gzip.compress(b"", mtime=0)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 8 numbers of 20 bits, each 4 letters."""

    def letters(hex_: Column) -> Column:
        def four(i: Column) -> Column:
            v = F.conv(F.substring(hex_, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
            return F.concat(*[F.substring(F.lit(_B32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")

    return F.transform(F.array(F.sha1(data)), letters)[0]  # a lambda's variable, so that the digest is made once


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """One row per page: ``key``, ``digest``, ``bytes``, ``refers`` (null for a response) and ``record``, its text.

    Null payload: empty. Of equal payloads of at least ``least`` bytes the smallest key is the response and the others
    revisit it; rows of that same key are responses too, and so is a group without a key. Null url: no target header;
    control characters in a url are percent-encoded.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    first = stored(first, "digests")
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first.hint("merge"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    rows = rows.withColumn("refers", refers)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "%0A"), "^$", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    revisit = F.col("refers").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_CRLF}WARC-Record-ID: "), name(F.col("key")), F.lit(f"{_CRLF}WARC-Date: 2024-01-01T00:00:00Z"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{_CRLF}WARC-Target-URI: "), target)),
        F.when(revisit, F.concat(F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: "), name(F.col("refers")))).otherwise(F.lit("")),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{_CRLF}WARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary")),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2),
    )
    return rows.select(F.col("key").alias(key), "digest", "bytes", F.col("refers"), F.concat(head, block).alias("record"))


def _gzipped(batches):
    """Each record with its end as a gzip member of its own, less the member's last byte: the top byte of the size, 0.

    That byte is the line's end that Spark's text writer adds. An empty member follows records of 16 MB and more, so
    that theirs ends in 0 too.
    """
    for b in batches:
        out = []
        for r in b.column(0):
            data = r.as_py().encode() + b"\r\n\r\n"
            zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = zip_.compress(data) + zip_.flush()
            if member[-1]:
                member += _EMPTY
            out.append(member[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes archives of one gzip member per record to the folder ``path``, by Spark's own writer and committer, so to any store that Spark
    can write to; each task writes what it reads, in files of ``file_bytes`` before compression in the mean. An empty
    table gives no record."""
    mean = df.agg(F.avg(F.coalesce(F.octet_length(F.col(payload)), F.lit(0)))).first()[0] or 0
    most = max(1, int(file_bytes / (mean + 700)))
    members = records(df, key, url, payload, least).select("record").mapInArrow(tidy(_gzipped), "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_GZIP = b"\x1f\x8b\x08"


def _b32(data: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(data).digest())


def _record(data: bytes, at: int):
    """The record at ``at``: (headers, block, end), or a reason (str) why there is none.

    Headers are read line by line and end at the first bad one, at the latest at the next version line; a block is only
    touched if what follows it is right. So a place that fails costs no more than the bytes up to the next one.
    """
    if not (m := _VERSION.match(data, at)):
        return "no version line"
    headers, stop = {}, m.end()
    while (next_ := data.find(b"\r\n", stop)) != stop or not headers:
        line = data[stop:next_] if next_ >= 0 else b""
        name, colon, value = line.partition(b":")
        if not colon:
            return "headers without an end" if next_ < 0 else "a header line without a colon"
        stop = next_ + 2
        if (name := name.strip().lower()) in (b"warc-type", b"warc-record-id", b"content-length") and name in headers:
            return "a header is given twice"
        headers[name] = value.strip()
    if not headers.get(b"content-length", b"").isdigit() or b"warc-type" not in headers or b"warc-record-id" not in headers:
        return "a mandatory header is missing"
    begin = stop + 2
    end = begin + int(headers[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "the block does not end at its length"
    block = data[begin:end]
    if (digest := headers.get(b"warc-block-digest", b"")).startswith(b"sha1:") and digest[5:].upper() != _b32(block):
        return "the block's digest differs"
    return headers, block, end + 4


def _member(data: bytes, at: int):
    """The gzip member at ``at``: its content, its end, and None or the reason why it breaks off.

    Where a step fails it is repeated from the state before in ever smaller ones, so what comes before the damaged
    byte is kept.
    """
    unzip, out, step, why = zlib.decompressobj(31), [], 1 << 16, None
    while step and not unzip.eof and at < len(data):
        before = unzip.copy()
        try:
            out.append(unzip.decompress(data[at : at + step]))
            at += step
        except zlib.error as e:
            unzip, step, why = before, step // 2, f"gzip: {e}"
    if why and not unzip.eof:
        return b"".join(out), min(at, len(data)), why
    at = min(at, len(data)) - len(unzip.unused_data)
    return b"".join(out), at, None if unzip.eof else "gzip: the member has no end"


def salvage(data: bytes):
    """Yields ("record", offset, length, headers, block) and ("gap", offset, length, reason, None) over one archive.

    Records may be plain or in gzip members, one or many in each. After a failed check the next place that passes all
    checks is sought, a version line or a gzip member; the bytes passed over are one gap. Plain records and gaps cover
    the archive. Of a member the records have the member's place; what it holds is searched like an archive of its own,
    so a damaged record costs only itself, and a member that breaks off gives the records before the break and a gap
    from there on.
    """
    at, n, bad, why = 0, len(data), None, ""
    plain = zipped = -1  # the next places of either kind, sought again only once they are passed
    while at < n:
        found = []
        if data.startswith(_GZIP, at):
            content, end, broken = _member(data, at)
            found = [x for x in salvage(content) if x[0] == "record"] if broken else list(salvage(content))
            reason, good = broken or "an empty member", not broken or bool(found)
        else:
            got = _record(data, at)
            good = not isinstance(got, str)
            reason, end, broken = (got, at, None) if not good else ("", got[2], None)
            found = [("record", 0, 0, *got[:2])] if good else []
        if good:
            if bad is not None:
                yield "gap", bad, at - bad, why, None
                bad = None
            for kind, _, _, a, b in found:
                yield kind, at, end - at, a, b
            if broken:
                bad, why = at, broken
            else:
                at = end
                continue
        if bad is None:
            bad, why = at, reason
        if plain <= at:
            found = _VERSION.search(data, at + 1)
            plain = found.start() if found else n
        if zipped <= at:
            zipped = data.find(_GZIP, at + 1)
            zipped = n if zipped < 0 else zipped
        at = min(plain, zipped)
    if bad is not None:
        yield "gap", bad, n - bad, why, None


READ = "path string, kind string, offset long, length long, reason string, record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def _row(path, kind, offset, length, headers, block, with_payload):
    if kind == "gap":
        return (path, kind, offset, length, headers, *[None] * 7)
    text = lambda k: headers[k].decode("utf-8", "replace") if k in headers else None
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    revisit = headers.get(b"warc-type") == b"revisit"
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http) if revisit else None
    digest = (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None
    if not revisit:
        digest = _b32(payload).decode()
    return (path, kind, offset, length, None, text(b"warc-record-id"), text(b"warc-type"), text(b"warc-refers-to"), text(b"warc-target-uri"), digest, int(size[1]) if size else len(payload), payload if with_payload and not revisit else None)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path`` (columns: ``READ``), one file at a time in a task.

    A gap has ``kind`` "gap", its place and its reason. Payload digest and length of a response are worked out from
    what was read; those of a revisit are its headers'. Archives of more than 2 GB are beyond Spark's binary reader.
    """
    from pyspark.sql import types as T

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = T.StructType.fromDDL(READ).names

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for kind, offset, length, headers, block in salvage(content.as_py()):
                    rows.append(_row(p.as_py(), kind, offset, length, headers, block, with_payload))
                    held += len(block or b"") * with_payload + 200
                    if held > 8 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(tidy(run), READ)


def _batch(rows, names):
    kinds = dict(zip(names, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def key_of(record_id: Column, kind: str = "long") -> Column:
    """The key in a record id that ``records`` has made."""
    found = F.url_decode(F.regexp_extract(record_id, "^<urn:x-page:(.*)>$", 1))
    return F.when(found != "", found).cast(kind)


def archived(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None, least: int = 0) -> DataFrame:
    """Writes the pages to archives (in the shared folder unless ``path`` is given) and reads them back."""
    path = path or new_path(df.sparkSession, "warc")
    write(df, path, key, url, payload, least)
    return read(df.sparkSession, path, with_payload=False)


__all__ = ["archived", "key_of", "read", "records", "salvage", "write"]
