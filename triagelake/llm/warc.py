r"""WARC archives: writing, and reading with salvage.

``write`` makes one gzip member per record.  Equal payloads of some size are
kept once: the row of least key is a response, the others revisit it.  The
members leave Spark through its text writer, whose row separator is the zero
byte that ends every member (an empty member is added to one of 16 MB or more,
the only ones that end otherwise), so files are committed as any output.

``scan`` reads archives, compressed or not, and checks members, version lines,
headers, lengths and digests.  Where a check fails it searches for the next
member or version line that stands all checks, goes on from there, and logs
the bytes between as a gap: ``reason`` says what failed, and is NULL for
records.  An archive file is one row of the scan, 2 GB at most; files made here
stay near ``FILE_BYTES``.

Defined results: a NULL payload is empty and a NULL key stays NULL; a row that
repeats the response's key is a response too, and rows of NULL key revisit the
response if there is one and are responses if not; empty tables give no
records; other columns are ignored.  Control characters and spaces in a URL
are written as their percent codes, a NULL one is left out.  A record that
stands whole inside a damaged one's payload is recovered like any other.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import record_batches, tidy
from triagelake.session import checkpoint

FILE_BYTES = 32 << 20
LEAST = 100
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
# An empty gzip member.
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
MARK = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")
ID = "urn:key:"
FIELDS = "file string, offset bigint, length bigint, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, reason string"
NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(",")]


def planned(df: DataFrame, key: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """``id, url, body, digest, first, n``: for copies of an earlier payload ``first`` is its response's key."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(key).alias("k"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("n", F.octet_length("body").cast("long"))
    seen = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("k").alias("least"), F.count("*").alias("copies"))
    again = checkpoint(seen.where("copies > 1 AND least IS NOT NULL").select(F.col("digest").alias("d"), "least"))
    joined = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("n") >= least), "left")
    first = F.when(~F.col("k").eqNullSafe(F.col("least")), F.col("least").cast("string"))
    return joined.select("id", "url", "body", "digest", first.alias("first"), "n")


def record(id_, url, body: bytes, digest: str, first, n: int, date: str) -> bytes:
    """One record as bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if first is not None else http + body
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{'' if id_ is None else id_}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if first is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{first}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY


def write(df: DataFrame, path: str, key: str = "id", url: str = "url", payload: str = "payload", date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive the rows of ``df`` under ``path``, a new folder."""

    def task(batches):
        for batch in record_batches(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body", "digest", "first", "n")))
            # The separator brings the last byte.
            yield pa.record_batch([pa.array([member(record(*r, date))[:-1] for r in rows], pa.binary())], names=["value"])

    plan = planned(df, key, url, payload)
    size = df.agg(F.avg(F.octet_length(payload))).first()[0] or 0
    files = plan.mapInArrow(tidy(task), "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + 500)))).text(path)


class Damaged(Exception):
    """A check that failed."""


def parsed(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    lines = data[at:end].split(b"\r\n")
    if lines[0] + b"\r\n" not in (VERSION, b"WARC/1.0\r\n"):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name or re.search(r"[\x00-\x20\x7f]", name):
            raise Damaged("header field")
        name = name.lower()
        if name in fields and name != "warc-concurrent-to":
            raise Damaged("repeated field")  # as when the end of a header is lost
        fields[name] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("length")
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("field missing")
    block = data[start:stop]
    algorithm, _, digest = fields.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise Damaged("block digest")
    return told(fields, block), stop + 4


def told(fields: dict, block: bytes) -> dict:
    """The columns of a record."""
    payload, n = block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        n = int(said[1]) if said and fields["warc-type"] == "revisit" else len(payload)
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if fields["warc-type"] == "revisit":
        payload = b""
    else:
        actual = hashlib.sha256(payload).hexdigest()
        if algorithm == "sha256" and actual != digest.lower():
            raise Damaged("payload digest")
        digest = actual
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "record_id": bare("warc-record-id"), "record_type": fields["warc-type"], "target_uri": bare("warc-target-uri"),
        "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_bytes": n, "payload": payload,
    }


def inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its checksum and length are checked."""
    reader = zlib.decompressobj(31)
    parts, end = [], at
    try:
        while not reader.eof:
            part = data[end : end + (1 << 16)]
            if not part:
                raise Damaged("member without end")
            parts.append(reader.decompress(part))
            end += len(part)
    except zlib.error as error:
        raise Damaged("gzip member") from error
    return b"".join(parts), end - len(reader.unused_data)


def plain(data: bytes, at: int, end: int | None = None) -> Iterator[tuple[int, int, dict | str]]:
    """``start, end`` and record, or reason of a gap, from ``at`` on."""
    n, bad, why = len(data) if end is None else end, None, ""
    while at < n:
        try:
            if data.startswith(MAGIC, at):
                content, stop = inflated(data, at)
                inner = list(plain(content, 0))
                if bad is not None and not any(isinstance(what, dict) for *_, what in inner):
                    raise Damaged("member without record")
                found = [(at, stop, what if isinstance(what, dict) else f"in member: {what}") for *_, what in inner]
            elif data.startswith(b"WARC/", at):
                what, stop = parsed(data, at)
                found = [(at, stop, what)]
            else:
                raise Damaged("no member or version line")
        except Damaged as error:
            if bad is None:
                bad, why = at, str(error)
            mark = MARK.search(data, at + 1)
            at = mark.start() if mark else n
            continue
        if bad is not None:
            yield bad, at, why
            bad = None
        yield from found
        at = stop
    if bad is not None:
        yield bad, n, why


def salvage(file: str, data: bytes) -> Iterator[dict]:
    """Rows of one archive."""
    for start, end, what in plain(data, 0):
        row = dict.fromkeys(NAMES) | {"file": file, "offset": start, "length": end - start}
        yield row | ({"reason": what} if isinstance(what, str) else what)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every gap of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.strip().split(" ")[1]]) for n, f in zip(NAMES, FIELDS.split(","))])

    def task(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                for row in salvage(file.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20 or len(held) > 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(tidy(task), FIELDS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records that stand all checks."""
    return scan(spark, path).where("reason IS NULL").drop("reason")


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """The byte ranges in quarantine: ``file, offset, length, reason``."""
    return scan(spark, path).where("reason IS NOT NULL").select("file", "offset", "length", "reason")
