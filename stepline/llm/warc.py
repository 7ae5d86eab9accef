"""Legacy archive converter: ARC files to WARC.

An ARC file is a version block and then records, each a header line, as many bytes as the
line declares, and a line break.  The version block names the format of header lines: version
1 has five fields (URL, IP address, date, type, length), version 2 has ten (URL, IP
address, date, type, result code, checksum, location, offset, file name, length).  Fields are
cut from the right, as old crawlers left blanks in URLs.

From each ARC record a WARC record is made up: a record id derived from its place (file and byte)
and content, the 14-digit date in ISO form, the type from the content (``response`` for HTTP, ``resource``
for others, ``warcinfo`` for the version block), and SHA-1 digests of block and payload.
Of records with equal payloads of at least ``least_bytes`` one is kept whole, the others
become ``revisit`` records that carry the HTTP header only and refer to it.

Blocks stay bytes from end to end, whatever their encoding.  What is no record (a stray line, an
end within a record, a length that is no number, a gzip member that is damaged or cut short) is a reject with its file, place and reason; what
comes after it is still read.

How it runs.  Spark writes both kinds of archive as gzipped text files, whose line separator
is the record separator and whose lines are any bytes, so they go wherever Spark can write; ``maxRecordsPerFile`` bounds
them, as a file is read back whole.  Payloads never leave their task: digests are counted
first, and those that occur twice are joined to the records, as a broadcast where they are
few enough (``MOST_SHARED``), else by a shuffle.

Cases: a null payload is empty; a null URL becomes ``urn:page:`` and the id; empty and short
payloads are never revisits; equal payloads with tied ids: any of them is the one kept, the
others revisit it; a null id never is the one kept unless all are null; repeated rows give a
record each, with an id of its own, and those of enough bytes but for one revisit that one; no rows give archives without records and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.common import cut, fresh_path

#: Records in an archive file.
RECORDS = 1000
#: Shared payloads that are broadcast, at most.
MOST_SHARED = 50_000
LEAST_BYTES = 1000
#: Fixed values of the ARC format: the header line's fields by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def arc_block(version: int, date: str) -> str:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 stepline\n{ARC_FIELDS[version]}\n"
    tail = f"{len(body)}" if version == 1 else f"200 - - 0 pages.arc {len(body)}"
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {tail}\n{body}"


def arc_record(version: int, date: str, page_id, url, html) -> str:
    page, payload = "" if page_id is None else str(page_id), html or ""
    url = re.sub(r"[\r\n]", "", url or f"urn:page:{page}")
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(payload.encode())}\r\n\r\n{payload}"
    data = content.encode()
    tail = f"{len(data)}" if version == 1 else f"200 {hashlib.md5(data).hexdigest()} - 0 pages.arc {len(data)}"
    return f"{url} 192.0.2.1 {date} text/html {tail}\n{content}"


def _arc_records(batches, date, records_per_file):
    """Records of one version after the other; each file's share begins with a version block."""
    n = TaskContext.get().partitionId() * records_per_file
    for batch in batches:
        out, size = [], 0
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            version = 1 + n // records_per_file % 2
            if n % records_per_file == 0:
                out.append(arc_block(version, date))
                n += 1
            out.append(arc_record(version, date, page_id, url, html))
            n, size = n + 1, size + len(html or "")
            if size > 1 << 23:
                yield pa.record_batch([pa.array(out, pa.string())], names=["record"])
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.string())], names=["record"])


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240102030405", records_per_file: int = RECORDS) -> None:
    """Pages as ARC files below ``path``, of versions 1 and 2."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows.mapInArrow(lambda it: _arc_records(it, date, records_per_file), "record string").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, each with its place ``at``; a reject has a reason ``error`` and no content.

    A compressed file is read member by member: one that is cut short or damaged gives what it holds up to there and a reject, and
    reading goes on at the next one.
    """
    start, versions = 0, [1]
    for run, error in unzipped_runs(data):
        for record in _parse_run(run, versions):
            yield record | {"at": record["at"] + start}
        start += len(run)
        if error:
            yield {"at": start, "error": error}


def _parse_run(data: bytes, versions: list[int]) -> Iterator[dict]:
    """``versions``: those declared so far; the last one holds."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        version = versions[-1]
        fields = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
        is_block = line.startswith("filedesc://")
        size = (line.split(" ") if is_block else fields)[-1]
        if not re.fullmatch(r"[0-9]{1,18}", size) or not is_block and len(fields) != len(ARC_FIELDS[version].split()):
            # the next header line is looked for on the next line
            yield {"at": at, "error": f"not a header line of version {version}"}
            at = end + 1
            continue
        body = data[end + 1 : end + 1 + int(size)]
        if len(body) < int(size):
            yield {"at": at, "error": "the file ends within the record"}
            return
        if is_block:
            declared = body.split(b" ", 1)[0]
            if declared in (b"1", b"2"):
                versions.append(int(declared))
            else:
                yield {"at": at, "error": "a version block of no known version"}
        else:
            yield dict(zip(ARC_FIELDS[version].split(), fields)) | {"at": at, "error": None, "content": body}
        at = end + 1 + int(size)


GZIP = b"\x1f\x8b\x08"


def unzipped_runs(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The bytes of a file in runs, each but the last ended by a gzip member that can't be read on, with the reason; one run if it isn't compressed."""
    if data[:2] != GZIP[:2]:
        yield data, None
        return
    run, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            # in pieces, so that what stands before the damage is kept
            for a in range(at, len(data), 1 << 16):
                run.append(member.decompress(data[a : a + (1 << 16)]))
                if member.eof:
                    break
            error = None if member.eof else "the file ends within a gzip member"
        except zlib.error:
            error = "a gzip member that can't be read"
        if error:
            yield b"".join(run), error
            run = []
            # a member's own bytes may look like the start of one: what can't be read there is passed over alike
            at = data.find(GZIP, at + 1)
            at = len(data) if at < 0 else at
        else:
            at = min(a + (1 << 16), len(data)) - len(member.unused_data)
            # what follows a member is another one; bytes that are none are passed over
            if at < len(data) and data[at : at + 3] != GZIP:
                following = data.find(GZIP, at)
                if data[at:].strip(b"\0"):
                    yield b"".join(run), "bytes after a gzip member that are none"
                    run = []
                at = len(data) if following < 0 else following
    if run:
        yield b"".join(run), None


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def split_http(block: bytes) -> tuple[dict, bytes]:
    """Header fields (lower-case names) and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, payload


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uuid(digest: bytes) -> str:
    h = digest[:16].hex()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) & 3]}{h[17:20]}-{h[20:32]}"


def warc_fields(record: dict, file: str = "") -> dict:
    """What a WARC record needs, from an ARC record."""
    block = record["content"]
    is_http = block.startswith(b"HTTP/")
    head, payload = split_http(block) if is_http else ({}, block)
    page = head.get("x-page-id", "")
    d = re.sub(r"[^0-9]", "0", record["Archive-date"])[:14].ljust(14, "0")
    place = f"{file}:{record['at']}:{record['Archive-date']}:"
    url = record["URL"].encode("utf-8", "surrogateescape")
    return {
        "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None,
        # bytes of a URL that are no UTF-8 are written as percent codes
        "url": re.sub(rb"[\x80-\xff]", lambda m: b"%%%02X" % m[0][0], url).decode() if "\udc80" <= max(record["URL"], default="") <= "\udcff" else record["URL"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "record_id": _uuid(hashlib.sha1(place.encode("utf-8", "replace") + url + b"\n" + block).digest()),
        "type": "response" if is_http else "resource",
        "ip": record["IP-address"].encode("ascii", "replace").decode(),
        "head": block[: len(block) - len(payload)],
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_digest": _sha1(payload),
        "block_digest": _sha1(block),
        "head_digest": _sha1(block[: len(block) - len(payload)]),
    }


FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("ip", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string())])
REJECTS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("reason", pa.string())])


def _batches(rows: Iterator[dict], schema: pa.Schema, at_once: int = 200):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _read_arc(batches):
    def rows():
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from (warc_fields(x, file) for x in parse_arc(data) if not x["error"])

    yield from _batches(rows(), FIELDS)


def _read_rejects(batches):
    def rows():
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from ({"file": file, "at": x["at"], "reason": x["error"]} for x in parse_arc(data) if x["error"])

    yield from _batches(rows(), REJECTS)


def _archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_arc(spark, path: str) -> DataFrame:
    """The records of the ARC files below ``path``, with the fields of WARC records."""
    return _archives(spark, path).mapInArrow(_read_arc, "page_id long, url string, date string, record_id string, type string, ip string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, head_digest string")


def arc_rejects(spark, path: str) -> DataFrame:
    """(file, at, reason) of what is no record in the ARC files below ``path``."""
    return _archives(spark, path).mapInArrow(_read_rejects, "file string, at long, reason string")


def mark_revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds original_id and original_page (of the record to refer to; null for all others)."""
    long_ones = records.filter(F.col("payload_bytes") >= least_bytes)
    kept = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record_id", "url", "date")).alias("kept")
    shared = cut(long_ones.groupBy("payload_digest").agg(kept, F.count("*").alias("n")).filter("n > 1"))
    shared = shared.select(F.col("payload_digest").alias("digest"), "kept")
    if shared.limit(MOST_SHARED + 1).count() <= MOST_SHARED:
        shared = F.broadcast(shared)
    digest = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("short:"), "record_id"))
    joined = records.withColumn("digest", digest).join(shared, "digest", "left")
    other = F.col("kept").isNotNull() & (F.col("kept.record_id") != F.col("record_id"))
    return joined.select(records["*"], *[F.when(other, F.col(f"kept.{a}")).alias(b) for a, b in (("record_id", "original_id"), ("page_id", "original_page"), ("url", "original_url"), ("date", "original_date"))])


def warc_records(marked: DataFrame) -> DataFrame:
    """The text of each WARC record, without the two line breaks that end it."""
    revisit = F.col("original_id").isNotNull()
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    bare = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    http = F.col("type") == "response"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))),
        field("WARC-Record-ID", bare(F.col("record_id"))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.col("payload_digest")),
        field("WARC-Block-Digest", F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", bare(F.col("original_id"))), field("WARC-Refers-To-Target-URI", F.col("original_url")), field("WARC-Refers-To-Date", F.col("original_date")), field("X-Payload-Length", F.col("payload_bytes").cast("string")), field("X-Refers-To-Page", F.coalesce(F.col("original_page").cast("string"), F.lit(""))))).otherwise(F.lit("")),
        field("Content-Type", F.when(http, F.lit("application/http;msgtype=response")).otherwise(F.lit("application/octet-stream"))),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    # a string of any bytes: the text sink writes them as they are
    return marked.select(F.concat(head.cast("binary"), block).cast("string").alias("record"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """WARC files below ``path``: each record and, as the format asks, two line breaks."""
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file."""
    data, at = unzipped(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:100]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, block
        at = end + 8 + size


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())])


def _read_warc(batches, payloads):
    def rows():
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for fields, block in parse_warc(data):
                    if _sha1(block) != fields["warc-block-digest"]:
                        raise ValueError(f"the block of {fields['warc-record-id']} has another digest than its header says")
                    kind = fields["warc-type"]
                    head, payload = split_http(block) if block.startswith(b"HTTP/") else ({}, block)
                    page, to = head.get("x-page-id", ""), fields.get("x-refers-to-page", "")
                    yield {
                        "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None,
                        "payload_bytes": int(fields["x-payload-length"]) if kind == "revisit" else len(payload),
                        "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
                        "record_type": kind,
                        "refers_to": int(to) if to else None,
                        "url": fields["warc-target-uri"],
                        "record_id": fields["warc-record-id"].strip("<>"),
                        "payload": payload if payloads and kind != "revisit" else None,
                    }

    yield from _batches(rows(), READ)


def read_warc(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of the WARC files below ``path``; blocks are held against their digests."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda it: _read_warc(it, payloads), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")


def convert(pages: DataFrame, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS, payloads: bool = False) -> DataFrame:
    """Pages to ARC files, those to WARC files, and those read back (``payloads``: with the payloads, as bytes)."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, records_per_file=records_per_file)
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")
    write_warc(warc_records(mark_revisits(read_arc(spark, arc), least_bytes)), warc, records_per_file)
    return read_warc(spark, warc, payloads)
