"""ARC archives into WARC, and WARC archives written and read with Spark.

The converter streams an ARC file: the version block's header says how later header lines are laid out (version 1: URL, address, date, type,
length; version 2 adds status, checksum, location, offset and file name), and each record's declared length bounds its bytes. Every record becomes
a WARC record with a derived identifier, timestamp, type and digests. Records with an equal payload become revisits of one response.

A table of records holds payloads as text; the converter's own streams (`read_arc`, `to_warc`, `read_warc`) are bytes, so payloads in other encodings than UTF-8 go
through those, not through a table.

Archives are gzip files of a bounded size in the shared folder, one for each task; readers parse them by declared lengths.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import materialize, new_folder, string_col

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
LEAST_REVISIT, ARCHIVE_BYTES = 100, 16 << 20
# Fixed values of the formats.
ARC_V1, ARC_V2 = ("URL IP-address Archive-date Content-type Archive-length", "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime.datetime(2000, 1, 1)

#: Shares into which the revisits of one response are dealt.
SALTS = 16


def version_block(version: int) -> bytes:
    """The record that opens an ARC file."""
    text = f"{version} 0 converter\n{ARC_V1 if version == 1 else ARC_V2}\n".encode()
    head = f"filedesc://archive.arc 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain"
    return f"{head} {len(text)}\n".encode() + text + b"\n" if version == 1 else f"{head} 200 - - 0 archive.arc {len(text)}\n".encode() + text + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int = 0) -> bytes:
    """One ARC record around a block of bytes."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:none"
    middle = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} archive.arc"
    return f"{url} 0.0.0.0 {date} text/html{middle} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def read_arc(stream):
    """(fields by lower-case name, block) of each record, by the layout that the version block names."""
    names = None
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        fields = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        block = stream.read(int(fields[-1]))
        if len(block) < int(fields[-1]):
            raise ValueError("an ARC record is shorter than its declared length")
        if names is None or fields[0].startswith("filedesc:"):
            layout = block.split(b"\n")
            if len(layout) < 2 or not layout[0][:1] in b"12":
                raise ValueError("an ARC file without a version block")
            names = [x.lower() for x in layout[1].decode("ascii", "replace").split()]
        if len(fields) != len(names):
            raise ValueError(f"an ARC header of {len(fields)} fields where the version has {len(names)}")
        yield dict(zip(names, fields, strict=True)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    return (b"", block) if not block.startswith(b"HTTP/") or end < 0 else (block[: end + 4], block[end + 4 :])


def record_id(payload: bytes, number: str) -> str:
    """Of the record with that number and payload; the same however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{number} {hashlib.sha256(payload).hexdigest()}')}>"


def to_warc(fields: dict[str, str], block: bytes, refers: str | None = None, number: str = "") -> bytes:
    """The WARC record of an ARC record; with `refers` (a record id) a revisit, which keeps the HTTP head only."""
    uri, date = fields["url"], fields["archive-date"]
    head, payload = split_http(block)
    kind = "warcinfo" if uri.startswith("filedesc:") else "revisit" if refers else "response" if head else "resource"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(payload, number)}",
        f"WARC-Date: {datetime.datetime.strptime((date + '00000101000000'[len(date):])[:14], '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}",
    ]
    if kind == "warcinfo":
        lines.append("Content-Type: text/plain")
    else:
        lines += [f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {fields['ip-address']}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
        lines.append("Content-Type: application/http; msgtype=response" if head else f"Content-Type: {fields['content-type']}")
    if refers:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    body = head if refers else block
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(stream):
    """(fields by lower-case name, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not the first line of a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a WARC record is shorter than its declared length")
        yield fields, block


class _Inflated(io.RawIOBase):
    """A gzip archive of one or more members, inflated piece by piece."""

    def __init__(self, data: bytes):
        self.pieces, self.rest = self._inflate(data), b""

    @staticmethod
    def _inflate(data: bytes):
        tool, held, at = zlib.decompressobj(31), b"", 0
        while held or at < len(data):
            if not held:
                held, at = data[at : at + 65536], at + 65536
            yield tool.decompress(held, 1 << 18)
            held = tool.unconsumed_tail
            if tool.eof:
                held, tool = tool.unused_data, zlib.decompressobj(31)
        yield tool.flush()

    def readable(self):
        return True

    def readinto(self, out):
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def first_of_payload(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload has at least that many bytes and stands on a page of smaller id."""
    narrow = pages.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    return narrow.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every page as a legacy ARC record, convert that to WARC, and store gzip archives of about archive_bytes (inflated) under path."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), string_col(pages, html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    total = rows.agg(F.sum(F.octet_length("payload").cast("long") + 1000)).first()[0] or 0
    n = max(1, -(-total // archive_bytes))
    again = first_of_payload(rows).repartition(n, "page_id", "digest")
    rows = rows.repartition(n, "page_id", "digest").join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def run(batches):
        for k, b in enumerate(batches):
            version = 1 + k % 2
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200).to_pylist()
                legacy = io.BytesIO()
                legacy.write(version_block(version))
                for r in part:
                    body = r["payload"].encode("utf-8", "surrogatepass")
                    number = "" if r["page_id"] is None else str(r["page_id"])
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {number}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    date = EPOCH + datetime.timedelta(seconds=(r["page_id"] or 0) % 10**9)
                    legacy.write(arc_record(version, r["url"], f"{date:%Y%m%d%H%M%S}", head + body, legacy.tell()))
                legacy.seek(0)
                out = []
                for i, (fields, block) in enumerate(read_arc(legacy)):
                    refers, number = None, f"{version}"
                    if i:
                        r = part[i - 1]
                        number = str(r["page_id"])
                        if r["refers_to"] is not None:
                            refers = record_id(split_http(block)[1], str(r["refers_to"]))
                    out.append(to_warc(fields, block, refers, number)[:-1].decode("utf-8", "surrogatepass"))  # the text writer puts the last line feed
                yield pa.RecordBatch.from_arrays([pa.array(out)], ["value"])

    rows.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_id of the records under path, without warcinfo."""
    schema = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out = []
                for fields, block in read_warc(io.BufferedReader(_Inflated(content.as_py()), 1 << 16)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    http = dict(re.findall(rb"([\w-]+): *([^\r\n]*)\r\n", head))
                    page = int(http[b"X-Page-Id"]) if http.get(b"X-Page-Id") else None
                    if fields["warc-type"] == "revisit":
                        size, digest = int(http[b"Content-Length"]), fields["warc-payload-digest"].partition(":")[2]
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != fields["warc-payload-digest"].partition(":")[2]:
                            raise ValueError("a payload differs from its digest")
                    out.append((fields["warc-record-id"], page, size, digest, fields["warc-type"], fields.get("warc-refers-to")))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                cols = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from its archive.

    A null html has an empty payload; payloads under 100 bytes are never revisits; of equal longer ones that of the smallest
    page_id is the response. Rows that repeat an id and payload all become what the first is. A null page_id is a response of its own.
    Other columns are ignored. An empty table gives an empty one.
    """
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    records = materialize(read_archives(pages.sparkSession, path), "records")
    # only revisits look for their response, and those of one response are dealt out by a salt
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = records.filter("refers_id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    asked = revisits.select(F.col("refers_id").alias("record_id")).distinct()
    heads = records.filter("record_type = 'response'").join(asked, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("page_id").alias("refers_to"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    alone = records.filter("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.join(heads, ["refers_id", "salt"], "left").select(*columns).unionByName(alone.select(*columns))
