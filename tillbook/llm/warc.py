"""Legacy archive converter: ARC records to WARC records, and WARC archives
written and read with Spark.

An ARC file starts with a version block that names the fields of its header
lines (five in version 1, ten in version 2). ``parse_arc`` reads header lines
by that version, from the right because old URLs may hold spaces, and bodies
by their declared lengths. Each record becomes the fields of an equivalent
WARC record: an identifier (UUID of the record's origin, so repeatable), the
14-digit date as a WARC date, a type, and SHA-256 digests.

``write_archives`` writes records with Spark's text writer (a cast from
binary keeps bytes as they are; the record separator is the line separator),
gzip-compressed, at most ``RECORDS_PER_FILE`` a file. ``read_archives``
decompresses and parses files as streams, by declared lengths.

Of records with equal payloads of at least ``least`` bytes, the one with the
smallest id is a response and the others revisit it. Digests are counted with
a map-side-combined aggregate; only digests that occur twice or more are
joined back.

Defined results: a null payload is empty. Payloads under ``least`` bytes are
always responses. A null id never is the response if the payload has one with
an id; payloads with null ids only are all responses. Repeated rows with the
response's own id are responses too (copies of it). A null URL is written as
"-". An empty table gives an empty result. Only id, URL and payload are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.common import new_path, stored

# fixed values: the field lists of ARC version blocks
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000
CONTAINER_BYTES = 8 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of UUIDs


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tillbook\n{ARC_FIELDS[version]}\n".encode()
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, body: bytes, name: str, offset: int) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{extra} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, the version block first."""
    at, n_fields, names = 0, None, None
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if n_fields is None:  # the version block says how its own and all later header lines are read
            version = int(data[end + 1:data.index(b" ", end + 1)])
            names = ARC_FIELDS[version].split(" ")
            n_fields = len(names)
        fields = line.rsplit(" ", n_fields - 1)
        if len(fields) != n_fields or not fields[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        length = int(fields[-1])
        body = data[end + 1:end + 1 + length]
        if len(body) != length:
            raise ValueError("an ARC record is shorter than its declared length")
        at = end + 1 + length
        yield dict(zip(names, fields)) | {"body": body}


def warc_fields(record: dict) -> dict:
    """The WARC equivalents of an ARC record. The payload of an HTTP response
    is what follows its header."""
    url, date, body = record["URL"], record["Archive-date"].ljust(14, "0"), record["body"]
    is_info = url.startswith("filedesc://")
    head, mark, payload = body.partition(b"\r\n\r\n")
    is_http = not is_info and body.startswith(b"HTTP/") and bool(mark)
    if not is_http:
        head, payload = b"", body
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} ' + hashlib.sha256(body).hexdigest())}",
        "warc_type": "warcinfo" if is_info else "response" if is_http else "resource",
        "warc_date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "url": url, "mime": record["Content-type"], "http_head": head + mark if is_http else b"",
        "payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(),
        "block_digest": hashlib.sha256(body).hexdigest()}


def pages_to_arc(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows of ARC containers (column arc): the legacy form of a page table.
    The id travels as an HTTP header field."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("-")), "[\\r\\n]", "%0A").alias("url"),
        F.date_format(F.timestamp_seconds(F.lit(820454400) + F.pmod(F.xxhash64(id_col, url_col), F.lit(300000000))),
                      "yyyyMMddHHmmss").alias("date"),
        F.encode(payload, "utf-8").alias("payload"))

    def run(batches):
        parts: dict[int, bytearray] = {}

        def add(k: int, b: pa.RecordBatch, i: int) -> bytes | None:
            version = 1 + k
            doc_id, url, date, payload = (b.column(c)[i].as_py() for c in ("id", "url", "date", "payload"))
            name = f"pages-v{version}.arc"
            if k not in parts:
                parts[k] = bytearray(arc_version_block(version, name, "19960101000000"))
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if doc_id is None else doc_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
            parts[k] += arc_record(version, url or "-", date, "text/html", head.encode() + payload, name, len(parts[k]))
            return bytes(parts.pop(k)) if len(parts[k]) >= CONTAINER_BYTES else None

        for b in batches:
            for i in range(b.num_rows):
                full = add(i % 2, b, i)
                if full is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([full], pa.binary())], names=["arc"])
        for rest in parts.values():
            yield pa.RecordBatch.from_arrays([pa.array([bytes(rest)], pa.binary())], names=["arc"])

    return src.mapInArrow(run, "arc binary")


WARC_FIELDS = ("record_id string, warc_type string, warc_date string, url string, mime string, http_head binary, "
               "payload binary, payload_digest string, block_digest string")


def arc_to_warc(arcs: DataFrame, arc_col: str = "arc") -> DataFrame:
    """One row of WARC fields per ARC record. ``arc_col`` holds whole ARC
    files, as the binaryFile source reads them."""
    names = [f.split(" ")[0] for f in WARC_FIELDS.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.string() for f in WARC_FIELDS.split(", ")]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def run(batches):
        for b in batches:
            for value in b.column(0):
                rows, size = [], 0
                for record in parse_arc(value.as_py() or b""):
                    rows.append(warc_fields(record))
                    size += len(record["body"])
                    if size >= CONTAINER_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return arcs.select(arc_col).mapInArrow(run, WARC_FIELDS)


def write_archives(records: DataFrame, path: str) -> None:
    """Records with the columns of ``arc_to_warc`` and refers_to (the record
    id that a revisit refers to, else null)."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("http_head")).otherwise(F.concat("http_head", "payload"))
    kind = F.when(revisit, "revisit").otherwise(F.col("warc_type"))
    content = (F.when(kind == "warcinfo", "application/warc-fields").when(kind.isin("response", "revisit"), "application/http; msgtype=response")
               .otherwise(F.col("mime")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), F.col("record_id"), F.lit(">\r\nWARC-Date: "),
        F.col("warc_date"), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), "refers_to", F.lit(">")))
        .otherwise(F.concat(F.lit("\r\nWARC-Block-Digest: sha256:"), "block_digest")),
        F.lit("\r\nContent-Type: "), content, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    (records.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
     .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a stream of bytes."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            lines = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            start, length = end + 4, int(fields["Content-Length"])
            if len(buffer) < start + length + 4:
                break
            if not lines[0].startswith("WARC/") or buffer[start + length:start + length + 4] != b"\r\n\r\n":
                raise ValueError("a WARC record does not end where its length says")
            yield fields, bytes(buffer[start:start + length])
            at = start + length + 4
        del buffer[:at]
    if buffer:
        raise ValueError("a WARC file ends inside a record")


READ_FIELDS = "record_id string, record_type string, refers_to string, id string, payload_bytes bigint, payload_digest string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo: type, identifiers, and the length and
    digest of the payload that the record itself holds."""
    names = [f.split(" ")[0] for f in READ_FIELDS.split(", ")]

    def plain(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
        unzip = zlib.decompressobj(31)
        view = memoryview(content)
        for i in range(0, len(view), step):
            part = bytes(view[i:i + step])
            while part:
                yield unzip.decompress(part)
                part = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)

    def run(batches):
        for b in batches:
            for value in b.column("content"):
                rows = []
                for fields, block in parse_warc(plain(value.as_py())):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
                    refers = fields.get("WARC-Refers-To")
                    rows.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], refers and refers[1:-1],
                                 http.get("X-Page-Id") or None, len(payload), hashlib.sha256(payload).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64() if n == "payload_bytes" else pa.string())
                     for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, READ_FIELDS)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least: int = 100) -> DataFrame:
    """Pages through ARC and WARC and back: one row per page with id,
    payload_bytes, payload_digest, record_type, refers_to (a page id)."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    records = arc_to_warc(pages_to_arc(pages, id_col, url_col, payload_col)).filter("warc_type <> 'warcinfo'")
    page = F.regexp_extract(F.decode("http_head", "utf-8"), "\r\nX-Page-Id: ([^\r]*)\r\n", 1)
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    # digests that occur twice or more; the least id is the response
    first = stored(pages.filter(F.octet_length(payload) >= least)
                   .select(F.sha2(payload, 256).alias("payload_digest"), F.col(id_col).alias("id"))
                   .groupBy("payload_digest").agg(F.min("id").cast("string").alias("first_id"), F.count("*").alias("n"))
                   .filter("n > 1 and first_id is not null").drop("n"), "warc-first")
    marked = (records.withColumn("page", page).join(first, "payload_digest", "left")
              .withColumn("is_first", F.col("first_id").isNull() | (F.col("first_id") == F.col("page"))))
    # the identifier of a response follows from its page, so revisits know it without a join
    name = lambda p: F.concat(F.lit("urn:page:"), F.sha1(F.concat_ws(" ", p, F.col("payload_digest"))))
    marked = marked.withColumn("record_id", F.when(F.col("first_id").isNotNull() & F.col("is_first"), name(F.col("first_id")))
                               .otherwise(F.col("record_id")))
    out = new_path(spark, "warc")
    write_archives(marked.withColumn("refers_to", F.when(~F.col("is_first"), name(F.col("first_id")))), out)
    back = stored(read_archives(spark, out), "warc-read")
    responses = back.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"),
        F.col("payload_digest").alias("r_digest")).filter(F.startswith("refers_to", F.lit("urn:page:"))).distinct()
    found = back.join(responses, "refers_to", "left")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        F.col("id").cast(id_type).alias("id"),
        F.when(revisit, F.col("r_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("r_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("r_id").cast(id_type).alias("refers_to"))
