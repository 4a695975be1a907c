"""Legacy archive converter: ARC files to WARC files.

An ARC file begins with a version block whose body names the fields of every later header line
(version 1: five fields, version 2: ten); each record is that line and as many bytes as the line
declares. The converter reads lines and lengths by the file's own version and makes WARC records with
identifiers (name-based UUIDs, so reruns agree), ISO timestamps, types and SHA-256 digests. Payloads
that occur more than once and have at least ``MIN_REVISIT`` bytes are stored once; the others become
revisit records that keep the HTTP head only.

Archives are gzip files in a folder that all executors share, written by Spark's text writer: every row
is one record's text, and the writer's line separator is the format's record separator.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import query, shared_path, table

MIN_REVISIT = 100
#: Copies of a frequent payload are dealt over so many tasks when they meet their first record.
SALTS = 16
#: When a legacy record carries no date of its own.
EPOCH = "19960101000000"

# Fixed values of the ARC format: the version block's second line and field names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "page_id bigint, url string, ip string, date string, mime string, status int, head binary, "
    "payload binary, payload_bytes bigint, payload_digest string"
)


def arc_line(version: int, url: str | None, date: str, mime: str, status: int, body: bytes, name: str) -> str:
    """A record's header line. A missing address becomes '-', white space in it is escaped."""
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-"
    if version == 1:
        return f"{url} 0.0.0.0 {date} {mime} {len(body)}"
    checksum = hashlib.md5(body).hexdigest()
    return f"{url} 0.0.0.0 {date} {mime} {status} {checksum} - 0 {name} {len(body)}"


def version_block(version: int, name: str, date: str = EPOCH) -> str:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}"
    if version == 2:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"
    return f"{line}\n{body}"


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """``pages`` (page_id, url, html) as ARC files, one per partition. The identifier travels in the
    HTTP head. Null html is an empty payload; other columns are left out."""
    name = f"legacy-v{version}.arc"

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [version_block(version, name)]})
        for batch in batches:
            out = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                payload = html or ""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if not pd.isna(page_id):
                    head += f"X-Page-Id: {int(page_id)}\r\n"
                size = len(payload.encode())
                text = f"{head}Content-Length: {size}\r\n\r\n{payload}"
                line = arc_line(version, url, EPOCH, "text/html", 200, text.encode(), name)
                out.append(f"{line}\n{text}")
            yield pd.DataFrame({"value": out})

    # A nullable integer would reach pandas as a float, which cannot hold large identifiers.
    own = pages.select(F.col("page_id").cast("string"), "url", F.col("html").cast("string"))
    own.mapInPandas(records, "value string").write.option("lineSep", "\n").option(
        "compression", "gzip"
    ).text(path)


class _Stream:
    """Reads lines and counted bytes from gzip members without unpacking the file as a whole."""

    CHUNK = 1 << 16

    def __init__(self, data: bytes):
        self._data, self._at, self._z = memoryview(data), 0, None
        self._buf, self._pos = b"", 0
        if bytes(self._data[:2]) == b"\x1f\x8b":
            self._z = zlib.decompressobj(31)

    def _more(self) -> bytes:
        """The next unpacked bytes, empty at the end."""
        while self._at < len(self._data):
            piece = self._data[self._at : self._at + self.CHUNK]
            self._at += len(piece)
            if self._z is None:
                return bytes(piece)
            out = self._z.decompress(piece)
            while self._z.eof and self._z.unused_data:
                rest, self._z = self._z.unused_data, zlib.decompressobj(31)
                out += self._z.decompress(rest)
            if out:
                return out
        return b""

    def line(self) -> bytes | None:
        while (end := self._buf.find(b"\n", self._pos)) < 0:
            more = self._more()
            if not more:
                rest, self._buf, self._pos = self._buf[self._pos :], b"", 0
                return rest or None
            self._buf, self._pos = self._buf[self._pos :] + more, 0
        start, self._pos = self._pos, end + 1
        return self._buf[start : end + 1]

    def take(self, n: int) -> bytes:
        if len(self._buf) - self._pos >= n:
            start, self._pos = self._pos, self._pos + n
            return self._buf[start : self._pos]
        parts, have = [self._buf[self._pos :]], len(self._buf) - self._pos
        while have < n:
            more = self._more()
            if not more:
                raise ValueError(f"the archive ends {n - have} bytes before a record does")
            parts.append(more)
            have += len(more)
        over = have - n
        self._buf, self._pos = parts[-1], len(parts[-1]) - over
        return b"".join(parts)[:n]


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of an ARC file after its version block."""
    stream = _Stream(data)
    fields: list[str] = []
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if values[0].startswith("filedesc:"):
            block = stream.take(int(values[-1])).decode("utf-8", "replace").splitlines()
            if int(block[0].split()[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version: {block[0]}")
            fields = block[1].split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"header line with {len(values)} fields where {len(fields)} are declared")
        yield dict(zip(fields, values)), stream.take(int(values[-1]))


def _http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a body without a head is all payload."""
    if body.startswith(b"HTTP/") and (end := body.find(b"\r\n\r\n")) >= 0:
        return body[: end + 4], body[end + 4 :]
    return b"", body


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files below ``path`` (see ``RECORD``), of version 1 and 2 alike."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows: list[tuple] = []
                for fields, body in arc_records(data):
                    head, payload = _http(body)
                    page_id = _header(head, "X-Page-Id")
                    status = fields.get("Result-code") or (head[9:12].decode() if head else "")
                    rows.append((
                        page_id, None if fields["URL"] == "-" else fields["URL"], fields["IP-address"],
                        fields["Archive-date"], fields["Content-type"], status if status.isdigit() else None,
                        head, payload if payloads else None, len(payload), hashlib.sha256(payload).hexdigest(),
                    ))
                    if len(rows) == 200:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    names = [x.split()[0] for x in RECORD.split(", ")]
    text = RECORD.replace("page_id bigint", "page_id string").replace("status int", "status string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return (
        files.select("content")
        .mapInPandas(parse, text)
        .withColumn("page_id", F.col("page_id").cast("bigint"))
        .withColumn("status", F.col("status").cast("int"))
    )


def iso_date(date: str) -> str:
    """Fourteen digits (fewer in old files) as an ISO timestamp."""
    d = (date + EPOCH[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: object, url: object, date: object, digest: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {date} {digest}')}>"


def _warc_text(row) -> str:
    revisit = row.first_page is not None
    block = bytes(row.head) if revisit else bytes(row.head) + bytes(row.payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row.page_id, row.url, row.date, row.payload_digest)}",
        f"WARC-Date: {iso_date(row.date)}",
        f"WARC-IP-Address: {row.ip}",
        f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {row.url}")
    if row.page_id is not None:
        head.append(f"X-Page-Id: {row.page_id}")
    head.append(f"X-Payload-Length: {row.payload_bytes}")
    if revisit:
        first = record_id(row.first_page, row.first_url, row.first_date, row.payload_digest)
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {first}", f"X-Refers-To-Page-Id: {row.first_page}"]
    return "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8", "surrogateescape")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the ARC files' records as WARC files. Of equal payloads of at least ``MIN_REVISIT`` bytes
    the record with the smallest identifier is the response (records that repeat it too); the others
    revisit it. Records without an identifier are responses. Payloads must be valid UTF-8."""
    seen = read_arc(spark, arc_path, payloads=False).where(
        (F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()
    )
    firsts = (
        seen.groupBy("payload_digest")
        .agg(
            F.min("page_id").alias("first_page"),
            F.min_by("url", "page_id").alias("first_url"),
            F.min_by("date", "page_id").alias("first_date"),
            F.count("*").alias("n"),
        )
        .where("n > 1")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        .drop("n")
    )
    salted = read_arc(spark, arc_path).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(SALTS)).cast("int")
    )
    joined = salted.join(firsts, ["payload_digest", "salt"], "left").drop("salt")
    own = F.col("page_id").isNull() | (F.col("page_id") <= F.col("first_page"))
    first = F.when(~own, F.col("first_page"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).itertuples(index=False)
            yield pd.DataFrame({"value": [_warc_text(row) for row in rows]}, dtype=object)

    joined.withColumn("first_page", first.cast("string")).withColumn(
        "page_id", F.col("page_id").cast("string")
    ).mapInPandas(records, "value string").write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).text(warc_path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a WARC file; the block digest is verified."""
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip()] = value.strip()
        block = stream.take(int(fields["Content-Length"]))
        if fields.get("WARC-Block-Digest", "").removeprefix("sha256:") not in ("", hashlib.sha256(block).hexdigest()):
            raise ValueError(f"damaged block: {fields.get('WARC-Record-ID')}")
        yield fields, block


WARC_RECORD = (
    "page_id bigint, record_id string, record_type string, date string, url string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, refers_to_record string, head binary, payload binary"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path``; the payload of a revisit is null."""
    names = [x.split()[0] for x in WARC_RECORD.split(", ")]
    text = WARC_RECORD.replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows: list[tuple] = []
                for f, block in warc_records(data):
                    revisit = f["WARC-Type"] == "revisit"
                    head, payload = _http(block)
                    rows.append((
                        f.get("X-Page-Id"), f["WARC-Record-ID"], f["WARC-Type"], f["WARC-Date"], f.get("WARC-Target-URI"),
                        int(f["X-Payload-Length"]) if revisit else len(payload),
                        f["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                        f.get("X-Refers-To-Page-Id"), f.get("WARC-Refers-To"), head, None if revisit else payload,
                    ))
                    if len(rows) == 200:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return (
        files.select("content")
        .mapInPandas(parse, text)
        .withColumn("page_id", F.col("page_id").cast("bigint"))
        .withColumn("refers_to", F.col("refers_to").cast("bigint"))
    )


@query(
    "op9_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
    FROM p JOIN f USING (payload_digest)
    """,
)
def op9_warc(spark, sf_dir):
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
