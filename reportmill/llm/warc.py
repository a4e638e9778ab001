"""Web archives: legacy ARC files read by declared lengths and rewritten as WARC.

Archives are folders of gzip files, written and read through Spark's own sources, so they
may lie in any file system that Spark reaches. A file holds a bounded number of records and
bytes, and a task decompresses it as a stream.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, new_folder

#: Records of an archive file, and bytes of their payloads (or one longer payload).
FILE_ROWS, FILE_BYTES = 4096, 64 << 20
#: Revisits up to which they are broadcast (some 300 bytes each).
MOST_BROADCAST = 100_000
#: Payloads below this many bytes are always stored whole.
LEAST_REVISIT = 100
#: Fields of a record's header line in the two versions of the ARC format (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_GAP = "\r\n\r\n"


def _url(text: str | None) -> str:
    """A URL that fits a header line: no white space or control characters; "-" for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "") or "-"


def arc_record(version: int, url: str, date: str, mime: str, body: bytes, status: int = 200) -> bytes:
    more = f" {status} - - 0 -" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{more} {len(body)}\n".encode() + body


def arc_start(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 reportmill\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", block)


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, document) of each record after the version block.

    Only the first record can be a version block: later ones whose URL begins with
    ``filedesc://`` are pages. It names the fields of the header lines below it; if its length is
    missing or no number, its lines are read one by one, and the names are taken where they stand.
    A line that is no header, or declares more bytes than there are, is skipped, and reading goes
    on behind it.
    """
    fields = ARC_FIELDS[1].split(" ")
    at, first = 0, True
    while line := stream.readline():
        start, at = at, at + len(line)
        text = line.strip().decode("utf-8", "replace")
        if not text:
            continue
        begins, first = first and text.startswith("filedesc://"), False
        if begins:
            size = text.rpartition(" ")[2]
            block = stream.read(int(size)) if re.fullmatch("[0-9]{1,9}", size) else b""
            at += len(block)
            lines = block.decode("utf-8", "replace").split("\n")
            named = [x.split(" ") for x in lines if x.startswith("URL ")]
            fields = named[0] if named else ARC_FIELDS[2 if lines[0][:1] == "2" else 1].split(" ")
            continue
        if text in ARC_FIELDS.values():
            fields = text.split(" ")
            continue
        parts = text.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not re.fullmatch("[0-9]{1,18}", parts[-1]):
            continue
        body = stream.read(int(parts[-1]))
        at += len(body)
        if len(body) == int(parts[-1]):
            yield start, dict(zip(fields, parts, strict=True)), body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; no head if there is no status line."""
    if body.startswith(b"HTTP/"):
        head, gap, payload = body.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", body


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip() or None
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None


def warc_date(arc_date: str) -> str:
    d = (re.sub(r"[^0-9]", "", arc_date) + "19700101000000"[len(re.sub(r"[^0-9]", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, record_id: str, date: str, block: bytes, **named: str | None) -> bytes:
    """A record without the blank lines that end it. ``named``: further fields, _ for -."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date}
    fields |= {k.replace("_", "-"): v for k, v in named.items() if v is not None}
    fields |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return "".join(["WARC/1.0\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", "0")))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            raw = io.BytesIO(content.as_buffer())
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            yield path.as_py(), io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw


def _batched(rows: Iterator[dict], schema: pa.Schema, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_RECORD = pa.schema([("record", pa.binary()), ("file", pa.int32()), ("n", pa.int64())])
_RECORD_DDL = "record binary, file int, n bigint"


class _Files:
    """Deals records into files of bounded rows and bytes; a longer record is a file of its own."""

    def __init__(self, most_rows: int, most_bytes: int):
        self.number, self._rows, self._bytes = -1, most_rows, 0
        self._most_rows, self._most_bytes = most_rows, most_bytes

    def starts(self, size: int) -> bool:
        """Count a record; true if it is the first of a file."""
        new = self._rows >= self._most_rows or self._rows and self._bytes + size > self._most_bytes
        if new:
            self.number, self._rows, self._bytes = self.number + 1, 0, 0
        self._rows, self._bytes = self._rows + 1, self._bytes + size
        return bool(new)


def _numbered(rows: Iterator[dict]) -> Iterator[dict]:
    return (row | {"n": n} for n, row in enumerate(rows))


def _write(records: DataFrame, path: str, gap: str) -> None:
    """Byte records, each followed by ``gap``, as gzip files; a task's records name their file.

    They are sorted by file and number: the writer wants a file's records together, and its own
    sort, by file alone, may mix these once it spills.
    """
    text = records.sortWithinPartitions("file", "n").select(F.col("record").cast("string").alias("value"), "file")
    text.write.partitionBy("file").option("lineSep", gap).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files; a task reads a few and holds one at a time."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, key: str, url: str, html: str, date: str = "20240101000000") -> None:
    """Write an ARC record for each row, both versions in turn by partition.

    The document is an HTTP response whose X-Page-Id field has the key.
    """
    bound_batches(pages.sparkSession)
    limits = (FILE_ROWS, FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, files = 1 + part % 2, _Files(*limits)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if files.starts(len(h)):
                        yield {"record": arc_start(version, f"pages-{part}-{files.number}.arc", date), "file": files.number}
                    named = "" if k is None else str(k)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(h)}\r\nX-Page-Id: {named}\r\n\r\n"
                    yield {"record": arc_record(version, _url(u), date, "text/html", head.encode() + h), "file": files.number}

        return _batched(_numbered(rows()), _RECORD)

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("h"))
    _write(rows.mapInArrow(run, _RECORD_DDL), path, "\n")


_META = [("arc_file", pa.string()), ("arc_offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())]
_META_DDL = "arc_file string, arc_offset bigint, page_id bigint, url string, date string, record_id string, digest string, n_bytes bigint"


def arc_records(spark: SparkSession, path: str, documents: bool) -> DataFrame:
    """A row per ARC record with its WARC identity; the document itself only if asked for.

    The record id is a name-based UUID of URL, date, place and digest, so reading a file
    again gives the same one. Place is the file's name and the record's offset there.
    """
    schema = pa.schema([*_META, *([("head", pa.binary()), ("payload", pa.binary())] if documents else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for name, stream in _streams(batches):
                name = "/".join(name.rsplit("/", 2)[1:])
                for offset, fields, body in read_arc(stream):
                    head, payload = split_http(body)
                    digest = hashlib.sha256(payload).hexdigest()
                    date = warc_date(fields["Archive-date"])
                    place = f"{fields['URL']} {date} {offset} {digest} {http_field(head, 'X-Page-Id')}"
                    row = {"arc_file": name, "arc_offset": offset, "page_id": _number(http_field(head, "X-Page-Id")), "url": fields["URL"], "date": date, "record_id": f"<{uuid.uuid5(uuid.NAMESPACE_URL, place).urn}>", "digest": digest, "n_bytes": len(payload)}
                    yield row | ({"head": head, "payload": payload} if documents else {})

        return _batched(rows(), schema)

    return _files(spark, path).mapInArrow(run, _META_DDL + (", head binary, payload binary" if documents else ""))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """Convert a folder of ARC files to WARC; equal payloads are stored once.

    Of records with one payload of ``least`` bytes or more, that with the smallest page id
    (then file and offset; records without an id last) becomes a response, the others revisit
    it. Digests meet first without payloads, pre-aggregated per task; hot digests are split
    by the runtime's skew join. Only the revisits meet the payloads, by their unique place:
    broadcast behind a count of them, so that payloads are not shuffled, or joined where they are
    more.
    """
    bound_batches(spark)
    limits = (FILE_ROWS, FILE_BYTES)
    meta = arc_records(spark, arc_path, documents=False)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "arc_file", "arc_offset", "record_id", "url", "date")
    firsts = meta.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = meta.join(firsts, "digest").filter((F.col("arc_file") != F.col("first.arc_file")) | (F.col("arc_offset") != F.col("first.arc_offset")))
    again = again.select("arc_file", "arc_offset", F.col("first.page_id").alias("to_page"), F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))
    again = cut(again)
    if again.count() <= MOST_BROADCAST:
        again = F.broadcast(again)
    full = arc_records(spark, arc_path, documents=True).join(again, ["arc_file", "arc_offset"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            files = _Files(*limits)
            for batch in batches:
                for r in batch.to_pylist():
                    if files.starts(len(r["payload"]) if r["to_id"] is None else 0):
                        about = b"software: reportmill\r\nformat: WARC File Format 1.0\r\n"
                        yield {"record": warc_record("warcinfo", f"<{uuid.uuid5(uuid.NAMESPACE_URL, r['record_id'] + ' file').urn}>", r["date"], about, Content_Type="application/warc-fields"), "file": files.number}
                    kind = "application/http;msgtype=response" if r["head"] else "application/octet-stream"
                    same = {"WARC_Target_URI": r["url"], "WARC_Payload_Digest": f"sha256:{r['digest']}", "X_Payload_Length": str(r["n_bytes"]), "Content_Type": kind}
                    if r["to_id"] is None:
                        yield {"record": warc_record("response", r["record_id"], r["date"], r["head"] + r["payload"], **same), "file": files.number}
                        continue
                    first = {"WARC_Profile": _REVISIT, "WARC_Refers_To": r["to_id"], "WARC_Refers_To_Target_URI": r["to_url"], "WARC_Refers_To_Date": r["to_date"], "X_Refers_To_Page": None if r["to_page"] is None else str(r["to_page"])}
                    yield {"record": warc_record("revisit", r["record_id"], r["date"], r["head"], **same, **first), "file": files.number}

        return _batched(_numbered(rows()), _RECORD)

    _write(full.mapInArrow(run, _RECORD_DDL), warc_path, _GAP)


def read_warc_folder(spark: SparkSession, path: str) -> DataFrame:
    """A row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date.

    A response's length and digest are taken from its payload as read; a revisit, which
    stores none, has those of the full payload in its fields.
    """
    bound_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, stream in _streams(batches):
                for fields, block in read_warc(stream):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = _number(fields.get("x-payload-length")), fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    yield {"page_id": _number(http_field(head, "X-Page-Id")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields.get("x-refers-to-page")), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date")}

        return _batched(rows(), schema)

    return _files(spark, path).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, date string")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as ARC, convert that to WARC, and read the WARC files back.

    Null pages have an empty payload, null URLs are written "-", null keys come back as
    null. Repeated rows have a record each; equal keys with one payload go by place. Further
    columns are left out. Both archives are written at once to the shared folder.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc, key, url, html)
    arc_to_warc(spark, arc, warc)
    return read_warc_folder(spark, warc)
