"""Conversion of legacy ARC archives to WARC, and both formats as DataFrames.

``arc_records`` reads archives of version 1 and 2: the version block of the first record names the fields of the header
lines, and every record has as many bytes as its header line declares. ``to_warc`` makes up what ARC lacks: record
identifiers, ISO timestamps, record types and SHA-1 digests. Archives are bounded in size, are written by Spark's text
writer (one archive a row and a file, gzip) and are read as whole binary files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, ready

#: Fields of a header line by version, fixed by the format.
ARC_FIELDS = {
    b"1": "URL IP-address Archive-date Content-type Archive-length".split(),
    b"2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
_CRLF = b"\r\n"
_GZIP = b"\x1f\x8b\x08"
_STEP = 65_536
_BEGIN = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def unpacked(data: bytes) -> bytes:
    """The bytes of a file that may be gzip, of one member or of many.

    Of a broken member the bytes before the damage are kept, and reading goes on at the next one.
    """
    if data[:2] != _GZIP[:2]:
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        try:
            for k in range(0, len(data), _STEP):
                out.append(z.decompress(data[k : k + _STEP]))
                if z.eof:
                    break
            data = (z.unused_data + data[k + _STEP :]).lstrip(b"\0") if z.eof else b""
        except zlib.error:
            start = data.find(_GZIP, 1)
            data = data[start:] if start > 0 else b""
    return b"".join(out)


def arc_records(data: bytes, strict: bool = True) -> Iterator[dict]:
    """Records of one ARC archive: its header fields by name, ``version`` and ``block``.

    A version block without a field line has the fields of its version. An archive that breaks off ends with the last
    whole record. Where a header line should be and is none, ``strict`` raises; else reading goes on at the next line that has
    a url, a numeric date and a numeric length in their places.
    """
    at, fields, version, lost = 0, ARC_FIELDS[b"1"], "1", False
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r")
        own = ARC_FIELDS[b"1"] if line.startswith(b"filedesc://") else fields
        parts = line.rsplit(b" ", len(own) - 1)
        if len(parts) != len(own) or not parts[-1].isdigit():
            if strict:
                raise ValueError(f"not an ARC header line: {line[:80]!r}")
            at, lost = end + 1, True
            continue
        if lost and not (b":" in parts[0] and parts[2].isdigit()):
            at = end + 1
            continue
        lost = False
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            return
        at = end + 1 + size
        if line.startswith(b"filedesc://"):
            lines = block.splitlines()
            number = lines[0].split(b" ")[0] if lines else b"1"
            if strict and number not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version: {number[:20]!r}")
            version = number.decode("latin-1")
            fields = lines[1].decode("latin-1").split(" ") if len(lines) > 1 and lines[1].strip() else ARC_FIELDS.get(number, ARC_FIELDS[b"1"])
        yield {k: v.decode("utf-8", "replace") for k, v in zip(own, parts)} | {"version": version, "block": block}


def arc_archive(records: Iterable[tuple[str, bytes, str]], version: str = "1", name: str = "archive") -> bytes:
    """An ARC archive of (url, block, 14-digit date); white space within a url is percent-encoded."""
    fields = ARC_FIELDS[version.encode()]
    head = f"{version} 0 tidemark\n{' '.join(fields)}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(head)}\n".encode(), head]
    for url, block, date in records:
        values = {"URL": "%20".join(url.split()) or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html"}
        values |= {"Result-code": "200", "Checksum": digest(block), "Location": "-", "Offset": "0", "Filename": name}
        values["Archive-length"] = str(len(block))
        out += [b"\n", " ".join(values[f] for f in fields).encode(), b"\n", block]
    return b"".join([*out, b"\n"])


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head (empty if there is none) and the payload of a block."""
    if block.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            head, found, body = block.partition(gap)
            if found:
                return head + found, body
    return b"", block


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return _CRLF.join([_CRLF.join(x.encode() for x in lines), b"", block, b"", b""])


def to_warc(record: dict, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record.

    The file's own description becomes ``warcinfo``, an HTTP answer ``response``, anything else ``resource``. With
    ``refers_to`` (identifier and name of an earlier record of the same payload) an answer becomes ``revisit``: it
    keeps its HTTP head, length and digest, but not the payload.
    """
    date = record["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    if record["URL"].startswith("filedesc://"):
        about = f"software: tidemark\r\nconversion-from: ARC/{record['version']}\r\n".encode()
        headers = [("WARC-Record-ID", record_id(record["URL"], stamp)), ("WARC-Date", stamp)]
        return warc_record("warcinfo", [*headers, ("Content-Type", "application/warc-fields")], about)
    head, payload = payload_of(record["block"])
    name = next((x[11:].strip() for x in head.decode("latin-1").split("\r\n") if x.lower().startswith("x-page-id:")), "")
    own = digest(payload)
    headers = [
        ("WARC-Record-ID", record_id(name, own)),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("Content-Type", "application/http; msgtype=response" if head else record["Content-type"]),
    ]
    if head and refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
        headers += [("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Name", refers_to[1])]
        return warc_record("revisit", headers, head)
    headers.append(("WARC-Block-Digest", f"sha1:{digest(record['block'])}"))
    return warc_record("response" if head else "resource", headers, record["block"])


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (names in lower case) and block of every whole record of a WARC file, by the declared lengths.

    A record without a numeric length, or whose length does not end before the next record or the end of the file (line breaks aside),
    is damaged and left out; reading goes on at the next version line.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "0")
        stop = end + 4 + int(size) if size.isdecimal() else len(data) + 1
        after = data[stop : stop + 16].lstrip(_CRLF)
        if stop > len(data) or after and not after.startswith(b"WARC/"):
            found = _BEGIN.search(data, at + 5)
            if not found:
                return
            at = found.start()
            continue
        yield headers, data[end + 4 : stop]
        at = stop


def write_archives(archives: DataFrame, column: str, path: str) -> None:
    """Write each row's bytes as one gzip file under ``path``; a record's last blank lines come from the writer."""
    text = archives.select(F.col(column).cast("string").alias("value"))  # the same bytes, as the text writer asks for
    text.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, kind: str = "warc") -> DataFrame:
    """``type, record_id, uri, date, payload_digest, refers_to, name, refers_to_name, payload_bytes, payload`` of each record.

    ``kind`` is the format of the files under ``path``, ``warc`` or ``arc``, plain or gzip; ARC records are converted
    first. A revisit has no payload; its length is the one that its HTTP head declares, null if that is no number. Damaged
    records and members are left out, as ``unpacked``, ``arc_records`` and ``warc_records`` say; they end no job.
    """
    names = "type record_id uri date payload_digest refers_to name refers_to_name".split()
    fields = [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType([*fields, T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = unpacked(batch.column(0)[k].as_py())
                if kind == "arc":
                    data = b"".join(map(to_warc, arc_records(data, strict=False)))
                rows = []
                for h, block in warc_records(data):
                    head, payload = payload_of(block)
                    http = dict(
                        (a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in head.decode("latin-1").split("\r\n"))
                    )
                    revisit = h.get("warc-type") == "revisit"
                    rows.append(
                        (
                            h.get("warc-type"),
                            h.get("warc-record-id"),
                            h.get("warc-target-uri"),
                            h.get("warc-date"),
                            (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                            h.get("warc-refers-to"),
                            http.get("x-page-id"),
                            h.get("warc-refers-to-name"),
                            (int(declared) if (declared := http.get("content-length", "0")).isdecimal() else None) if revisit else len(payload),
                            None if revisit else payload,
                        )
                    )
                columns = list(zip(*rows)) or [[]] * len(schema)
                types = [pa.string()] * 8 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert every ARC file under ``arc_path`` to a WARC file under ``warc_path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = b"".join(map(to_warc, arc_records(unpacked(batch.column(0)[k].as_py()), strict=False)))
                yield pa.RecordBatch.from_arrays([pa.array([made.removesuffix(_CRLF)], pa.binary())], names=["archive"])

    files = spark.read.format("binaryFile").load(arc_path).select("content")
    write_archives(files.mapInArrow(run, "archive binary"), "archive", warc_path)


def page_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = 8_000_000,
    date: str = "19960101000000",
) -> DataFrame:
    """``archive``: WARC archives of about ``archive_bytes`` with a record for each page, by way of ARC records.

    Pages become ARC archives, of version 1 and 2 in turn, which are then converted. Of pages with equal payloads of at
    least ``least_bytes`` bytes the one with the smallest id is a response and the others revisit it; a null id is the
    largest, and rows that repeat the smallest id are responses too. A null page has an empty payload, a null url is
    written as "-".
    """
    own = pages.select(
        F.col(id_col).cast("string").alias("_name"),
        F.col(id_col).alias("_key"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("-")).alias("_url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("_payload"),
    )
    own = own.withColumn("_sha", F.sha1("_payload")).withColumn("_size", F.length("_payload"))
    # what repeats is found without the payloads; a page then gets its target by its own id, so that no payload travels to
    # the place of its copies
    keys = cut(own.select("_key", "_sha", "_size").where(F.col("_size") >= least_bytes))
    first = keys.groupBy("_sha", "_size").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    first = cut(first.where("_n > 1 and _first is not null").select("_sha", "_size", "_first"))
    again = keys.join(first, ["_sha", "_size"]).where(~F.col("_key").eqNullSafe(F.col("_first"))).distinct().alias("t")
    same = F.col("o._key").eqNullSafe(F.col("t._key")) & (F.col("o._sha") == F.col("t._sha")) & (F.col("o._size") == F.col("t._size"))
    placed = own.alias("o").join(cut(again).alias("t"), same, "left")
    placed = placed.select("_name", "_url", "_payload", F.col("t._first").cast("string").alias("_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            arc = arc_archive(((url, block, date) for url, block, _ in rows), str(1 + made % 2), f"pages-{made}.arc")
            out = []
            for record, (_, _, to) in zip(arc_records(arc), [(None, None, None), *rows]):
                target = None
                if to is not None:
                    target = record_id(to, digest(payload_of(record["block"])[1])), to
                out.append(to_warc(record, target))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out).removesuffix(_CRLF)], pa.binary())], names=["archive"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name, url, payload, to in zip(*(c.to_pylist() for c in batch.columns)):
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += (f"X-Page-Id: {name}\r\n" if name is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                rows.append((url, head.encode() + payload, to))
                size += len(payload) + 600
                if size >= archive_bytes:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return placed.mapInArrow(run, "archive binary")


def round_trip(spark: SparkSession, pages: DataFrame, **settings) -> DataFrame:
    """Write the pages as WARC files to the shared folder and read the files back (see ``read_archives``)."""
    folder = ready(spark).sparkContext.getCheckpointDir()
    path = f"{folder}/warc-{uuid.uuid4().hex}"
    write_archives(page_archives(pages, **settings), "archive", path)
    return read_archives(spark, path).where("type != 'warcinfo'")
