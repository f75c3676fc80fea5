"""Web pages as WARC archives, written and read back by Spark.

``write`` makes one record per page: a response with its chunked HTTP body, or a revisit of a
page with the same payload. A record block longer than ``segment`` bytes is cut into
continuation records that carry the first one's id, their number and, on the last, the total
length. Files are written by Spark's text writer (a record ends with a line feed of its own
format, bytes pass through as they are) and gzipped; a task's records make one file or more.

``read`` parses archives as streams of lines, counting bytes by Content-Length, so no file is
held whole and no mark inside a payload is taken for a record. Whole records are decoded where
they are read. Segments are grouped by origin, ordered by number, checked against the total
length and for gaps, joined, and decoded: header block, chunked framing, digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveops.session import written

#: Bytes of a segment's block, of a chunk of the body, and the least payload that is deduplicated.
SEGMENT, CHUNK, LEAST = 1 << 15, 1 << 13, 1000
FILE_RECORDS = 100_000
_END = b"\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x" % len(part), _END, part, _END]
    return b"".join([*parts, b"0", _END, _END])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body with any extensions and trailers; None if it is malformed."""
    parts, at = [], 0
    while True:
        end = body.find(_END, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size < 0:
            return None
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != _END:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n%s\r\n%s\r\n" % (lines.encode(), block)


def _clean(url: str | None) -> str | None:
    """A header value on one line."""
    return None if url is None else "".join(c if ord(c) >= 32 else "%%%02X" % ord(c) for c in url)


def page_records(page: dict, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: page_id, url, payload, digest, refers_to (null: a response)."""
    name = f"<urn:uuid:{page['record']}>"
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    revisit = page["refers_to"] is not None
    if revisit:
        block = b"%sContent-Length: %d\r\n\r\n" % (status, page["size"])
    else:
        block = b"%sTransfer-Encoding: chunked\r\n\r\n%s" % (status, chunked(page["payload"], chunk))
    common = [
        ("WARC-Target-URI", _clean(page["url"])),
        ("WARC-Payload-Digest", f"sha1:{page['digest']}"),
        ("WARC-Page-ID", page["page_id"]),
        ("WARC-Refers-To-Page-ID", page["refers_to"]),
    ]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    for number, piece in enumerate(pieces, 1):
        first, last = number == 1, number == len(pieces)
        yield _record(
            [
                ("WARC-Type", ("revisit" if revisit else "response") if first else "continuation"),
                ("WARC-Record-ID", name if first else f"<urn:uuid:{page['record']}-{number}>"),
                *(common if first else [("WARC-Segment-Origin-ID", name)]),
                ("WARC-Segment-Number", number if len(pieces) > 1 else None),
                ("WARC-Segment-Total-Length", len(block) if last and not first else None),
                ("Content-Type", "application/http; msgtype=response" if first else None),
                ("Content-Length", len(piece)),
            ],
            piece,
        )


def write(
    pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST
) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``; a null html is an empty payload.

    Of payloads that are equal and have ``least`` bytes or more, the page with the largest page_id
    is the response and the others revisit it. Rows that repeat the page_id of the response are
    responses too; a null page_id is least.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
    )
    # Equal digests and sizes are equal payloads.
    origin = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max("page_id").alias("_origin"), F.count("*").alias("_n")
    ).where("_n > 1").drop("_n")
    joined = rows.join(origin, ["digest", "size"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_origin")), F.col("_origin"))
    joined = joined.select(
        "page_id", "url", "size", "digest", refers.alias("refers_to"),
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                page = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                # Equal again if the task is run again, and different for rows that repeat.
                page["record"] = uuid.uuid5(_NAMES, f"{part}/{count}/{page['page_id']}/{page['digest']}")
                count += 1
                for record in page_records(page, segment, chunk):
                    out.append(record)
                    held += len(record)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


class Parser:
    """Records from the lines of one archive after another; a record is held, never a file."""

    def __init__(self):
        self.file = None
        self._reset()

    def _reset(self):
        self.headers: dict[str, str] | None = None
        self.block: bytearray | None = None
        self.size = 0

    def feed(self, file: str, line: bytes) -> tuple[dict[str, str], bytes | None] | None:
        """A finished record (headers, block), if ``line`` (without its end) closes one.

        The block is None if the file ends before Content-Length.
        """
        broken = None
        if file != self.file:
            broken = self.finish()
            self.file = file
        if self.block is not None:
            self.block += line
            self.block += _END
            # The block is followed by a line end of its own.
            if len(self.block) >= self.size + 2:
                headers, block = self.headers, bytes(self.block[: self.size])
                self._reset()
                return headers, block
        elif self.headers is None:
            if line.startswith(b"WARC/"):
                self.headers = {}
        elif line:
            name, _, value = line.partition(b":")
            self.headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        else:
            self.size = int(self.headers.get("content-length", 0))
            self.block = bytearray()
        return broken

    def finish(self) -> tuple[dict[str, str], None] | None:
        headers, open_ = self.headers, self.headers is not None
        self._reset()
        return (headers, None) if open_ else None


def payload_of(block: bytes) -> tuple[bytes | None, int | None]:
    """The payload of an HTTP response block, decoded, and its Content-Length header."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, None
    fields = {}
    for line in head.split(_END)[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().lower()
    length = fields.get(b"content-length")
    length = int(length) if length and length.isdigit() else None
    if fields.get(b"transfer-encoding") == b"chunked":
        return unchunked(body), length
    return body, length


_DECODED = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, problem string"
)
_PARSED = (
    f"{_DECODED}, origin string, number int, total long, block binary"
)


def _decoded(headers: dict, block: bytes | None, problem: str | None, keep: bool) -> dict:
    """A page's row from its whole block."""
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None

    def number(name):
        text = headers.get(name)
        return int(text) if text not in (None, "None") else None

    payload, size = None, None
    if block is not None and not problem:
        payload, size = payload_of(block)
        if kind == "revisit":
            payload = None
        elif payload is None:
            problem = "malformed body"
        else:
            size = len(payload)
            made = hashlib.sha1(payload).hexdigest()
            if digest and made != digest:
                problem = "digest differs"
            digest = made
    return {
        "page_id": number("warc-page-id"), "url": headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": number("warc-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if keep else None, "problem": problem,
    }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("problem", pa.string()),
])
_PART = pa.schema([
    *_ROW, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page in the archives under ``path``.

    page_id, url, record_type (response or revisit), refers_to, payload_bytes, payload_digest,
    payload (null for revisits, or without ``payloads``) and problem: null, or why a record is
    not whole (``truncated``, ``segment missing``, ``segments differ``, ``length differs``, ``malformed body``,
    ``digest differs``). Records of other types and continuations without a first are left out.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out, held = Parser(), [], 0

        def take(record):
            nonlocal held
            headers, block = record
            kind = headers.get("warc-type")
            if kind not in ("response", "revisit", "continuation"):
                return
            if "warc-segment-number" in headers:
                first = kind != "continuation"
                row = _decoded(headers, None, None, payloads) if first else {}
                row |= {
                    "origin": headers["warc-record-id" if first else "warc-segment-origin-id"],
                    "number": int(headers["warc-segment-number"]), "block": block,
                    "total": int(headers["warc-segment-total-length"])
                    if "warc-segment-total-length" in headers else None,
                }
            else:
                row = _decoded(headers, block, "truncated" if block is None else None, payloads)
            out.append(row)
            held += 200 + len(row.get("block") or b"") + len(row.get("payload") or b"")

        for batch in batches:
            files = batch.column("file").dictionary_encode()
            names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
            for code, line in zip(codes, batch.column("line").to_pylist(), strict=True):
                if record := parser.feed(names[code], line):
                    take(record)
                    if held > 4 << 20:
                        yield _batch(out, _PART)
                        out, held = [], 0
        if record := parser.finish():
            take(record)
        yield _batch(out, _PART)

    # Gzipped files are read from end to end by one task; their rows keep their order.
    parsed = written(lines.mapInArrow(run, _PARSED))
    part = F.struct("number", "total", "block")
    kept = [f.name for f in _ROW if f.name not in ("payload_bytes", "payload", "problem")]
    segments = (
        parsed.where("origin IS NOT NULL").groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(part)).alias("parts"),
            *[F.first(c, True).alias(c) for c in kept],
        )
        # Without a first segment there is no page.
        .where("record_type IS NOT NULL")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in kept}
                block, problem = joined(batch.column("parts")[i].as_py())
                headers = {
                    "warc-type": row["record_type"], "warc-target-uri": row["url"],
                    "warc-payload-digest": row["payload_digest"] or "",
                    "warc-page-id": row["page_id"], "warc-refers-to-page-id": row["refers_to"],
                }
                yield _batch([_decoded(headers, block, problem, payloads)], _ROW)

    whole = parsed.where("origin IS NULL").select(_ROW.names)
    return whole.union(segments.mapInArrow(join, _DECODED))


def joined(parts: list[dict]) -> tuple[bytes | None, str | None]:
    """The block of segments (number, total, block) in order, or what is wrong with them."""
    by_number = {}
    for part in parts:
        if part["block"] is None:
            return None, "truncated"
        # The same segment may be archived more than once.
        if by_number.setdefault(part["number"], part["block"]) != part["block"]:
            return None, "segments differ"
    totals = {part["total"] for part in parts if part["total"] is not None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or not totals:
        return None, "segment missing"
    block = b"".join(by_number[n] for n in sorted(by_number))
    if totals != {len(block)}:
        return None, "length differs"
    return block, None
