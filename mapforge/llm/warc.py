"""WARC archives: writing segmented records, and reading them back into whole payloads.

A block beyond ``segment_bytes`` is cut into a first record and ``continuation`` records. The reader groups
these by the origin's record id, orders them by segment number, verifies the total length and decodes the
chunked transfer framing. Archives are gzipped files that Spark's own writers put in any folder that Spark
can write, so a lost executor's half-written file is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, n_partitions, shared_dir

CRLF = b"\r\n"
SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
#: Records in one archive file, at most: the reader holds one compressed file at a time.
RECORDS_PER_FILE = 20_000
#: Up to so many groups of equal payloads are sent to all executors (60 bytes each); more are joined by key.
BROADCAST_GROUPS = 100_000
NAMESPACE = uuid.UUID(int=0x5D3B_A9C4_1F70_4E62_8C1D_2B6F_90E7_3A58)


class WarcError(ValueError):
    """An archive whose records contradict each other or their own lengths or digests."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name a response it has not seen."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(framed: bytes) -> bytes:
    """What chunked framing carries; chunk extensions and trailers are allowed and ignored."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            raise WarcError("a chunk has no size line")
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise WarcError("a chunk's size is no hexadecimal number") from None
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if framed[at : at + 2] != CRLF:
            raise WarcError("a chunk is shorter than its size")
        out.append(framed[end + 2 : at])
        at += 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, with the transfer framing removed."""
    head, cut, body = block.partition(CRLF + CRLF)
    if not cut:
        raise WarcError("the HTTP header does not end")
    for line in head.split(CRLF)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked":
            return dechunked(body)
    return body


def _record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """A record without the two line ends that close it; those are the archive writer's separator."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``refers_to`` is the page whose response a revisit points to."""
    digest = payload_digest(payload)
    own = record_id(page_id, digest)
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A") or "urn:none"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if is_revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", profile)], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        last = at + segment_bytes >= len(block)
        ident = own if n == 1 else f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own}/{n}')}>"
        part = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", ident)]
        part += common if n == 1 else [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", safe), ("WARC-Segment-Origin-ID", own)]
        part += [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if last else None)]
        yield _record(part, block[at : at + segment_bytes])


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Records of an uncompressed archive, given whole or in pieces: header fields (lower-case names) and block."""
    pieces = iter([data]) if isinstance(data, bytes) else data
    held, at = b"", 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        held, at = held[at:] + piece, 0
        return True

    while True:
        while (end := held.find(CRLF + CRLF, at)) < 0:
            if not more():
                if held[at:].strip():
                    raise WarcError("the last record's header does not end")
                return
        first, *lines = held[at:end].split(CRLF)
        if not first.startswith(b"WARC/"):
            raise WarcError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        try:
            size = int(fields[b"content-length"])
        except (KeyError, ValueError):
            raise WarcError("a record has no length") from None
        parts, need = [], end + 4 + size + 4 - at
        if len(held) - at < need:
            parts, got = [held[at:]], len(held) - at
            while got < need:
                piece = next(pieces, None)
                if piece is None:
                    raise WarcError("a record is shorter than its length")
                parts.append(piece)
                got += len(piece)
            held, end, at = b"".join(parts), end - at, 0
        block = held[end + 4 : end + 4 + size]
        if held[end + 4 + size : end + 8 + size] != CRLF + CRLF:
            raise WarcError("a record is not closed after its length")
        at = end + 8 + size
        yield fields, block


def _gunzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """One or more gzip members, in pieces."""
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(data, step)
            data = d.unconsumed_tail
            if piece:
                yield piece
            elif not data and not d.eof:
                raise WarcError("an archive ends inside its compressed stream")
        data = d.unused_data


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response and
    the others revisit it; a null html is an empty payload; a null page_id is written without the field,
    and such rows revisit others but are responses only where no id is known. Rows equal to the response
    in page_id as well are responses too.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.unhex(F.sha1(F.col("html").cast("binary")))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy(key.alias("digest")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    same = materialise(same.where("n > 1").drop("n"), "same-payload")
    if same.count() <= BROADCAST_GROUPS:
        same = F.broadcast(same)
    marked = rows.withColumn("digest", key).join(same, "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.octet_length("html") >= min_bytes)
    marked = marked.select("page_id", "url", "html", "top", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page_id, url, html, top, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                for r in records(page_id, url, html, top, again, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    found = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    found.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PARTS = "record string, page_id long, type string, refers_to string, digest string, segment int, total long, payload_bytes long, block binary"


def _parts(fields: dict[bytes, bytes], block: bytes) -> tuple | None:
    """A row for a response, revisit or continuation; whole responses are verified and let go of their block."""
    text = lambda k: fields[k].decode() if k in fields else None
    kind = text(b"warc-type")
    if kind not in ("response", "revisit", "continuation"):
        return None
    number = int(fields.get(b"warc-segment-number", b"0"))
    page = int(fields[b"page-id"]) if b"page-id" in fields else None
    digest = (text(b"warc-payload-digest") or "").removeprefix("sha1:")
    total = int(fields[b"warc-segment-total-length"]) if b"warc-segment-total-length" in fields else None
    if kind == "continuation":
        return text(b"warc-segment-origin-id"), None, kind, None, None, number, total, None, block
    if kind == "response" and not number:
        return text(b"warc-record-id"), page, kind, None, digest, 0, None, _verified(block, digest), None
    return text(b"warc-record-id"), page, kind, text(b"warc-refers-to"), digest, number, None, None, block if number else None


def _verified(block: bytes, digest: str) -> int:
    payload = http_payload(block)
    if digest and payload_digest(payload) != digest:
        raise WarcError("a payload does not match its digest")
    return len(payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits: ``record, page_id, type, refers_to`` (a record id)``, digest, payload_bytes``.

    Segments are dealt by their origin and sorted by number within a partition, where one pass joins them;
    a record's segments are all that a task holds at once. Missing segments, a wrong total length, broken
    framing and a wrong digest raise ``WarcError``. A revisit's length is null here.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _PARTS.split(", ")]
        for b in batches:
            for data in b.column(0):
                raw = data.as_py()
                out = []
                for fields, block in parse(_gunzipped(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    if (row := _parts(fields, block)) is not None:
                        out.append(row)
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "page_id", "type", "refers_to", "digest", "payload_bytes"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        held: list[tuple] = []

        def close() -> Iterator[tuple]:
            """All that was held has one origin and segment numbers; equal rows of a table may repeat a record."""
            firsts = [r for r in held if r[2] == "response"]
            whole = {r[5]: r for r in held}
            if not firsts or sorted(whole) != list(range(1, len(whole) + 1)):
                raise WarcError(f"segments of {held[0][0]} are missing")
            block = b"".join(whole[i][8] for i in sorted(whole))
            total = whole[len(whole)][6]
            if total != len(block):
                raise WarcError(f"the segments of {held[0][0]} have {len(block)} bytes, not {total}")
            size = _verified(block, firsts[0][4])
            for r in firsts:
                yield r[0], r[1], r[2], r[3], r[4], size
            held.clear()

        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and (r[0] != held[0][0] or not r[5]):
                    out += close()
                if r[5]:
                    held.append(r)
                else:
                    out.append((*r[:5], r[7]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if held and (out := list(close())):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    dealt = files.mapInArrow(cut, _PARTS).repartition(n_partitions(spark), "record").sortWithinPartitions("record", "segment")
    return dealt.mapInArrow(join, "record string, page_id long, type string, refers_to string, digest string, payload_bytes long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and resolve revisits.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. An empty table gives none.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/mapforge/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    found = materialise(read_archives(spark, path), "records")
    whole = found.where("type = 'response'")
    target = whole.groupBy("record").agg(F.first("page_id").alias("to_page"), F.first("payload_bytes").alias("to_bytes"))
    again = found.where("type = 'revisit'").drop("record", "payload_bytes").join(target.withColumnRenamed("record", "refers_to"), "refers_to", "left")
    cols = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    return whole.select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.withColumnRenamed("to_bytes", "payload_bytes").select(*cols, F.col("to_page").alias("refers_to"))
    )
