"""Quartile bucket digests of documents, and a bounded difference score between them.

Every triplet of bytes within a sliding window is hashed to a bucket. The digest holds the length on a
logarithmic scale, how the quartiles of the bucket counts relate, and for each bucket the quartile it is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, n_partitions

BUCKETS = 512
#: Bytes of the sliding window, and the offsets of the second and third byte of each of its triplets that begin with its first byte:
#: those that do not begin there belong to a later window.
WINDOW = 5
TRIPLETS = tuple((i, j) for i in range(1, WINDOW - 1) for j in range(i + 1, WINDOW))
#: Bytes hashed at once; longer texts go in steps, so memory is bounded.
STEP = 1 << 20
#: Difference of two bucket quartiles; the ends are farther apart than their distance tells.
APART = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
HEAD_CAP = 64


def counts(text: bytes) -> np.ndarray:
    """How many byte triplets of ``text`` fall in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    reach = max(b for _, b in TRIPLETS)
    for at in range(0, max(1, len(text)), STEP):
        data = np.frombuffer(text[at : at + STEP + reach], np.uint8).astype(np.uint32)
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(STEP, len(data) - j)
            if n > 0:
                key = (data[:n] | data[i : i + n] << np.uint32(8) | data[j : j + n] << np.uint32(16)) + np.uint32(salt << 24)
                key ^= key >> np.uint32(15)
                key *= np.uint32(0x2C1B3C6D)
                key ^= key >> np.uint32(12)
                key *= np.uint32(0x297A2D39)
                total += np.bincount(key >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    return total


def digest(text: bytes) -> str:
    """The digest as hex: length byte, two quartile ratios, 2 bits a bucket. Empty texts have one too."""
    c = counts(text)
    q1, q2, q3 = (int(x) for x in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    length = min(255, round(8 * np.log2(1 + len(text))))
    ratios = (q1 * 15 // max(q3, 1)) << 4 | q2 * 15 // max(q3, 1)
    return bytes([length, ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> float:
    """0 for equal digests, at most 1: the share of the largest difference that is possible."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    body = sum(int(APART[(x[2:] >> s) & 3, (y[2:] >> s) & 3].sum()) for s in (0, 2, 4, 6))
    head = abs(int(x[0]) - int(y[0])) + abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    return (body + min(head, HEAD_CAP)) / (6 * BUCKETS + HEAD_CAP)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(t.as_py() or b"") for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


_EDIT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    k = len(text) // 3
    edited = (text[: len(text) - k] + following[:k]).encode()
    other = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, following_print)


def edited_comparison(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how alike they are.

    The next document is the one that follows in descending ``doc_id`` (null ids last, equal ids by text,
    nulls as empty); after the last comes the first. The texts are dealt by ranges of the id once. Inside a
    partition a row needs only the row after it; the ends of partitions, one text each, meet by an equi-join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n_partitions(spark), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = digest(text.encode())
                if held is None:
                    out.append((1, part, text, doc_id, None, None, own, None, None, None))
                else:
                    out.append((0, part, None, *_edited(*held, text, own)))
                held = doc_id, text, own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if held is not None:
            end = (2, part, held[1], held[0], None, None, held[2], None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(end, schema.types)], schema=schema)

    found = materialise(dealt.mapInArrow(run, "kind int, part int, text string, " + _EDIT), "digests")
    used = sorted(r[0] for r in found.where("kind = 1").select("part").collect())  # one number a partition
    after = dict(zip(used, used[1:] + used[:1]))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_edited(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types[3:])], names=schema.names[3:])

    follow = found.sparkSession.createDataFrame([(a, b) for a, b in after.items()] or [], "part int, goes_to int")
    first = found.where("kind = 1").select(F.col("part").alias("goes_to"), F.col("text").alias("text2"), F.col("fingerprint").alias("print2"))
    last = found.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(follow, "part").join(first, "goes_to")
    tail = last.select("doc_id", "text", "fingerprint", "text2", "print2").mapInArrow(ends, _EDIT)
    return found.where("kind = 0").drop("kind", "part", "text").unionByName(tail)
