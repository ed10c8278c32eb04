"""Runs: bounded packs of documents whose keys are dealt out, and answered by run.

A run holds consecutive documents of one input partition, some megabytes of text, as one compressed row. What
is computed over a corpus then goes through three kinds of steps: a run scatters sorted, compressed keys to
parts (ranges of a hash); a part gathers what all runs sent and answers each of them; a run takes the answers
and goes on. A key that is frequent in the corpus occurs once a run, not once an occurrence. The packed runs
are dealt by run id once, and every later step over texts reuses that exchange. Whatever a run or a part is
handed when it is computed again after a loss is the same, because ids derive from the input's partitions.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, n_partitions

#: Bytes of text in a run.
RUN_BYTES = 4 << 20
#: Bytes of text in a row of a run: large rows make the JVM's heap grow.
PIECE_BYTES = 1 << 18

SENT = "part long, run long, payload binary"
ANSWER = "run long, part long, payload binary"
Rows = Iterable[tuple[int, bytes]]


def deflate(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def inflate(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, in as many bytes as the largest needs, byte by byte of all of them."""
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)
    raw = np.ascontiguousarray(values.astype(kind))
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return raw.itemsize.to_bytes(1, "little") + np.ascontiguousarray(planes).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint64)


def join_blobs(*parts: bytes) -> bytes:
    """Several byte strings as one compressed string."""
    head = b"".join(len(p).to_bytes(8, "little") for p in parts)
    return deflate(len(parts).to_bytes(1, "little") + head + b"".join(parts))


def split_blobs(data: bytes) -> list[bytes]:
    raw = inflate(data)
    n, at, out = raw[0], 1 + 8 * raw[0], []
    for i in range(n):
        size = int.from_bytes(raw[1 + 8 * i : 9 + 8 * i], "little")
        out.append(raw[at : at + size])
        at += size
    return out


def pack_documents(ids: list[int | None], texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def documents(pieces: list[bytes]) -> tuple[np.ndarray, list[int | None], list[bytes]]:
    """Ids with null as ``NULL_ID``, ids as they were, and texts."""
    ids, texts = [], []
    for p in pieces:
        t = pa.ipc.open_stream(p).read_all()
        ids += t.column(0).to_pylist()
        texts += t.column(1).to_pylist()
    return np.array([NULL_ID if i is None else i for i in ids], np.int64), ids, texts


def _packs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of the rows (id, text) of this task, each in pieces that are small enough to be rows."""
    run = TaskContext.get().partitionId() << 32
    ids, texts, size, pieces, whole = [], [], 0, [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
            raw = t.as_py() or b""
            ids.append(i)
            texts.append(raw)
            size += len(raw) + 16
            if size >= PIECE_BYTES:
                pieces.append(pack_documents(ids, texts))
                ids, texts, size, whole = [], [], 0, whole + size
            if whole + size >= run_bytes:
                yield run, [*pieces, pack_documents(ids, texts)]
                ids, texts, size, pieces, whole, run = [], [], 0, [], 0, run + 1
    if ids or pieces:
        yield run, [*pieces, pack_documents(ids, texts)]


class Runs:
    """The packed runs of ``docs(doc_id, text)``; a null text counts as empty."""

    def __init__(self, docs: DataFrame, run_bytes: int = RUN_BYTES, spread: int = 2) -> None:
        """``spread``: parts for each shuffle partition; more make a part smaller."""
        self.parts, self.run_bytes = spread * n_partitions(docs.sparkSession), run_bytes
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run, pieces in _packs(batches, run_bytes):
                for n, p in enumerate(pieces):
                    yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([n], pa.int64()), pa.array([p], pa.binary())], ["run", "piece", "blob"])

        self.packed = self.rows.mapInArrow(pack, "run long, piece long, blob binary")

    def scatter_in_place(self, fn: Callable[[list[bytes]], Rows]) -> DataFrame:
        """``fn(pieces)`` gives (part, payload); one row for each. Where texts are read, without dealing them out."""
        run_bytes = self.run_bytes

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run, pieces in _packs(batches, run_bytes):
                yield from _sent(run, fn(pieces)).to_batches()

        return self.rows.mapInArrow(each, SENT)

    def scatter(self, fn: Callable[[list[bytes]], Rows]) -> DataFrame:
        """As ``scatter_in_place``, from the exchange of texts that later steps use as well."""

        def each(table: pa.Table) -> pa.Table:
            return _sent(table.column(0)[0].as_py(), fn(_pieces(table)))

        return self.packed.groupBy("run").applyInArrow(each, SENT)

    def scatter_with(self, answers: DataFrame, fn: Callable[[list[bytes], dict[int, bytes]], Rows]) -> DataFrame:
        """As ``scatter``, with the run's answers by part."""

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _sent(0, ())
            return _sent(left.column(0)[0].as_py(), fn(_pieces(left), _answers(right)))

        return self.packed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(each, SENT)

    def finish(self, answers: DataFrame, fn: Callable[[list[bytes], dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
        """Rows for each run's documents from the run and its answers."""

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            out = fn(_pieces(left), _answers(right))
            _trim()
            return out

        return self.packed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(each, schema)


def _trim() -> None:
    """Give memory that a finished group has used back to the system, as idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _pieces(table: pa.Table) -> list[bytes]:
    return [p for _, p in sorted(zip(table.column(1).to_pylist(), table.column(2).to_pylist()))]


def gather(sent: DataFrame, fn: Callable[[int, list[int], list[bytes]], Rows]) -> DataFrame:
    """``fn(part, runs, payloads)`` gives (run, payload) answers of a part. Runs come in ascending order."""

    def each(table: pa.Table) -> pa.Table:
        part = table.column(0)[0].as_py()
        rows = sorted(zip(table.column(1).to_pylist(), table.column(2).to_pylist()))
        out = list(fn(part, [r for r, _ in rows], [p for _, p in rows]))
        _trim()
        return pa.table({"run": pa.array([r for r, _ in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return sent.groupBy("part").applyInArrow(each, ANSWER)


def _sent(run: int, rows: Rows) -> pa.Table:
    rows = list(rows)
    _trim()
    return pa.table({"part": pa.array([p for p, _ in rows], pa.int64()), "run": pa.array([run] * len(rows), pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column(1).to_pylist(), table.column(2).to_pylist()))


def cuts(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the parts' ranges begin in ascending ``keys`` below ``1 << bits``; ``parts + 1`` positions."""
    edges = np.array([(p << bits) // parts for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)
