"""SimHash fingerprints and their near-duplicate groups, with pigeonring candidate filtering."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, materialise, quoted

BITS, SHINGLE, SEED = 64, 3, 42
#: Words handled at once, so that one very long text needs bounded memory.
STEP = 1 << 16
#: Rows of ids and hashes (16 bytes each) that are sent to all executors at most; more are joined by key.
BROADCAST_NODES = 500_000


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of UTF-8 ``text``, as a signed integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(BITS, np.int64)
    for at in range(0, max(1, len(words) - width + 1), STEP):
        part = words[at : at + STEP + width - 1]
        if len(words) >= width:
            rows = zip(*(part[i : len(part) - width + 1 + i] for i in range(width)))
            hashes = [digest(s, SEED) for s in map(b" ".join, rows)]
        else:
            hashes = [digest(b" ".join(words), SEED)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row; a null or blank text gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py(), width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _fingerprints_by_text(docs: DataFrame) -> DataFrame:
    """``doc_id, th, fp``, where ``th`` tells texts of the same id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _spans(segments: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _mask(span: tuple[int, int]) -> Column:
    value = ((1 << (span[1] - span[0])) - 1) << span[0]
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs ``a < b`` of distinct values of ``fp`` at most ``max_bits`` apart.

    The 64 bits form a ring of ``max_bits + 1`` segments. By the pigeonring principle every such pair has
    a segment from which, for each chain of consecutive segments, the differences add up to at most
    (chain length) * max_bits / segments. The chain of one must therefore agree exactly, which is an
    equi-join; the longer chains prune what it finds before the whole distance is taken.
    """
    m = max_bits + 1
    spans = _spans(m)
    seg = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_mask(s)).alias("key")) for i, s in enumerate(spans)))
    keyed = fps.select("fp").distinct().select("fp", F.explode(seg).alias("s")).select("fp", "s.i", "s.key")
    left, right = keyed.select("i", "key", F.col("fp").alias("a")), keyed.select("i", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    apart = [F.bit_count(diff.bitwiseAND(_mask(s))) for s in spans]
    ring = F.lit(False)
    for start in range(m):
        ok = F.col("i") == start
        for length in range(2, m + 1):
            chain = sum((apart[(start + k) % m] for k in range(1, length)), apart[start])
            ok &= chain * m <= length * max_bits
        ring |= ok
    pairs = left.join(right, ["i", "key"]).where(F.col("a") < F.col("b")).where(ring)
    return pairs.where(F.bit_count(diff) <= max_bits).select("a", "b").distinct()


def groups(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fps(doc_id, fp)`` with ``component_id``, the least doc_id that links lead to (itself included).

    Equal fingerprints are one node, so copies are never expanded into pairs. A null doc_id takes part
    in linking but is never the least; a group of null ids alone has a null component_id.
    """
    return _placed(materialise(fps, "fingerprints"), max_bits)[0]


def _placed(fps: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``groups`` of a stored table, and ``fp, root`` of its distinct fingerprints."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp"), placed.select("fp", "root")


def keep_one(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """One row of each near-duplicate group: that of the least doc_id (nulls last, then by a hash of the text).

    Columns of ``docs`` are kept as they are. Of equal rows one stays; an empty table stays empty.
    """
    fps = materialise(_fingerprints_by_text(docs), "fingerprints")
    _, roots = _placed(fps, max_bits)
    return keep_first(docs, first_of(fps.join(roots, "fp")))


def first_of(rooted: DataFrame) -> DataFrame:
    """``doc_id, th`` of the least (doc_id, ``th``) of each root of ``rooted(doc_id, th, root)``, null ids last."""
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    return first.select("first.doc_id", "first.th")


def keep_first(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first(doc_id, th)`` names.

    Of rows equal in id and text the one with the least hash of all columns stays. Names of columns do not matter. Texts are not
    shuffled to find out: what goes and what is repeated is settled by ids and hashes, and is less than what stays. Only where that is
    more than can be sent to all executors, rows meet it by key.
    """
    tag = uuid.uuid4().hex
    own_id, own_th, place, id_, th = (f"{c}_{tag}" for c in ("own_id", "own_th", "place", "id", "th"))
    own = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    keys = own.groupBy(F.col(own_id).alias(id_), F.col(own_th).alias(th)).agg(F.count("*").alias("n"))
    named = keys.join(first.select("doc_id", F.col("th").alias("stays")), F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(th) == F.col("stays")), "left")
    odd = materialise(named.where("stays is null or n > 1").select(id_, th, F.col("stays").isNotNull().alias("stays")), "odd")
    twice = odd.where("stays").select(id_, th)
    few = F.broadcast if odd.count() <= BROADCAST_NODES else lambda df: df
    same = F.col(own_id).eqNullSafe(F.col(id_)) & (F.col(own_th) == F.col(th))
    columns = [F.col(quoted(c)) for c in docs.columns]
    out = own.join(few(odd.select(id_, th)), same, "left_anti").select(*columns)
    if twice.isEmpty():
        return out
    once = Window.partitionBy(own_id, own_th).orderBy(F.xxhash64(*columns))
    return out.union(own.join(few(twice), same, "left_semi").withColumn(place, F.row_number().over(once)).where(F.col(place) == 1).select(*columns))


def near_duplicates(docs: DataFrame, max_bits: int = 2, width: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Null and blank texts have fingerprint zero and link like any other; repeated rows are kept as rows.
    """
    out = groups(fingerprints(docs, width=width), max_bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
