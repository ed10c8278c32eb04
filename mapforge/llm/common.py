"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Ids are compared in Python as 64-bit integers; a null id counts as larger than any other.
NULL_ID = (1 << 63) - 1

#: The words of every contract: runs of anything but the six ASCII white-space characters.
#: ``bytes.split()`` splits on exactly these six, so Python code uses that on UTF-8.
WORD_SPLIT = r"[ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='mapforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The shuffle files that led to it are dropped once it is written: nothing refers to them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mapforge/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open:
        _open[-1].append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored in here are deleted at its end, but for those handed to what it yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        discard(*(df for df in made if not any(df is k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` has stored and that nothing reads any more."""
    for df in stored:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name such that dots and the like in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def give_back() -> None:
    """Return what a worker no longer uses to the system: it stays alive, idle, beside the tasks of later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: ``(node, root)``, root the least node; isolated nodes are not listed.

    Alternates large-star and small-star steps until the links no longer change. Every step is a keyed
    aggregation and an equi-join whose hot keys adaptive execution splits; each round's links are
    written to the shared folder, so that the lineage stays short and a lost executor costs one round.
    Null ends and self-links are ignored.
    """
    with scratch() as keep:
        return _stars(links, max_rounds, keep)


def _stars(links: DataFrame, max_rounds: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    edges = keep(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
