"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and stores the measurements and a mask of the rules that failed;
``apply_policy`` reads a versioned policy (a mask) off the ledger; ``ablation`` tells what each rule alone
rejects, from a bitwise aggregation over the ledger. No rule is evaluated again for another policy.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, quoted

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_alpha_words", "n_upper_words", "n_dup_line_bytes", "n_bytes")

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in that is was for with as on it by be are this from or at not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "le la les de des et un une en que qui dans du est pour par sur au "
    "el los las del y en un una que con por para se no su es al".encode().split()
)


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; it is true where a document fails."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "mean_word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
    Rule(4, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 1"),
    Rule(5, "duplicate_line_bytes", "10 * n_dup_line_bytes > 2 * n_bytes"),
    Rule(6, "few_alphabetic_words", "100 * n_alpha_words < 70 * n_words"),
    Rule(7, "shouting", "100 * n_upper_words > 30 * n_words"),
    Rule(8, "no_function_words", "n_stop < 2"),
)
BASE = 0b11
#: Versioned policies: a document is rejected where its mask meets the policy's.
POLICIES = {"v1": 0b000000011, "v2": 0b111111111}


def _repeat_words(words: list[bytes]) -> int:
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    ids = np.fromiter((put(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique((ids[:-1] << 31) | ids[1:], return_inverse=True)
        keys = (pair[:-1].astype(np.int64) << 31) | ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + n] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``; all 0 for null."""
    text = text or b""
    words = text.split()
    if not words:
        return (0,) * (len(MEASURES) - 1) + (len(text),)
    n_cont = len(text.translate(None, _NOT_CONTINUATION))
    n_space = len(text) - len(text.translate(None, b" \t\n\r\x0b\x0c"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    distinct = set(lines)
    dup_bytes = sum(map(len, lines)) - sum(map(len, distinct)) if len(distinct) < len(lines) else 0
    alpha = sum(map(bytes.isalpha, text.translate(_AS_LETTERS, b".,;:!?'\"()-").split()))
    upper = sum(map(bytes.isupper, words))
    stop = sum(map(STOP_WORDS.__contains__, text.lower().split()))
    return (
        len(words), len(text) - n_cont - n_space, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(distinct),
        _repeat_words(words), len(lines), stop, alpha, upper, dup_bytes, len(text),
    )


_NOT_CONTINUATION = bytes(i for i in range(256) if not 0x80 <= i < 0xC0)
#: Bytes of letters beyond ASCII count as letters.
_AS_LETTERS = bytes(i if i < 128 else ord("a") for i in range(256))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py()) for t in b.column(1).cast(pa.large_binary())], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["doc_id", *MEASURES])

            del b, rows
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_bits(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The mask of failed rules as one column; each rule is evaluated once. ``prefix`` is that of the measurements' names."""
    name = lambda sql: re.sub("|".join(rf"\b{m}\b" for m in MEASURES), lambda m: prefix + m[0], sql)
    return sum((F.when(F.expr(name(r.failed)), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules), F.lit(0)).cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed_bits`` for every row of ``docs``.

    A null text counts as empty; a null id is carried along; repeated rows give repeated entries; an
    empty table gives an empty ledger. Other columns of ``docs`` are not read.
    """
    return measurements(docs, id_col, text_col).withColumn("failed_bits", failure_bits(rules))


def apply_policy(entries: DataFrame, version: str = "v2") -> DataFrame:
    """``kept`` under a policy, from the stored bits alone."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def keep(docs: DataFrame, version: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns, in one pass and without a shuffle."""
    tag = f"m{uuid.uuid4().hex[:8]}_"
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py()) for t in b.column(at).cast(pa.large_binary())], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*names, *(tag + m for m in MEASURES)])

            del b, rows
            give_back()

    schema = T.StructType([*docs.schema.fields, *(T.StructField(tag + m, T.LongType()) for m in MEASURES)])
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)  # which can't pass on names with dots
    return out.where(failure_bits(rules, tag).bitwiseAND(F.lit(POLICIES[version])) == 0).select(*(F.col(quoted(c)) for c in docs.columns))


def ablation(entries: DataFrame, version: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: how many documents fail it, and how many would come back without it.

    The ledger is first counted by mask (at most 2^rules rows), so the rules' rows never grow with the input.
    """
    mask = POLICIES[version]
    by_mask = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    use = [r for r in rules if mask >> r.bit & 1]
    bits = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in use)))
    hit = by_mask.select("m", "n", bits.alias("r")).select("n", "m", "r.rule", "r.bit")
    return hit.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def judged(docs: DataFrame, version: str = "v2") -> DataFrame:
    """One row per document: the contract's columns, then what the stored ledger tells.

    The ledger is written once; the policy, the older one (``kept_v1``) and the ablation are read off it. Where a single rule rejects
    a document under the policy, ``sole_rule`` names it and ``n_sole`` is how many documents would come back without it.
    Very long texts are one row's work; repeated rows are judged alike.
    """
    entries = materialise(ledger(docs), "ledger")
    sole = ablation(entries, version).select(F.col("bit").alias("sole_bit"), F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))
    out = apply_policy(entries, version).withColumn("kept_v1", F.col("failed_bits").bitwiseAND(F.lit(POLICIES["v1"])) == 0)
    out = out.join(F.broadcast(sole), F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == F.col("sole_bit"), "left")  # a row a rule
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0
    return out.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits", "kept_v1", "sole_rule", "n_sole")
