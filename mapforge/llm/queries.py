"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, katz, lines, mixing, rules, simhash, sql, subtrees, suffix_runs, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_comparison(table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_front_coded_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.summary(suffix_runs.remove_repeats(table(spark, sf_dir, "documents")))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.fit_and_score(table(spark, sf_dir, "documents"))


def op7_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(table(spark, sf_dir, "documents"), least_words=1)


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_prefix_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtrees.summary(subtrees.remove_repeats(table(spark, sf_dir, "documents")))


def op10_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_bucket_digest,
            op2_warc_segments,
            op3_front_coded_suffix_runs,
            op4_soft_mixing,
            op5_rule_ledger,
            op6_katz_backoff,
            op7_line_similarity_join,
            op8_segment_tree_bpe,
            op9_prefix_subtrees,
            op10_pigeonring_simhash,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
