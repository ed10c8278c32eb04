"""Mapping tables onto the catalog, one after another: each sees what those before it added."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..operators import catalog as C
from ..operators import decide, patch
from ..operators.profile import profile, stripped
from ..operators.small import kept, plain_plans
from ..sources import files
from ..sources.example import CATALOG, TABLES


@dataclass(frozen=True)
class Mapped:
    """What became of one table."""

    name: str
    subject: decide.Subject
    profile: DataFrame
    decisions: DataFrame
    questions: DataFrame
    ops: DataFrame
    errors: DataFrame
    log: DataFrame
    catalog: C.Catalog
    entities: DataFrame
    skipped: DataFrame
    n_cards: int


def map_table(
    name: str, index: int, table: DataFrame, catalog: C.Catalog, answers: DataFrame, budget: int = V.BUDGET, mode: str = "auto",
    proposer: decide.Proposer = decide.propose, audit: bool = False, rows: int = 3, row: str | None = None,
) -> Mapped:
    """Profile, decide, ask, change and project one table. A patch with any error changes nothing.

    Only the profile reads the table whole; what follows has the size of its header and of the catalog.
    """
    prof = kept(profile(table, row))
    with plain_plans(table.sparkSession):
        return _mapped(name, index, table, prof, catalog, answers, budget, mode, proposer, audit, rows, row)


def _mapped(
    name: str, index: int, table: DataFrame, prof: DataFrame, catalog: C.Catalog, answers: DataFrame, budget: int, mode: str,
    proposer: decide.Proposer, audit: bool, rows: int, row: str | None,
) -> Mapped:
    spark = table.sparkSession
    pairs = kept(C.near_duplicate_types(catalog))
    canonical = kept(C.canonical_types(catalog, pairs))
    cards = kept(C.cards(catalog, canonical=canonical))
    header = [c for c in table.columns if c != row]
    subject = decide.decide_subject(spark, name, header, cards)
    mapped = decide.with_budget(decide.gates(proposer(decide.with_candidates(prof, cards, subject.name), cards), cards), budget)
    mapped = kept(mapped)
    asked = kept(decide.questions(mapped, index))
    done = decide.resolve(mapped, asked, answers)
    junk = prof.where("junk is not null").select(F.col("name").alias("column"), "position", F.lit("exclude").alias("disposition"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("decided_by"), F.array(F.col("junk")).alias("gates_fired"))
    done = kept(done.unionByName(junk, allowMissingColumns=True))
    ops = patch.from_decisions(done)
    none = F.lit(None).cast("string")
    if subject.is_new:
        new = spark.range(1).select(F.lit(-1).alias("seq"), F.lit("add_type").alias("op"), F.lit(subject.name).alias("name"), F.lit(subject.confidence).alias("confidence"))
        ops = new.unionByName(ops, allowMissingColumns=True)
    if audit:
        ops = C.audit(catalog, pairs, canonical, cards).select((F.col("seq") - 1000).cast("int").alias("seq"), "op", "target", "issue", "severity").unionByName(ops, allowMissingColumns=True)
    flagged = done.where("flagged is not null").select((F.col("position") + 1000).cast("int").alias("seq"), F.lit("flag_ontology_issue").alias("op"), F.col("flagged").alias("target"), F.lit("a column was about to reuse this vacuous concept").alias("issue"), F.lit("warning").alias("severity"))
    ops = kept(ops.unionByName(flagged, allowMissingColumns=True).withColumn("description", F.coalesce("description", none)))
    errors = kept(patch.validate(ops, catalog))
    after, log = patch.apply(ops, catalog, mode if errors.isEmpty() else "none")
    after = C.Catalog(kept(after.types), kept(after.attributes), kept(after.relationships))
    cells = kept(first_cells(table, header, rows, row))
    entities = patch.project(cells, done, after, subject.name)
    skipped = patch.skipped(cells, done, after, subject.name)
    return Mapped(name, subject, prof, done, asked, ops, errors, log, after, entities, skipped, cards.count())


def first_cells(table: DataFrame, header: Sequence[str], rows: int, row: str | None = None) -> DataFrame:
    """``row, column, v`` of the first ``rows`` rows, numbered from 1; by ``row`` where given, else by their place in the table."""
    at = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    values = F.array(*(F.struct(F.lit(c).alias("column"), stripped(F.col(f"`{c}`")).alias("v")) for c in header))
    head = table.select(at.alias("at"), values.alias("cells"))
    head = (head.orderBy("at") if row else head).limit(rows)  # rows are numbered before their cells are spread
    numbered = head.select(F.row_number().over(Window.orderBy("at")).alias("row"), "cells")
    return numbered.select("row", F.explode("cells").alias("c")).select("row", "c.column", "c.v")


def run(spark: SparkSession, catalog: C.Catalog, tables: Sequence[tuple[str, DataFrame]], answers: DataFrame | None = None, budget: int = V.BUDGET, mode: str = "auto", proposer: decide.Proposer = decide.propose) -> list[Mapped]:
    """Map tables in order. What the audit finds in the catalog goes with the first table's changes."""
    answers = answers if answers is not None else files.read_answers(spark, None)
    out: list[Mapped] = []
    for i, (name, table) in enumerate(tables, 1):
        done = map_table(name, i, table, catalog, answers, budget, mode, proposer, audit=i == 1)
        out.append(done)
        catalog = done.catalog
    return out


def counters(runs: Sequence[Mapped]) -> DataFrame:
    """``table, reused, new, excluded, escalated`` (questions asked)."""
    out = None
    for i, m in enumerate(runs, 1):
        d = F.col("disposition")
        own = m.decisions.agg(F.lit(i).alias("seq"), F.lit(m.name).alias("table"), F.count_if(d == "reuse").alias("reused"), F.count_if(d.startswith("new_")).alias("new"), F.count_if(d == "exclude").alias("excluded"), F.count_if(F.col("id").isNotNull()).alias("escalated"))
        out = own if out is None else out.unionByName(own)
    return out


def example(spark: SparkSession, n: int = len(TABLES)) -> list[Mapped]:
    """The first ``n`` embedded tables onto the embedded catalog."""
    nested = spark.createDataFrame([(CATALOG,)], "value string").select(F.from_json("value", C.SCHEMA).alias("x")).select("x.*")
    tables = []
    for name, text in list(TABLES.items())[:n]:
        header, *rows = csv.reader(io.StringIO(text))
        tables.append((name, spark.createDataFrame([[v or None for v in r] for r in rows], ", ".join(f"`{h}` string" for h in header))))
    return run(spark, C.flatten(nested), tables)
