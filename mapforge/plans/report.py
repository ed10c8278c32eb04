"""What became of mapped tables, as a Markdown text for each and one summary of a run."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.patch import described
from .mapping import Mapped, counters

COUNTED = ("columns", "reused", "new", "excluded", "escalated")


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _column_row() -> Column:
    gates = F.when(F.size("gates_fired") > 0, F.array_join("gates_fired", ", "))
    asked = F.when(F.coalesce("downgraded", F.lit(False)), "yes (downgraded)").otherwise("False")
    cells = [F.col("column"), _said(F.col("disposition")), _said(F.col("target")), _said(F.round("confidence", 4)), _said(F.col("decided_by")), _said(gates), asked]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _candidate_lines() -> Column:
    four = lambda c, name: F.concat(F.lit(f"{name}="), F.round(c[name], 4).cast("string"))
    twin = lambda c: F.when(c["aliased_from"].isNotNull(), F.lit("aliased_from_twin=1.0"))
    signals = lambda c: F.concat_ws(", ", *(four(c, n) for n in ("bm25", "embedding", "datatype_prior", "shape_prior")), twin(c))
    each = F.transform("candidates", lambda c: F.concat(F.lit("- `"), c["doc_id"], F.lit("` "), four(c, "score"), F.lit(" ("), signals(c), F.lit(")")))
    return F.concat(F.lit("<details><summary>"), F.col("column"), F.lit(" — retrieval candidates</summary>\n\n"), F.array_join(each, "\n"), F.lit("\n\n</details>"))


def markdown(m: Mapped, row_count: int) -> DataFrame:
    """One row ``value``: the report of a table, its columns in the order of the header.

    Columns without candidates, such as junk, have no list of them.
    """
    d = m.decisions
    listed = F.when(F.size(F.coalesce("candidates", F.expr("array()"))) > 0, _candidate_lines())
    parts = d.agg(F.array_sort(F.collect_list(F.struct("position", _column_row().alias("row"), listed.alias("list")))).alias("x"))
    state = "new" if m.subject.is_new else "reused"
    head = f"# Mapping report — {m.name}\n\nRow count: {row_count}\n\n## Subject type: `{m.subject.name}` ({state})\n- confidence: {m.subject.confidence}\n\n## Columns\n\n| column | disposition | target | confidence | decided_by | gates_fired | escalated |\n|---|---|---|---|---|---|---|\n"
    rows, lists = F.array_join(F.transform("x", lambda p: p["row"]), "\n"), F.array_join(F.transform("x", lambda p: p["list"]), "\n\n")
    return parts.select(F.concat(F.lit(head), rows, F.lit("\n\n"), lists, F.lit("\n")).alias("value"))


def transcript(m: Mapped) -> DataFrame:
    """Lines ``value`` of what was done to a table, in order: columns, questions with their answers, ops, counts."""
    line = lambda df, step, at, c: df.select(F.lit(step).alias("s"), at.cast("long").alias("at"), c.alias("value"))
    state = "new" if m.subject.is_new else "reused"
    none = F.lit(0)
    head = m.decisions.sparkSession.range(1)
    decided = F.concat(F.lit("column "), "column", F.lit(": "), "disposition", F.lit(" "), F.coalesce("target", "new_name", F.lit("-")), F.lit(" confidence="), F.coalesce(F.format_string("%.2f", "confidence"), F.lit("-")), F.lit(" gates="), F.array_join(F.coalesce("gates_fired", F.expr("cast(array() as array<string>)")), ","))
    said = m.decisions.where("id is not null").select(F.col("id").alias("q"), "answer", "source")
    asked = m.questions.join(said, F.col("id") == F.col("q"))
    counted = counters([m]).select(F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), c) for c in COUNTED[1:])).alias("n"))
    steps = [
        line(head, 0, none, F.lit(f"== {m.name}: {m.subject.name} ({state})")),
        line(m.decisions, 1, F.col("position"), decided),
        line(asked, 2, F.substring_index("id", "q", -1), F.concat(F.lit("question "), "id", F.lit(": "), "question", F.lit(" Why: "), "why", F.lit(" Answer ("), "source", F.lit("): "), "answer")),
        line(m.ops, 3, F.col("seq"), F.concat(F.lit("op "), described())),
        line(m.errors, 4, F.col("seq"), F.concat(F.lit("error in "), "op", F.lit(": "), "error")),
        line(counted, 5, none, F.col("n")),
    ]
    return functools.reduce(DataFrame.union, steps).orderBy("s", "at", "value").select("value")


def patch_json(m: Mapped) -> DataFrame:
    """One row ``value``: the ops in order as a JSON array, without what is not set."""
    fields = [f for f in m.ops.columns if f not in ("seq", "op")]
    own = F.to_json(F.struct("op", *fields), {"ignoreNullFields": "true"})
    return m.ops.agg(F.array_sort(F.collect_list(F.struct("seq", own.alias("j")))).alias("x")).select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda o: o["j"]), ","), F.lit("]")).alias("value"))


def sample_rows(m: Mapped) -> DataFrame:
    """``row, entities, skipped`` of the rows shown: the subject first, then what it is linked to."""
    entity = F.struct(F.when(F.col("id") == F.concat(F.lit(f"{m.subject.name}:"), F.col("row").cast("string")), 0).otherwise(1).alias("o"), "id", "type", F.array_sort(F.map_entries("attributes")).alias("a"), F.array_sort(F.map_entries("relationships")).alias("r"))
    one = m.entities.groupBy("row").agg(F.array_sort(F.collect_list(entity)).alias("e"))
    plain = F.transform("e", lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), F.map_from_entries(e["a"]).alias("attributes"), F.map_from_entries(e["r"]).alias("relationships")))
    left = m.skipped.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "column", "reason"))).alias("s"))
    none = F.expr("cast(array() as array<struct<column string, reason string>>)")
    said = F.coalesce(F.transform("s", lambda x: F.struct(x["column"].alias("column"), x["reason"].alias("reason"))), none)
    return one.join(left, "row", "left").select("row", plain.alias("entities"), said.alias("skipped"))


def report_json(m: Mapped, row_count: int) -> DataFrame:
    """One row ``value``: a table's report with its columns, questions, flags, rows and counts."""
    d, four = m.decisions, lambda c: F.round(c, 4)
    signals = lambda c: F.struct(*(four(c[n]).alias(n) for n in ("bm25", "embedding", "datatype_prior", "shape_prior")), F.when(c["aliased_from"].isNotNull(), 1.0).alias("aliased_from_twin"))
    found = F.transform("candidates", lambda c: F.struct(c["doc_id"].alias("id"), four(c["score"]).alias("score"), signals(c).alias("signals")))
    column = F.struct("position", "column", "disposition", "target", four(F.col("confidence")).alias("confidence"), "decided_by", "gates_fired", F.coalesce("escalated", F.lit(False)).alias("escalated"), F.coalesce("downgraded", F.lit(False)).alias("downgraded_from_escalation"), found.alias("retrieval"))
    columns = d.agg(F.array_sort(F.collect_list(F.struct("position", F.to_json(column, {"ignoreNullFields": "true"}).alias("j")))).alias("x"))
    after = d.where("id is not null").select(F.col("id").alias("q"), "answer", "source", F.concat_ws(" -> ", "disposition", F.when(F.col("disposition") == "reuse", F.col("target"))).alias("resulting_decision"))
    asked = m.questions.join(after, F.col("id") == F.col("q")).select(F.struct("id", "question", "why", "context", "answer", "source", "resulting_decision").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("escalations"))
    flags = m.ops.where("op = 'flag_ontology_issue'").agg(F.array_sort(F.collect_list(F.struct("seq", "target", "issue", "severity"))).alias("f"))
    rows = sample_rows(m).agg(F.array_sort(F.collect_list(F.struct("row", F.to_json(F.struct("row", "entities", "skipped")).alias("j")))).alias("r"))
    stats = counters([m]).select(F.struct("reused", "new", "excluded", "escalated").alias("stats"))
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda o: o["j"]), ","), F.lit("]"))
    whole = columns.join(asked).join(flags).join(rows).join(stats)  # one row each
    head = F.to_json(F.struct(F.lit(m.name).alias("csv"), F.lit(row_count).alias("row_count"), F.struct(F.lit(m.subject.name).alias("name"), F.lit(not m.subject.is_new).alias("reused"), F.lit(m.subject.confidence).alias("confidence")).alias("subject_type"), "escalations", F.transform("f", lambda x: F.struct(x["target"].alias("target"), x["issue"].alias("issue"), x["severity"].alias("severity"))).alias("ontology_issues"), "stats"))
    return whole.withColumn("h", head).select(F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"columns":'), text("x"), F.lit(',"sample_rows":'), text("r"), F.lit("}")).alias("value"))


def summary(runs: Sequence[Mapped]) -> DataFrame:
    """One row ``csvs, totals``: the counts of every table in order, and their sums."""
    n = counters(runs).withColumn("columns", F.col("reused") + F.col("new") + F.col("excluded"))
    own = F.struct("seq", F.col("table").alias("csv"), F.struct(*COUNTED).alias("stats"))
    whole = n.agg(F.array_sort(F.collect_list(own)).alias("x"), F.struct(*(F.sum(c).alias(c) for c in COUNTED)).alias("totals"))
    return whole.select(F.transform("x", lambda t: F.struct(t["csv"].alias("csv"), t["stats"].alias("stats"))).alias("csvs"), "totals")
