"""Columns as texts for models, and proposals that a chat model makes of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import models
from ..sources.settings import Endpoint
from .decide import DECISION, Proposer
from .small import kept

SYSTEM = (
    "You map one column of a table onto a catalog of concepts. Reuse a candidate where its meaning and datatype fit; else propose a new attribute or "
    "relationship of the subject type, exclude what carries no meaning, or escalate if only a person can tell. Answer with JSON by the schema."
)
_KINDS = ["reuse", "new_attribute", "new_relationship", "exclude", "escalate"]
_TEXT = {"type": ["string", "null"]}
SCHEMA = json.dumps({"type": "object", "properties": {"disposition": {"enum": _KINDS}, **{c: _TEXT for c in DECISION[1:6]}, "confidence": {"type": "number"}}, "required": list(DECISION), "additionalProperties": False})
_ANSWER = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in DECISION)


def query_text(name: Column, datatype: Column, samples: Column) -> Column:
    """What is embedded of a column; a fixed format, as the cached vectors hang on it."""
    return F.concat(F.lit("column "), name, F.lit(" ("), datatype, F.lit(") values: "), F.array_join(F.slice(samples, 1, 3), ", "))


def prior_decisions(decisions: DataFrame, of: list[str] | None = None) -> DataFrame:
    """``decisions`` with ``prior``: a line for each decision at an earlier position (within ``of``); null for the first."""
    line = F.concat(F.lit("- "), "column", F.lit(": "), "disposition", F.lit(" -> "), F.coalesce("target", "new_name", F.lit("-")))
    before = Window.partitionBy(*(of or [F.lit(1)])).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return decisions.withColumn("prior", F.nullif(F.array_join(F.collect_list(line).over(before), "\n"), F.lit("")))


def _candidate(c: Column) -> Column:
    twin = F.when(c["aliased_from"].isNotNull(), F.concat(F.lit(", stands for its twin "), c["aliased_from"])).otherwise("")
    return F.concat(F.lit("- "), c["doc_id"], F.format_string(" (%.2f", c["score"]), twin, F.lit(")"))


def request(columns: DataFrame, table: str) -> DataFrame:
    """``system, user, schema, tag`` for each of ``columns(column, datatype, shape, samples, candidates, subject, prior, note, answered)``."""
    none = lambda c: F.coalesce(c, F.lit("(none)"))
    found = F.nullif(F.array_join(F.transform("candidates", _candidate), "\n"), F.lit(""))
    head = F.concat(F.lit(f"Table: {table}\nSubject type: "), "subject", F.lit("\nColumn: "), "column", F.lit("\nDatatype: "), "datatype", F.lit(", shape: "), none(F.col("shape")), F.lit("\nSamples: "), F.array_join("samples", " | "))
    more = [F.when(F.col(c).isNotNull(), F.concat(F.lit(said), c)) for c, said in (("note", "\n\nTry again: "), ("answered", "\n\nA person was asked about this column and decides: "))]
    user = F.concat(head, F.lit("\n\nCandidates:\n"), none(found), F.lit("\n\nDecided before:\n"), none(F.col("prior")), *(F.coalesce(m, F.lit("")) for m in more))
    return columns.withColumns({"system": F.lit(SYSTEM), "user": user, "schema": F.lit(SCHEMA), "tag": models.tag(F.lit("column"), F.lit(table), F.col("column"))})


def model_proposer(table: str, to: Endpoint, cache: str, send: models.Send = models.post) -> Proposer:
    """A proposer that asks a chat model, column after column, as each prompt tells what was proposed before it.

    A reuse of a concept that is not in the catalog is asked once more, with the ids that there are to choose from. The steps are as
    many as a header has columns; no data row is looked at.
    """

    def ask(one: DataFrame) -> DataFrame:
        got = models.chat(request(one, table), to, cache, send)
        return kept(got.withColumn("proposal", F.from_json("content", _ANSWER)).select(*one.columns, "proposal"))

    def propose(columns: DataFrame, cards: DataFrame | None = None) -> DataFrame:
        columns = kept(columns)
        none = F.lit(None).cast("string")
        done = None
        for at in [r.position for r in columns.select("position").orderBy("position").collect()]:
            one = columns.where(F.col("position") == at)
            blank = one.withColumns({"disposition": none, "target": none, "new_name": none})
            seen = blank if done is None else done.select("*", *(F.col(f"proposal.{c}").alias(c) for c in ("disposition", "target", "new_name"))).drop("proposal").unionByName(blank)
            told = prior_decisions(seen).where(F.col("position") == at).drop("disposition", "target", "new_name").withColumns({"note": none, "answered": none})
            got = ask(told)
            if cards is not None:
                ids = cards.select(F.lower("card_id").alias("known"))
                lost = got.where("proposal.disposition = 'reuse'").join(ids, F.lower("proposal.target") == F.col("known"), "left_anti")
                if not lost.isEmpty():
                    choice = F.array_join(F.transform("candidates", lambda c: c["doc_id"]), ", ")
                    got = ask(lost.withColumn("note", F.concat(F.lit("there is no concept "), "proposal.target", F.lit("; the candidates are "), choice)).drop("proposal"))
            got = got.drop("prior", "note", "answered")
            done = got if done is None else kept(done.unionByName(got))
        return columns.withColumn("proposal", F.from_json(none, _ANSWER)) if done is None else done

    return propose
