"""Proposals for columns, the gates that doubt them, and the budget of questions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions import vocabulary as V
from .search import search


@dataclass(frozen=True)
class Subject:
    """What a table's rows are."""

    name: str
    is_new: bool
    confidence: float


def type_name(file_name: str) -> str:
    """A type's name out of a file's."""
    words = re.split("[^a-zA-Z0-9]+", file_name.rsplit(".", 1)[0])
    return re.sub(r"^\d+", "", "".join(w.capitalize() for w in words if w)) or "UnknownType"


def decide_subject(spark: SparkSession, file_name: str, header: Sequence[str], cards: DataFrame) -> Subject:
    """The type whose card the header's words find first, or a new one named after the file."""
    words = list(dict.fromkeys(w for c in header for w in re.split("[^a-zA-Z0-9]+", c.lower()) if w))
    asked = spark.createDataFrame([("header", words, "string", None, False, None)], "query_id string, tokens array<string>, datatype string, shape string, freetext boolean, subject string")
    found = search(cards, asked, V.TYPE_K).join(cards.select(F.col("card_id").alias("doc_id"), "kind", "name"), "doc_id").where("kind = 'type'").orderBy("rank").limit(V.TYPES).collect()
    if found and found[0].score >= V.SUBJECT_FLOOR:
        return Subject(found[0]["name"], False, 0.7)
    return Subject(type_name(file_name), True, 0.5)


#: Adds ``proposal`` to columns with their candidates; the cards are the catalog's.
Proposer = Callable[[DataFrame, DataFrame], DataFrame]

DECISION = ("disposition", "target", "new_name", "new_datatype", "new_range", "on_type", "confidence")


def propose(columns: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Reuse of the best candidate if it is good enough, else a new attribute of the subject."""
    good = F.coalesce(F.col("top.score") >= V.REUSE_SCORE, F.lit(False))
    return columns.withColumn("proposal", F.struct(
        F.when(good, "reuse").otherwise("new_attribute").alias("disposition"),
        F.when(good, F.col("top.doc_id")).alias("target"),
        F.when(~good, F.lower("column")).alias("new_name"),
        F.when(~good, F.col("datatype")).alias("new_datatype"),
        F.lit(None).cast("string").alias("new_range"),
        F.when(~good, F.col("subject")).alias("on_type"),
        F.when(good, F.least(F.lit(1.0), F.col("top.score"))).otherwise(0.6).alias("confidence"),
    ))


def with_candidates(profile: DataFrame, cards: DataFrame, subject: str, k: int = V.COLUMN_K) -> DataFrame:
    """Columns that are not junk with their candidates, the best one's kind and datatype, and the margin."""
    asked = profile.where("junk is null").select(F.col("name").alias("query_id"), "tokens", F.col("inferred_datatype").alias("datatype"), "shape", "freetext", F.lit(subject).alias("subject"))
    found = search(cards, asked, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "bm25", "embedding", "datatype_prior", "shape_prior", "aliased_from"))).alias("candidates"))
    out = profile.where("junk is null").join(found, F.col("name") == F.col("query_id"), "left")
    top = F.get("candidates", 0)
    info = cards.select(F.col("card_id").alias("top_id"), F.col("kind").alias("top_kind"), F.col("datatype").alias("top_datatype"))
    out = out.select(F.col("name").alias("column"), "position", F.col("inferred_datatype").alias("datatype"), "shape", "freetext", "samples", F.coalesce("candidates", F.expr("cast(array() as array<struct<rank int, doc_id string, score double, bm25 double, embedding double, datatype_prior double, shape_prior double, aliased_from string>>)")).alias("candidates"), F.lit(subject).alias("subject"))
    out = out.withColumn("top", F.get("candidates", 0)).join(info, F.col("top.doc_id") == F.col("top_id"), "left").drop("top_id")
    second = F.get("candidates", 1)["score"]
    return out.withColumn("score_margin", F.coalesce(F.get("candidates", 0)["score"] - F.coalesce(second, F.lit(0.0)), F.lit(0.0)))


def gates(proposed: DataFrame, cards: DataFrame) -> DataFrame:
    """Run all gates over ``proposed(..., proposal)``; adds the decision's live columns and what fired, in order.

    ``vacuous_target`` rewrites the decision and emits a flag, the others ask for an answer.
    """
    goal = cards.select(F.lower("card_id").alias("goal_id"), F.col("kind").alias("goal_kind"), F.col("datatype").alias("goal_datatype"))
    exact = cards.where("vacuous").select(F.col("card_id").alias("vacuous_id")).withColumn("goal_vacuous", F.lit(True))
    d = proposed.select("*", *(F.col(f"proposal.{c}").alias(c) for c in DECISION))
    d = d.join(goal.groupBy("goal_id").agg(F.first("goal_kind").alias("goal_kind"), F.first("goal_datatype").alias("goal_datatype")), F.lower("target") == F.col("goal_id"), "left").join(exact, F.col("target") == F.col("vacuous_id"), "left")
    new, reuse = F.col("disposition").isin("new_attribute", "new_relationship"), (F.col("disposition") == "reuse") & F.col("target").isNotNull()
    no = lambda c: F.coalesce(c, F.lit(False))
    fit = lambda datatype: names.datatype_fit(F.col("datatype"), F.col("freetext"), datatype)
    top, second = F.get("candidates", 0)["score"], F.get("candidates", 1)["score"]
    clash = no((F.col("top_kind") == "attribute") & F.col("top_datatype").isNotNull() & (fit(F.col("top_datatype")) == 0.0))
    near = no(new & (top >= F.when(clash, V.REUSE_SCORE_CONFLICT).otherwise(V.REUSE_SCORE)))
    chosen = F.get(F.filter("candidates", lambda c: c["doc_id"] == F.col("target")), 0)
    fired = [
        ("near_duplicate", near),
        ("score_margin_ambiguous", no(new & (top >= V.MARGIN_TOP) & (top - second < V.MARGIN) & ~near)),
        ("datatype_conflict", no(reuse & (F.col("goal_kind") == "attribute") & (fit(F.col("goal_datatype")) == 0.0))),
        ("kind_mismatch", no(reuse & (F.col("goal_kind") == "relationship") & ((F.col("datatype") != "string") | F.col("freetext")))),
        ("retrieval_override", no(reuse & second.isNotNull() & (chosen["doc_id"] != F.get("candidates", 0)["doc_id"]) & (top - chosen["score"] >= V.OVERRIDE_GAP))),
        ("vacuous_source", no(new & F.lower(F.trim("column")).isin(*V.VACUOUS_COLUMNS))),
        ("vacuous_target", no(reuse & F.col("goal_vacuous"))),
        ("low_confidence", no(F.col("confidence") < V.LOW_CONFIDENCE)),
        ("unknown_target", no(reuse & F.col("goal_id").isNull())),
        ("llm_escalate", F.col("disposition") == "escalate"),
    ]
    asks = [(V.GATE_PRIORITY[g], i, g, c) for i, (g, c) in enumerate(fired) if g in V.GATE_PRIORITY]
    strongest = F.array_min(F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(i).alias("i"), F.lit(g).alias("gate"))) for p, i, g, c in asks))))
    d = d.withColumn("gates_fired", F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in fired)))).withColumn("near_dup_datatype_conflict", near & clash).withColumn("ask", strongest)
    rewritten = F.array_contains("gates_fired", "vacuous_target")
    owner = F.when(F.col("target").contains("."), F.substring_index("target", ".", 1)).otherwise(F.col("subject"))
    return d.select(
        "column", "position", "datatype", "freetext", "samples", "candidates", "subject", "proposal", "score_margin", "gates_fired", "near_dup_datatype_conflict",
        F.when(rewritten, "new_attribute").otherwise(F.col("disposition")).alias("disposition"),
        F.when(~rewritten, F.col("target")).alias("target"),
        F.when(rewritten, F.lower("column")).otherwise(F.col("new_name")).alias("new_name"),
        F.when(rewritten, F.col("datatype")).otherwise(F.col("new_datatype")).alias("new_datatype"),
        "new_range",
        F.when(rewritten, owner).otherwise(F.col("on_type")).alias("on_type"),
        "confidence",
        F.when(rewritten, F.col("target")).alias("flagged"),
        F.col("ask").isNotNull().alias("escalated"),
        F.col("ask.gate").alias("escalation_gate"),
        F.col("ask.priority").alias("priority"),
        F.lit(False).alias("downgraded"),
    )


def with_budget(decisions: DataFrame, budget: int = V.BUDGET, of: Sequence[str] = ()) -> DataFrame:
    """Keep the ``budget`` most pressing questions (of each group ``of``); the others fall back to their proposals."""
    order = Window.partitionBy(*(of or [F.lit(1)]), "escalated").orderBy("priority", F.coalesce("score_margin", F.lit(0.0)), "position")
    d = decisions.withColumn("place", F.row_number().over(order))
    over = F.col("escalated") & (F.col("place") > budget)
    back: dict[str, Column] = {c: F.when(over, F.col(f"proposal.{c}")).otherwise(F.col(c)) for c in DECISION}
    back["disposition"] = F.when(over, F.when(F.col("proposal.disposition") == "escalate", "exclude").otherwise(F.col("proposal.disposition"))).otherwise(F.col("disposition"))
    back["confidence"] = F.when(over, F.col("proposal.confidence") * V.DOWNGRADE).otherwise(F.col("confidence"))
    return d.withColumns({**back, "gates_fired": F.when(over, F.array_append("gates_fired", F.lit("budget"))).otherwise(F.col("gates_fired")), "downgraded": over, "escalated": F.col("escalated") & ~over}).drop("place")


def explanation() -> Column:
    """Why a decision is doubted, with the figures that its strongest gate saw."""
    first, second = F.get("candidates", 0), F.get("candidates", 1)
    told = {
        "near_duplicate": F.format_string("a new concept is proposed, yet %s scores %.2f; the confidence of %.2f does not weigh against that", first["doc_id"], first["score"], F.col("confidence")),
        "datatype_conflict": F.format_string("the values are of datatype %s, which that of %s does not hold", F.col("datatype"), F.col("target")),
        "unknown_target": F.format_string("%s is not in the catalog", F.col("target")),
        "low_confidence": F.format_string("the confidence of %.2f is below %.2f", F.col("confidence"), F.lit(V.LOW_CONFIDENCE)),
        "score_margin_ambiguous": F.format_string("%s (%.2f) and %s (%.2f) are almost level", first["doc_id"], first["score"], second["doc_id"], second["score"]),
        "kind_mismatch": F.format_string("%s is a relationship, the values are no names of entities", F.col("target")),
        "retrieval_override": F.format_string("%s is proposed, far below the first that was found, %s (%.2f)", F.col("target"), first["doc_id"], first["score"]),
        "vacuous_source": F.format_string("the name '%s' tells nothing", F.col("column")),
        "llm_escalate": F.lit("the proposal is to ask"),
    }
    return F.coalesce(*(F.when(F.col("escalation_gate") == g, c) for g, c in told.items()), F.lit("-"))


def context() -> Column:
    """What helps to answer: samples, datatype, the three best candidates and the proposal, as JSON."""
    found = F.transform(F.slice("candidates", 1, 3), lambda c: F.struct(c["doc_id"].alias("id"), F.round(c["score"], 4).alias("score")))
    return F.to_json(F.struct(F.slice("samples", 1, 5).alias("samples"), F.col("datatype").alias("inferred_datatype"), found.alias("candidates"), F.struct("disposition", "target", "new_name", "confidence").alias("proposed")))


def questions(decisions: DataFrame, csv: int | Column) -> DataFrame:
    """``id, column, gate, question, options, default, why, context`` for every decision that still asks, numbered by position."""
    n = F.row_number().over(Window.orderBy("position"))
    top = F.get("candidates", 0)["doc_id"]
    gate = F.col("escalation_gate")
    retrieved = top.isNotNull() & ((gate == "retrieval_override") | ((gate == "near_duplicate") & ~F.col("near_dup_datatype_conflict")))
    default = F.when(retrieved, F.concat(F.lit("reuse:"), top)).when(gate.isin(*(g for g, a in V.DEFAULT_ANSWER.items() if a == "exclude")), "exclude").otherwise("keep_original")
    name = F.coalesce("new_name", "column")
    options = F.array_compact(F.array(F.when(top.isNotNull(), F.concat(F.lit("reuse:"), top)), F.concat(F.lit("new:"), name), F.lit("exclude"), F.lit("other: <free text>")))
    text = F.concat(F.lit("Column '"), F.col("column"), F.lit("': the proposal is "), F.col("disposition"), F.lit(" "), F.coalesce("target", name), F.lit(". Is that right?"))
    return decisions.where("escalated").select(F.concat(F.lit("csv"), (F.lit(csv) if isinstance(csv, int) else csv).cast("string"), F.lit(".q"), n.cast("string")).alias("id"), "column", gate.alias("gate"), text.alias("question"), options.alias("options"), default.alias("default"), explanation().alias("why"), context().alias("context"))


def resolve(decisions: DataFrame, asked: DataFrame, answers: DataFrame, human: bool = False) -> DataFrame:
    """Decisions with their answers worked in: from ``answers(id, answer)``, else the question's default.

    ``keep_original`` restores the proposal, ``exclude`` excludes, ``reuse:`` and ``new:`` name a concept; other text
    reuses the first candidate that it names, or asks for a new attribute.
    """
    told = asked.join(answers.select("id", F.col("answer").cast("string").alias("given")), "id", "left").select(F.col("column").alias("q_column"), "id", F.coalesce("given", "default").alias("answer"), F.when(F.col("given").isNotNull(), "file").when(F.lit(human), "human").otherwise("default").alias("source"))
    d = decisions.join(told, F.col("column") == F.col("q_column"), "left").drop("q_column")
    a = F.col("answer")
    rest = F.trim(F.expr("substring(answer, instr(answer, ':') + 1)"))
    kind = F.when(a.isNull(), "none").when(a == "keep_original", "keep").when(a == "exclude", "exclude").when(a.startswith("reuse:"), "reuse").when(a.startswith("new:"), "new").otherwise("free")
    free = F.when(F.lower(a).startswith("other:"), rest).otherwise(a)
    d = d.withColumn("kind", kind).withColumn("rest", rest).withColumn("named", F.get(F.filter("candidates", lambda c: F.lower(free).contains(F.lower(c["doc_id"]))), 0)["doc_id"])
    k = F.col("kind")
    link = F.col("proposal.new_range").isNotNull() | (F.col("disposition") == "new_relationship")
    kept = F.when(F.col("proposal.disposition") == "escalate", "exclude").otherwise(F.col("proposal.disposition"))
    takes_new = (k == "new") | ((k == "free") & F.col("named").isNull())
    pick = lambda c, new: F.when(k == "keep", F.col(f"proposal.{c}")).when(takes_new, new).otherwise(F.col(c))
    return d.withColumns({
        "disposition": F.when(k == "keep", kept).when(k == "exclude", "exclude").when((k == "reuse") | ((k == "free") & F.col("named").isNotNull()), "reuse").when((k == "new") & link, "new_relationship").when(takes_new, "new_attribute").otherwise(F.col("disposition")),
        "target": F.when(k == "keep", F.col("proposal.target")).when(k == "reuse", F.col("rest")).when(k == "free", F.coalesce("named", "target")).otherwise(F.col("target")),
        "new_name": pick("new_name", F.when(k == "new", F.col("rest")).otherwise(F.coalesce("new_name", "column"))),
        "on_type": pick("on_type", F.coalesce("on_type", "subject")),
        "new_datatype": pick("new_datatype", F.coalesce("new_datatype", "datatype")),
        "new_range": F.when(k == "keep", F.col("proposal.new_range")).otherwise(F.col("new_range")),
        "decided_by": F.when(F.col("source").isin("file", "human"), "human").when(F.col("source") == "default", "rule").otherwise("heuristic"),
        "escalated": F.lit(False),
    }).drop("kind", "rest", "named")
