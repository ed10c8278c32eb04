"""Changes of the catalog as rows: made from decisions, validated, applied; and rows of a table as linked entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions import vocabulary as V
from .catalog import Catalog

OP = "seq int, op string, source_column string, target string, on_type string, name string, datatype string, range string, description string, issue string, severity string, confidence double"


def from_decisions(decisions: DataFrame) -> DataFrame:
    """``OP`` rows of decisions, in the order of columns; only the fields of its kind are set."""
    d = F.col("disposition")
    op = F.when(d == "reuse", "reuse").when(d == "new_attribute", "add_attribute").when(d == "new_relationship", "add_relationship").when(d == "exclude", "exclude")
    add = d.isin("new_attribute", "new_relationship")
    none = F.lit(None).cast("string")
    return decisions.where(op.isNotNull()).select(
        F.col("position").cast("int").alias("seq"), op.alias("op"), F.col("column").alias("source_column"), F.when(d == "reuse", F.col("target")).alias("target"), F.when(add, F.col("on_type")).alias("on_type"),
        F.when(add, F.col("new_name")).alias("name"), F.when(d == "new_attribute", F.coalesce("new_datatype", F.lit("string"))).alias("datatype"), F.when(d == "new_relationship", F.col("new_range")).alias("range"),
        none.alias("description"), none.alias("issue"), none.alias("severity"), F.when(d != "exclude", F.col("confidence")).alias("confidence"),
    )


def described() -> Column:
    """An op in one line."""
    own = F.concat_ws(".", "on_type", "name")
    text = F.when(F.col("op") == "reuse", F.concat("source_column", F.lit(" -> "), "target")).when(F.col("op") == "add_attribute", F.concat(own, F.lit(" ("), "datatype", F.lit(")")))
    text = text.when(F.col("op") == "add_relationship", F.concat(own, F.lit(" -> "), "range")).when(F.col("op") == "add_type", F.col("name")).when(F.col("op") == "exclude", F.col("source_column"))
    text = text.when(F.col("op") == "flag_ontology_issue", F.concat(F.lit("["), "severity", F.lit("] "), "target", F.lit(": "), "issue"))
    return F.concat_ws(": ", "op", text)


def validate(ops: DataFrame, c: Catalog) -> DataFrame:
    """``seq, op, error``: everything wrong with ops against the catalog as it was; none means well-formed.

    A type that the patch adds is known to later ops, by exact name.
    """
    low = lambda x: F.lower(F.trim(x))
    types = c.types.select(low("name").alias("n")).distinct()
    members = c.attributes.select(low(F.concat_ws(".", "owner", "name")).alias("n"), F.lit("a").alias("k")).unionAll(c.relationships.select(low(F.concat_ws(".", "owner", "name")).alias("n"), F.lit("r").alias("k")))
    concepts = members.select("n").unionAll(types).distinct()
    added = ops.where("op = 'add_type'").groupBy("name").agg(F.min("seq").alias("since")).withColumnRenamed("name", "added")
    has = lambda df, on, name: df.select(F.col("n").alias(f"{name}_n"), F.lit(True).alias(name))
    o = ops
    for df, on, name in (
        (concepts, low("target"), "goal"), (types, low("on_type"), "owner"), (types, low("range"), "ranged"), (types, low("name"), "typed"),
        (members.where("k = 'a'"), low(F.concat_ws(".", "on_type", "name")), "attribute"), (members.where("k = 'r'"), low(F.concat_ws(".", "on_type", "name")), "link"),
    ):
        o = o.join(has(df.select("n").distinct(), on, name), on == F.col(f"{name}_n"), "left").drop(f"{name}_n")
    for on, name in ((F.substring_index("target", ".", 1), "goal_added"), (F.col("on_type"), "owner_added"), (F.col("range"), "range_added")):
        o = o.join(added.select(F.col("added").alias(f"{name}_n"), F.col("since").alias(name)), on == F.col(f"{name}_n"), "left").drop(f"{name}_n")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    earlier = lambda name: F.coalesce(F.col(name) < F.col("seq"), F.lit(False))
    is_ = lambda op: F.col("op") == op
    adds = F.col("op").isin("add_attribute", "add_relationship")
    known = yes("owner") | earlier("owner_added")
    errors: list[tuple[Column, str]] = [
        (~F.col("confidence").between(0.0, 1.0), "confidence is not within 0 and 1"),
        (is_("reuse") & ~yes("goal") & ~earlier("goal_added"), "target does not exist"),
        (adds & ~known, "on_type does not exist"),
        (is_("add_attribute") & yes("owner") & yes("attribute"), "attribute exists"),
        (is_("add_relationship") & yes("owner") & yes("link"), "relationship exists"),
        (is_("add_attribute") & ~F.coalesce(F.col("datatype").isin(*V.DATATYPES), F.lit(False)), "datatype is unknown"),
        (is_("add_relationship") & ~yes("ranged") & ~earlier("range_added"), "range does not exist"),
        (adds & ~F.coalesce(F.col("name").rlike(V.SNAKE_CASE), F.lit(False)), "name is not snake_case"),
        (is_("add_type") & ~F.coalesce(F.col("name").rlike(V.PASCAL_CASE), F.lit(False)), "name is not PascalCase"),
        (is_("add_type") & yes("typed"), "type exists"),
        (is_("flag_ontology_issue") & ~F.coalesce(F.col("severity").isin(*V.SEVERITIES), F.lit(False)), "severity is unknown"),
    ]
    return o.select("seq", "op", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in errors)))).alias("error"))


def apply(ops: DataFrame, c: Catalog, mode: str = "auto") -> tuple[Catalog, DataFrame]:
    """The catalog with what ops add (mode ``none`` adds nothing), and ``seq, op, applied, mutated``."""
    if mode not in ("auto", "none"):
        raise ValueError(f"no such mode: {mode}")
    adds = F.col("op").startswith("add_")
    log = ops.select("seq", "op", (~adds | F.lit(mode == "auto")).alias("applied"), (adds & F.lit(mode == "auto")).alias("mutated"))
    if mode == "none":
        return c, log
    last = c.types.agg(F.coalesce(F.max("t"), F.lit(-1)).alias("m")).first().m
    seq = F.row_number().over(Window.orderBy("seq")) + last
    types = c.types.unionByName(ops.where("op = 'add_type'").select(seq.cast("int").alias("t"), "name", F.coalesce("description", F.lit("")).alias("description")))

    def grown(own: DataFrame, kind: str, extra: dict[str, Column]) -> DataFrame:
        size = own.groupBy("t").agg((F.max("i") + 1).alias("size"))
        at = types.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.min_by("name", "t").alias("owner"), F.min("t").alias("t"))
        new = ops.where(F.col("op") == kind).join(at, F.lower(F.trim("on_type")) == F.col("low")).join(size, "t", "left")
        i = F.coalesce("size", F.lit(0)) + F.row_number().over(Window.partitionBy("t").orderBy("seq")) - 1
        return own.unionByName(new.select("t", "owner", i.cast("int").alias("i"), "name", F.coalesce("description", F.lit("")).alias("description"), F.lit(None).cast("string").alias("aligned_with"), *(v.alias(k) for k, v in extra.items())))

    return Catalog(types, grown(c.attributes, "add_attribute", {"datatype": F.col("datatype"), "required": F.lit(False)}), grown(c.relationships, "add_relationship", {"range": F.col("range")})), log


def _uses(decisions: DataFrame, c: Catalog, subject: str) -> DataFrame:
    """``column, position, disposition, target, owner, name, range``: what each deciding column says; ``name`` is null where its target is not in the catalog."""
    d = F.col("disposition")
    owner = F.when(d == "reuse", F.substring_index("target", ".", 1)).otherwise(F.coalesce("on_type", F.lit(subject)))
    bare = F.when(d == "reuse", F.expr("substring(target, instr(target, '.') + 1)")).otherwise(F.coalesce("new_name", "column"))
    use = decisions.where(d.isin("reuse", "new_attribute", "new_relationship")).select("column", "position", "disposition", "target", owner.alias("owner"), bare.alias("name"), F.col("new_range"))
    rel = c.relationships.select(F.lower("owner").alias("ro"), F.lower("name").alias("rn"), F.col("range").alias("r"))
    att = c.attributes.select(F.lower("owner").alias("ao"), F.lower("name").alias("an"), F.col("name").alias("a"))
    use = use.join(rel, (F.lower("owner") == F.col("ro")) & (F.lower("name") == F.col("rn")) & (d == "reuse"), "left").join(att, (F.lower("owner") == F.col("ao")) & (F.lower("name") == F.col("an")), "left")
    target = F.when(d == "new_relationship", F.coalesce("new_range", F.lit("Unknown"))).otherwise(F.col("r"))
    return use.select("column", "position", "disposition", "target", "owner", F.when(target.isNull() & (d == "reuse"), F.col("a")).otherwise(F.col("name")).alias("name"), target.alias("range"))


def skipped(cells: DataFrame, decisions: DataFrame, c: Catalog, subject: str) -> DataFrame:
    """``row, position, column, reason`` of what ``project`` leaves out, and of grouped entities that nothing links."""
    rows = cells.select("row").distinct()
    d = F.col("disposition")
    why = F.when(d == "exclude", F.concat(F.lit("excluded: "), F.array_join("gates_fired", ", "))).when(d == "escalate", "unresolved escalation at projection time")
    out = decisions.where(why.isNotNull()).select("position", "column", why.alias("reason")).join(rows)  # a row a column and row shown
    use = _uses(decisions, c, subject)
    lost = use.where("name is null").select("position", "column", F.concat(F.lit("reuse target '"), "target", F.lit("' not found in ontology")).alias("reason")).join(rows)
    v = cells.join(use.where("name is not null"), "column")
    shown = F.when(F.col("v").isNull(), "''").otherwise(F.concat(F.lit("'"), "v", F.lit("'")))
    sentinel = v.where(F.col("range").isNotNull() & names.is_sentinel(F.col("v"))).select("row", "position", "column", F.concat(F.lit("sentinel/empty relationship value ("), shown, F.lit(")")).alias("reason"))
    empty = v.where(F.col("range").isNull() & F.col("v").isNull()).select("row", "position", "column", F.lit("empty value").alias("reason"))
    first = c.relationships.where(F.lower("owner") == subject.lower()).select(F.lower("range").alias("to")).distinct()
    other = v.where(F.col("range").isNull() & F.col("v").isNotNull() & (F.lower("owner") != subject.lower())).groupBy("row", "owner").agg(F.min("position").alias("at"))
    loose = other.join(first, F.lower("owner") == F.col("to"), "left_anti")
    text = F.concat(F.lit(f"no relationship from {subject} to "), "owner", F.lit(" in the ontology; sub-entity built but not linked"))
    loose = loose.select("row", (F.col("at") + (1 << 20)).cast("int").alias("position"), F.concat(F.lit("(grouped:"), "owner", F.lit(")")).alias("column"), text.alias("reason"))
    names_ = ["row", "position", "column", "reason"]
    return out.select(*names_).unionByName(lost.select(*names_)).unionByName(sentinel).unionByName(empty).unionByName(loose)


def project(cells: DataFrame, decisions: DataFrame, c: Catalog, subject: str) -> DataFrame:
    """``row, id, type, attributes, relationships`` of the entities that rows are.

    ``cells(row, column, v)`` are stripped values. Values of the subject's attributes go to it; a relationship's value
    names an entity unless it says that there is none; values for another type are grouped to one entity of the
    row, and linked by the subject's first relationship to that type, in place of a like-named one.
    """
    use = _uses(decisions, c, subject).where("name is not null")
    v = cells.join(use, "column").where("v is not null")
    own = (F.lower("owner") == subject.lower()) & F.col("range").isNull()
    literal = v.where(own).select("row", "name", "v", "position")
    links = v.where(F.col("range").isNotNull() & ~names.is_sentinel(F.col("v"))).select("row", "name", "range", "v", "position", F.concat_ws(":", "range", "v").alias("id"))
    grouped = v.where(~own & F.col("range").isNull()).groupBy("row", "owner").agg(F.array_sort(F.collect_list(F.struct("name", "v"))).alias("kv"))
    grouped = grouped.withColumn("id", F.concat(F.col("owner"), F.lit(":"), F.array_join(F.transform("kv", lambda x: x["v"]), "|")))
    first = c.relationships.where(F.lower("owner") == subject.lower()).groupBy(F.lower("range").alias("to")).agg(F.min_by("name", F.struct("t", "i")).alias("link"))
    joined = grouped.join(first, F.lower("owner") == F.col("to"), "left")
    said = links.select("row", "name", "id", F.struct(F.lit(0).alias("phase"), "position").alias("o")).unionAll(joined.where("link is not null").select("row", F.col("link").alias("name"), "id", F.struct(F.lit(1).alias("phase"), F.lit(0).alias("position")).alias("o")))
    said = said.groupBy("row", "name").agg(F.max_by("id", "o").alias("id")).groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "id")))).alias("relationships"))
    attrs = literal.groupBy("row", "name").agg(F.max_by("v", "position").alias("v")).groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("attributes"))
    none = F.create_map().cast("map<string,string>")
    rows = cells.select("row").distinct().join(attrs, "row", "left").join(said, "row", "left")
    subjects = rows.select("row", F.concat(F.lit(f"{subject}:"), F.col("row").cast("string")).alias("id"), F.lit(subject).alias("type"), F.coalesce("attributes", none).alias("attributes"), F.coalesce("relationships", none).alias("relationships"))
    others = grouped.select("row", "id", F.col("owner").alias("type"), F.map_from_entries("kv").alias("attributes"), none.alias("relationships"))
    named = links.groupBy("row", "id").agg(F.first("range").alias("type"), F.first("v").alias("v")).select("row", "id", "type", F.create_map(F.lit("name"), "v").alias("attributes"), none.alias("relationships"))
    return subjects.unionByName(others).unionByName(named)
