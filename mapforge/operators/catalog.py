"""The catalog of types, attributes and relationships as three flat tables; its cards, aliases and audit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions import vocabulary as V
from .graph import connected_components
from .small import kept

SCHEMA = (
    "types array<struct<name string, description string,"
    " attributes array<struct<name string, datatype string, required boolean, description string, aligned_with string>>,"
    " relationships array<struct<name string, range string, description string, aligned_with string>>>>"
)


@dataclass(frozen=True)
class Catalog:
    """``types(t, name, description)``, ``attributes(t, owner, i, name, ...)`` and ``relationships(t, owner, i, name, range, ...)``."""

    types: DataFrame
    attributes: DataFrame
    relationships: DataFrame


def flatten(nested: DataFrame) -> Catalog:
    """From rows of ``SCHEMA``; the order of the arrays is kept in ``t`` and ``i``."""
    each = nested.select(F.posexplode("types").alias("t", "x")).cache()
    empty = lambda c: F.coalesce(c, F.lit(""))
    types = each.select("t", F.col("x.name").alias("name"), empty(F.col("x.description")).alias("description"))
    attrs = each.select("t", F.col("x.name").alias("owner"), F.posexplode("x.attributes").alias("i", "a"))
    rels = each.select("t", F.col("x.name").alias("owner"), F.posexplode("x.relationships").alias("i", "r"))
    return Catalog(
        types,
        attrs.select("t", "owner", "i", "a.name", "a.datatype", F.coalesce("a.required", F.lit(False)).alias("required"), empty(F.col("a.description")).alias("description"), "a.aligned_with"),
        rels.select("t", "owner", "i", "r.name", "r.range", empty(F.col("r.description")).alias("description"), "r.aligned_with"),
    )


def nest(c: Catalog) -> DataFrame:
    """Back to one row of ``SCHEMA``."""
    attrs = c.attributes.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "name", "datatype", "required", "description", "aligned_with"))).alias("attributes"))
    rels = c.relationships.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", "name", "range", "description", "aligned_with"))).alias("relationships"))
    drop = lambda col, fields: F.transform(F.coalesce(col, F.expr(f"cast(array() as {SCHEMA_OF[fields]})")), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    rows = c.types.join(attrs, "t", "left").join(rels, "t", "left")
    one = F.struct("t", "name", "description", drop(F.col("attributes"), ATTRIBUTE).alias("attributes"), drop(F.col("relationships"), RELATIONSHIP).alias("relationships"))
    whole = rows.agg(F.array_sort(F.collect_list(one)).alias("types"))
    return whole.select(F.transform("types", lambda x: F.struct(*(x[f].alias(f) for f in ("name", "description", "attributes", "relationships")))).alias("types"))


ATTRIBUTE = ("name", "datatype", "required", "description", "aligned_with")
RELATIONSHIP = ("name", "range", "description", "aligned_with")
SCHEMA_OF: Mapping[tuple[str, ...], str] = {
    ATTRIBUTE: "array<struct<i int, name string, datatype string, required boolean, description string, aligned_with string>>",
    RELATIONSHIP: "array<struct<i int, name string, range string, description string, aligned_with string>>",
}


def richness(c: Catalog) -> DataFrame:
    """``name, members, described`` of each type."""
    both = c.attributes.select("owner", "description").unionAll(c.relationships.select("owner", "description"))
    n = both.groupBy("owner").agg(F.count("*").alias("members"), F.count_if(F.col("description") != "").alias("d"))
    own = (F.col("description") != "").cast("long")
    return c.types.join(n, F.col("name") == F.col("owner"), "left").select("name", F.coalesce("members", F.lit(0)).alias("members"), (F.coalesce("d", F.lit(0)) + own).alias("described"))


def lifted(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with ``score`` lifted to the threshold where it falls just short of it and both types' ``vectors(name, vector)`` are close."""
    of = lambda c: vectors.select(F.col("name").alias(f"{c}_name"), F.col("vector").alias(f"{c}_vector"))
    both = pairs.join(of("a"), F.col("a") == F.col("a_name"), "left").join(of("b"), F.col("b") == F.col("b_name"), "left")
    close = F.coalesce(names.cosine(F.col("a_vector"), F.col("b_vector")) >= V.RESCUE_COSINE, F.lit(False))
    short = (F.col("score") >= V.NEAR_DUPLICATE_RESCUE) & (F.col("score") < V.NEAR_DUPLICATE) & close
    return both.withColumn("score", F.when(short, V.NEAR_DUPLICATE).otherwise(F.col("score"))).drop("a_name", "a_vector", "b_name", "b_vector")


def near_duplicate_types(c: Catalog, vectors: DataFrame | None = None) -> DataFrame:
    """``a, b, name_similarity, overlap, score`` of pairs of types that look alike, the best first.

    Every pair of types is compared, as names alone can make them alike; types are few. ``vectors(name, vector)``, embeddings
    of a type's name and description, lift pairs that fall just short.
    """
    ids = c.attributes.groupBy("owner").agg(F.collect_set(names.canonical_id(F.col("name"))).alias("ids"))
    own = c.types.join(ids, F.col("name") == F.col("owner"), "left").select("t", "name", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    a, b = own.select(F.col("t").alias("ta"), F.col("name").alias("a"), F.col("ids").alias("ia")), own.select(F.col("t").alias("tb"), F.col("name").alias("b"), F.col("ids").alias("ib"))
    pairs = a.join(b, F.col("ta") < F.col("tb")).select("a", "b", names.name_similarity(F.col("a"), F.col("b")).alias("name_similarity"), names.jaccard(F.col("ia"), F.col("ib")).alias("overlap"))
    scored = pairs.withColumn("score", 0.5 * F.col("name_similarity") + 0.5 * F.col("overlap"))
    scored = scored if vectors is None else lifted(scored, vectors)
    return scored.where(F.col("score") >= V.NEAR_DUPLICATE).orderBy(F.desc("score"), "a", "b")


def canonical_types(c: Catalog, pairs: DataFrame | None = None) -> DataFrame:
    """``name, canonical``: for types in a group of near duplicates, its richest (ties by name) if another.

    ``pairs`` are its near duplicates where they are known already.
    """
    pairs = kept(near_duplicate_types(c)) if pairs is None else pairs
    if pairs.isEmpty():
        return c.types.select("name", F.col("name").alias("canonical")).where(F.lit(False))
    groups = connected_components(pairs.select("a", "b"), c.types.select(F.col("name").alias("node")), keep=kept)
    rich = groups.join(richness(c), groups.node == F.col("name")).select("node", "component", "members", "described")
    first = Window.partitionBy("component").orderBy(F.desc("members"), F.desc("described"), "node")
    return rich.select(F.col("node").alias("name"), F.first("node").over(first).alias("canonical")).where("name <> canonical")


def concept_aliases(c: Catalog, canonical: DataFrame | None = None) -> DataFrame:
    """``card_id, aliased_to``: types, attributes and relationships of twins and what they resolve to (null: nothing)."""
    types = canonical_types(c) if canonical is None else canonical
    concepts = c.attributes.select("owner", F.lit(0).alias("k"), "i", "name").unionAll(c.relationships.select("owner", F.lit(1).alias("k"), "i", "name"))
    concepts = concepts.select("owner", "k", "i", "name", names.canonical_id(F.col("name")).alias("cid"))
    first = concepts.groupBy("owner", "cid").agg(F.min_by("name", F.struct("k", "i")).alias("found"))
    twins = concepts.join(types, concepts.owner == types.name).select(concepts.owner.alias("twin"), concepts.name.alias("own"), "cid", "canonical")
    found = twins.join(first, (twins.canonical == first.owner) & (twins.cid == first.cid), "left")
    inner = found.select(F.concat_ws(".", "twin", "own").alias("card_id"), F.when(F.col("found").isNotNull(), F.concat_ws(".", "canonical", "found")).alias("aliased_to"))
    return types.select(F.col("name").alias("card_id"), F.col("canonical").alias("aliased_to")).unionAll(inner)


def cards(c: Catalog, vectors: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """One row for each concept: its text for search, whether it is vacuous, and what it is an alias of.

    ``vectors(card_id, vector)`` adds embeddings; ``canonical`` is what ``canonical_types`` gives where it is known already.
    """
    tail = F.when(F.col("description") != "", F.concat(F.lit(" — "), F.col("description"))).otherwise("")
    listed = c.attributes.groupBy(F.col("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("own"))
    types = c.types.join(listed, F.col("name") == F.col("owner"), "left").select(
        F.struct("t", F.lit(0).alias("k"), F.lit(0).alias("i")).alias("ord"), F.lit("type").alias("kind"), F.col("name").alias("card_id"), F.lit(None).cast("string").alias("owner"), "name",
        F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("range"), "description",
        F.concat("name", F.lit(" — "), "description", F.lit(" | attributes: "), F.coalesce(F.array_join("own", ", "), F.lit(""))).alias("text"),
    )
    own_id = F.concat_ws(".", "owner", "name")
    attrs = c.attributes.select(F.struct("t", F.lit(1).alias("k"), "i").alias("ord"), F.lit("attribute").alias("kind"), own_id.alias("card_id"), "owner", "name", "datatype", F.lit(None).cast("string").alias("range"), "description", F.concat(own_id, F.lit(" ("), "datatype", F.lit(")"), tail).alias("text"))
    rels = c.relationships.select(F.struct("t", F.lit(2).alias("k"), "i").alias("ord"), F.lit("relationship").alias("kind"), own_id.alias("card_id"), "owner", "name", F.lit(None).cast("string").alias("datatype"), "range", "description", F.concat(own_id, F.lit(" -> "), "range", tail).alias("text"))
    alias = concept_aliases(c, canonical).withColumn("twin", F.lit(True))
    out = types.unionByName(attrs).unionByName(rels).join(alias, "card_id", "left")
    orphan = F.coalesce("twin", F.lit(False)) & F.col("aliased_to").isNull()
    out = out.withColumn("vacuous", names.is_vacuous(F.col("name"), F.col("description"))).withColumn("orphan_twin", orphan).drop("twin")
    return out.join(vectors, "card_id", "left") if vectors is not None else out


def audit(c: Catalog, pairs: DataFrame | None = None, canonical: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """``seq, op, target, issue, severity``: near duplicates, then vacuous concepts, then misleading datatypes.

    The near duplicates, canonical types and cards of the catalog are taken as given, or found anew.
    """
    pairs = kept(near_duplicate_types(c)) if pairs is None else pairs
    canonical = kept(canonical_types(c, pairs)) if canonical is None else canonical
    dup = pairs.join(canonical, (F.col("a") == F.col("name")) | (F.col("b") == F.col("name")))
    keep = F.col("canonical")
    twin = F.when(F.col("a") == keep, F.col("b")).otherwise(F.col("a"))
    dup = dup.groupBy("a", "b", "name_similarity", "overlap", "score").agg(F.first("canonical").alias("canonical")).select(
        F.struct(F.lit(0).alias("p"), (-F.col("score")).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("i"), F.concat_ws(" ", "a", "b").alias("n")).alias("seq"),
        F.concat_ws(" / ", "a", "b").alias("target"),
        F.concat(F.format_string("types '%s' and '%s' are near duplicates (names %.2f, attributes %.2f, score %.2f); ", "a", "b", "name_similarity", "overlap", "score"), F.format_string("search resolves '%s' to '%s'", twin, keep)).alias("issue"),
    )
    every = cards(c, canonical=canonical) if every is None else every
    place = lambda p: F.struct(F.lit(p).alias("p"), F.col("ord.k").cast("double").alias("s"), F.col("ord.t").alias("t"), F.col("ord.i").alias("i"), F.col("card_id").alias("n"))
    vacuous = every.where("vacuous").select(place(1).alias("seq"), F.col("card_id").alias("target"), F.format_string("%s '%s' is vacuous (generic name or placeholder description)", "kind", "card_id").alias("issue"))
    smell = every.where((F.col("kind") == "attribute") & names.implies_quantity(F.col("name"), F.col("datatype"))).select(place(2).alias("seq"), F.col("card_id").alias("target"), F.format_string("the name of attribute '%s' is a quantity, its datatype string", "card_id").alias("issue"))
    flags = dup.unionByName(vacuous).unionByName(smell)
    return flags.select(F.row_number().over(Window.orderBy("seq")).alias("seq"), F.lit("flag_ontology_issue").alias("op"), "target", "issue", F.lit("warning").alias("severity"))


def read(spark: SparkSession, path: str) -> Catalog:
    return flatten(spark.read.schema(SCHEMA).json(path, multiLine=True))
