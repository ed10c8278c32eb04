"""Column profiles of any table in one distributed pass.

The table is unpivoted to (column, row, value). Equal values are counted before anything is measured, so every
predicate runs once per distinct value, and the shuffle carries each distinct value of a partition once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions import vocabulary as V

STRIP = r"(?U)^\s+|\s+$"


def stripped(value: Column) -> Column:
    """Without white space of Unicode on either side; null where nothing is left."""
    text = F.regexp_replace(value.cast("string"), STRIP, "")
    return F.when(F.length(text) > 0, text)


def is_date(v: Column) -> Column:
    return v.rlike(V.DATE) & F.try_to_date(F.when(v.rlike(V.DATE), v), "yyyy-MM-dd").isNotNull()


def is_datetime(v: Column) -> Column:
    """ISO date and time with all digits; the day must exist, and so must the time."""
    day, clock = F.substring(v, 1, 10), F.substring(v, 12, 8)
    real = F.try_to_date(F.when(v.rlike(V.DATETIME), day), "yyyy-MM-dd").isNotNull()
    return v.rlike(V.DATETIME) & real & clock.rlike(r"^([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d)?)?")


PREDICATES = {
    "boolean": lambda v: F.lower(v).isin(*V.BOOLEAN_WORDS),
    "integer": lambda v: v.rlike(V.INTEGER),
    "number": lambda v: v.rlike(V.NUMBER),
    "date": is_date,
    "datetime": is_datetime,
}
SHAPES = {
    "url": lambda v: v.rlike(V.URL),
    "email": lambda v: v.rlike(V.EMAIL),
    "iso_datetime": is_datetime,
    "hex_id": lambda v: v.rlike(V.HEX_ID) & v.rlike(V.HEX_LETTER),
    "currency": lambda v: v.rlike(V.CURRENCY),
}


def unpivot(df: DataFrame, row: str | None = None) -> DataFrame:
    """``column, position, row, v``: every cell, stripped; empty cells are null. ``row`` orders rows if given."""
    at = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), stripped(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(df.columns)))
    return df.select(at.alias("row"), F.explode(cells).alias("c")).select("c.column", "c.position", "row", "c.v")


def first_that_agrees(shares: dict[str, Column], otherwise: str | None) -> Column:
    """The first predicate that enough of the values satisfy."""
    out = F.lit(otherwise).cast("string")
    for name, share in reversed(shares.items()):
        out = F.when(share >= V.AGREEMENT, F.lit(name)).otherwise(out)
    return out


def prefilter(name: Column, p: dict[str, Column]) -> Column:
    """Why a column is junk, as the first reason that holds, or null."""
    sync = F.lower(name).isin(*V.SYNC_COLUMNS) & (p["is_constant"] | F.coalesce(p["shape"] == "iso_datetime", F.lit(False)))
    return (
        F.when(p["non_null"] == 0, "empty_column")
        .when((F.trim(name) == "") | name.rlike(V.UNNAMED), "unnamed_column")
        .when((name.rlike(V.SURROGATE) | name.startswith("_")) & (p["uniqueness"] == 1.0), "surrogate_key")
        .when(sync, "sync_metadata")
    )


def evidence(reason: Column, p: dict[str, Column]) -> Column:
    return (
        F.when(reason == "empty_column", F.lit("no value in any row"))
        .when(reason == "unnamed_column", F.lit("the header names nothing"))
        .when(reason == "surrogate_key", F.format_string("every one of %d values is distinct", p["distinct"]))
        .when(reason == "sync_metadata", F.format_string("%d distinct values, shape %s", p["distinct"], F.coalesce(p["shape"], F.lit("none"))))
    )


def profile(df: DataFrame, row: str | None = None) -> DataFrame:
    """A row for every column of ``df``: counts, datatype, shape, samples, flags and the junk verdict.

    Rows are in the order of ``row`` (a number) where given, else in that of the table's partitions.
    """
    order = [row] if row else []
    cells = unpivot(df, row)
    if order:
        cells = cells.where(F.col("column") != row)
    by_value = cells.groupBy("column", "position", "v").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    n = F.col("n")
    share = lambda ok: F.sum(F.when(ok & F.col("v").isNotNull(), n).otherwise(0))
    ranked = by_value.withColumn("rank", F.row_number().over(Window.partitionBy("position").orderBy(F.col("v").isNull(), "first")))
    sums = ranked.groupBy("column", "position").agg(
        F.sum("n").alias("rows"),
        share(F.lit(True)).alias("non_null"),
        F.count("v").alias("distinct"),
        (F.sum(F.when(F.col("v").isNotNull(), n * F.length("v")))).alias("chars"),
        *(share(f(F.col("v"))).alias(f"t_{k}") for k, f in PREDICATES.items()),
        *(share(f(F.col("v"))).alias(f"s_{k}") for k, f in SHAPES.items()),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") <= V.SAMPLES) & F.col("v").isNotNull(), F.struct("first", "v")))), lambda s: s["v"]).alias("samples"),
    )
    start = Window.partitionBy("position").orderBy("row")
    capitals = (
        cells.where("v is not null")
        .select("position", F.row_number().over(start).alias("rank"), F.col("v").rlike(r"^\p{Lu}").cast("int").alias("up"))
        .where(F.col("rank") <= V.ENTITY_VALUES)
        .groupBy("position")
        .agg(F.avg("up").alias("capitals"))
    )
    filled = F.greatest(F.col("non_null"), F.lit(1))
    types = {k: F.when(F.col("non_null") > 0, F.col(f"t_{k}") / filled).otherwise(0.0) for k in PREDICATES}
    shapes = {k: F.when(F.col("non_null") > 0, F.col(f"s_{k}") / filled).otherwise(0.0) for k in SHAPES}
    out = sums.join(capitals, "position", "left").select(
        F.col("column").alias("name"),
        "position",
        F.col("rows").alias("row_count"),
        names.tokenize(F.col("column")).alias("tokens"),
        "non_null",
        F.when(F.col("rows") > 0, 1 - F.col("non_null") / F.col("rows")).otherwise(0.0).alias("null_rate"),
        "distinct",
        F.when(F.col("non_null") > 0, F.col("distinct") / filled).otherwise(0.0).alias("uniqueness"),
        first_that_agrees(types, "string").alias("inferred_datatype"),
        first_that_agrees(shapes, None).alias("shape"),
        "samples",
        F.when(F.col("non_null") > 0, F.col("chars") / filled).otherwise(0.0).alias("avg_len"),
        (F.col("non_null") == 0).alias("is_empty"),
        (F.col("distinct") == 1).alias("is_constant"),
        "capitals",
    )
    text = F.col("inferred_datatype") == "string"
    out = out.withColumn("freetext", (F.col("avg_len") > V.FREETEXT_LENGTH) & (F.col("uniqueness") > V.FREETEXT_UNIQUENESS) & text)
    entity = text & (F.col("distinct") > 1) & (F.col("avg_len") < V.ENTITY_LENGTH) & (F.col("uniqueness") <= V.ENTITY_UNIQUENESS)
    out = out.withColumn("entity_like", entity & (F.coalesce("capitals", F.lit(0.0)) >= V.ENTITY_CAPITALS)).drop("capitals")
    p = {c: F.col(c) for c in out.columns}
    out = out.withColumn("junk", prefilter(F.col("name"), p))
    return out.withColumn("evidence", evidence(F.col("junk"), p))
