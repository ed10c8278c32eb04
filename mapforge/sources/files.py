"""Tables, answers and catalogs from files, and reports to files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every value a string; quotes, doubled quotes and line breaks in quotes as in RFC 4180."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_answers(spark: SparkSession, path: str | None) -> DataFrame:
    """``id, answer`` from a JSON object; no path gives no answers."""
    if path is None:
        return spark.createDataFrame([], "id string, answer string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "answer"))


def stem(path: str, index: int) -> str:
    """The name of a file's reports: its own without leading digits, after its place in the order."""
    return f"{index}_{re.sub(r'^[0-9]+_', '', path.rsplit('/', 1)[-1].rsplit('.', 1)[0])}"


def write_text(df: DataFrame, path: str) -> None:
    """One document per row ``value``, as it is."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; null fields are left out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
