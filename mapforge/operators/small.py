"""Tables of a catalog's or a header's size: kept on the driver, planned without the machinery that large ones need."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows that are kept as a local relation, at most; a larger table is checkpointed.
LOCAL_ROWS = 20_000
_PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false"}


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Run what is small in single tasks: staging and compiling would take far longer than the rows themselves."""
    before = {k: spark.conf.get(k, None) for k in _PLAIN}
    for k, v in _PLAIN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster names, or a new one where it names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    return df.checkpoint()


def _nullable(df: DataFrame) -> DataFrame:
    """``df`` with every field nullable: Arrow has no null struct whose fields may not be null."""
    loose = re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', df.schema.json())
    return df.to(StructType.fromJson(json.loads(loose)))


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table. As a local relation its size is known, so that joins with it need no shuffle."""
    df = _nullable(df)
    head = df.limit(LOCAL_ROWS + 1).toArrow()
    if head.num_rows > LOCAL_ROWS:
        return checkpointed(df)
    return df.sparkSession.createDataFrame(head, schema=df.schema)
