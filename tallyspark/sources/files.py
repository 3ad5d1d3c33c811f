"""Readers and writers of logs: CSV with explicit schemas, newest file, result sets in JSON, expiring caches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV log. Values that don't parse are null; rows without a required value go. Column pruning reaches the scan."""
    kinds = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    rows = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds])
    return rows.na.drop(subset=list(required)) if required else rows


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def latest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The entry of the folder whose name holds the largest stamp; of those without, the one changed last."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = []
    for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = s.getPath().getName()
        m = re.search(pattern, name)
        found.append((m is not None, m[1] if m else "", s.getModificationTime(), s.getPath().toString()))
    if not found:
        raise FileNotFoundError(folder)
    return max(found)[-1]


def result_set(df: DataFrame, column: str) -> DataFrame:
    """One row per row of {"headers": [...], "rowSet": [[...]]}, as a map from header to text; the other columns stay."""
    parsed = F.from_json(column, "headers array<string>, rowSet array<array<string>>")
    rows = df.withColumn("__p", parsed)
    others = [c for c in df.columns if c != column]
    return rows.select(*others, "__p.headers", F.explode("__p.rowSet").alias("__r")).select(*others, F.map_from_arrays("headers", "__r").alias("row"))


def fresh(df: DataFrame, fetched: str, now: Column, ttl: str) -> DataFrame:
    """Rows that haven't outlived their time."""
    return df.where(F.col(fetched) >= now - F.expr(f"interval {ttl}"))


def first_of(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each key the row of the first source that has it."""
    from pyspark.sql import Window

    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("__p", F.lit(k))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    best = Window.partitionBy(*keys).orderBy("__p")
    return both.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__p", "__r")
