"""Exports, experiment records and a cache of computed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, columns: Sequence[str], one_file: bool = False) -> None:
    """CSV with a header. One file only where the caller knows that the result is small."""
    out = df.select(*columns)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def player_export(sims: DataFrame) -> DataFrame:
    """Rows of simulated stats -> mean, spread and intervals of each player."""
    q = [0.025, 0.975, 0.005, 0.995]
    out = sims.groupBy("game", "team", "player").agg(F.round(F.avg("sim_pts"), 1).alias("pts_mean"), F.round(F.stddev_pop("sim_pts"), 2).alias("pts_std"), F.percentile("sim_pts", q).alias("q"), F.avg(F.col("active").cast("double")).alias("played"))
    return out.select("game", "team", "player", "pts_mean", "pts_std", "played", *[F.col("q")[k].alias(n) for k, n in enumerate(("ci_low", "ci_high", "ci99_low", "ci99_high"))])


class Experiments:
    """Append-only records of runs: name, status, seconds and a map of metrics, as JSON lines."""

    SCHEMA = "run string, name string, status string, seconds double, metrics map<string,double>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, run: str, name: str, status: str, seconds: float, metrics: dict[str, float]) -> None:
        row = [(run, name, status, float(seconds), {k: float(v) for k, v in metrics.items()})]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def best(self, metric: str, low: bool = True) -> DataFrame:
        rows = self.all().where(F.col("metrics")[metric].isNotNull())
        return rows.orderBy(F.col("metrics")[metric] if low else F.desc(F.col("metrics")[metric]), "run").limit(1)

    def compare(self, metrics: Sequence[str]) -> DataFrame:
        return self.all().select("run", "name", *[F.col("metrics")[m].alias(m) for m in metrics])

    def summary(self) -> DataFrame:
        return self.all().agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.avg("seconds").alias("mean_seconds"))


class FrameCache:
    """Frames written as Parquet under a key of their plan; a later call with the same plan reads them."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.hits = self.misses = 0

    def key(self, df: DataFrame, name: str) -> str:
        return hashlib.md5(f"{name}|{df.semanticHash()}|{df.schema.json()}".encode()).hexdigest()

    def get_or_compute(self, df: DataFrame, name: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        spark, at = df.sparkSession, f"{self.path}/{self.key(df, name)}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            self.hits += 1
        else:
            self.misses += 1
            compute(df).write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
