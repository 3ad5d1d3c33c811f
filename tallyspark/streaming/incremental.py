"""Incremental ingest and running calibration with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import upsert


class VersionedTable:
    """A Parquet table that micro-batches upsert into: each version is written whole, then noted as done.

    The notes lie beside the data, so a new driver goes on from the last version. A batch that runs again starts from
    the version before its own and overwrites that, so a lost executor or driver leaves no half state.
    """

    def __init__(self, spark, path: str, keys: Sequence[str], order: str) -> None:
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), order

    def version(self, before: int | None = None) -> int | None:
        """The newest version done, of those before a batch if it's given; None if there's none."""
        try:
            done = self.spark.read.schema("version long").parquet(f"{self.path}/done")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return done.where(F.lit(True) if before is None else F.col("version") < before).agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            raise ValueError(f"no version has been written to {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last = self.version(batch_id)
        rows = upsert(batch.limit(0) if last is None else self.read(last), batch, self.keys, self.order)
        rows.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        self.spark.range(batch_id, batch_id + 1, numPartitions=1).toDF("version").write.mode("append").parquet(f"{self.path}/done")


def run_upsert(stream: DataFrame, target: VersionedTable, checkpoint: str) -> DataFrame:
    query = stream.writeStream.foreachBatch(target.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return target.read()


def windowed_errors(stream: DataFrame, time: str, error: str, length: str = "30 days", step: str = "1 day", late: str = "30 days") -> DataFrame:
    """Count and mean error of sliding windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, step)).agg(F.count("*").alias("n"), F.sum(error).alias("total"))


def tumbling(stream: DataFrame, time: str, value: str, length: str) -> DataFrame:
    return stream.withWatermark(time, length).groupBy(F.window(time, length)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    return stream.withWatermark(time, gap).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def running_bias(stream: DataFrame, key: str, error: str, weight: float = 0.4):
    """The exponentially updated error of each key: state is one number a key, updated batch by batch."""
    import pandas as pd

    def update(k, frames, state):
        bias, n = state.get if state.exists else (0.0, 0)
        for pdf in frames:
            for e in pdf.sort_values("__t")[error]:
                bias, n = (1 - weight) * bias + weight * float(e), n + 1
        state.update((bias, n))
        yield pd.DataFrame({key: [k[0]], "bias": [bias], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, bias double, n long", "bias double, n long", "update", "NoTimeout")
