"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch carries to Python, about: many short rows, or one long text.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of Python stages by bytes; leave a smaller setting alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: this operator needs a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "tallyspark-checkpoints")


_written: dict[str, None] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which ends its lineage.

    The files stay until discard() or release(): a later stage that runs again reads them. The shuffles
    of the write are deleted as it ends, since nothing reads them any more.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written[path] = None
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in cuts:
        _delete(df.sparkSession, df._cut_path)


def release(spark: SparkSession) -> None:
    """Delete what cut() has written in this process; for after the results are stored."""
    for path in [*_written]:
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(labels: DataFrame, limit: int, *keep) -> DataFrame:
    """At most `limit` labelled rows, the smallest by a hash of doc_id; one row per doc_id.

    A classifier is fitted on these; the bound is the caller's documented parameter.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    for condition in keep:
        rows = rows.where(condition)
    return (
        rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def with_arrow_columns(df: DataFrame, fields: str, compute) -> DataFrame:
    """df and the columns that compute(batch) returns as Arrow arrays, one for each field of the DDL `fields`.

    Input columns of the same name, whatever their case, give way to the new ones.
    """
    from pyspark.sql import types as T

    added = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in added}
    through = [i for i, f in enumerate(df.schema) if f.name.lower() not in taken]
    schema = T.StructType([df.schema[i] for i in through] + list(added))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i) for i in through] + list(compute(batch))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


#: Bytes that a join may broadcast, after they are summed.
BROADCAST_BYTES = 8_000_000


def light(df: DataFrame, *lists: str) -> DataFrame:
    """df marked for broadcast if its rows are small together; else unmarked, for a shuffled join. df should be cut: it's summed up.

    A row counts 16 bytes a column, and 16 for each item of the named list columns.
    """
    size = F.lit(16 * len(df.columns))
    for name in lists:
        size = size + 16 * F.greatest(F.size(name), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: Words (64 bits) of a bit table: 8 MB, whatever the data's size.
TABLE = 1 << 20


def bit_places(hashes, words: int):
    """The word and the bit of each 64-bit hash in a bit table."""
    import numpy as np

    return ((hashes >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), hashes & np.uint64(63)


def bit_table(df: DataFrame, hashes, words: int = TABLE):
    """A table of fixed size, a power of two of 64-bit words, with the bits of hashes(batch), an array of 64-bit hashes for each batch of df, set.

    It only lets rows through early: others may share a bit, so what passes still has to be joined.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        held = np.zeros(words, np.uint64)
        for batch in batches:
            if batch.num_rows:
                word, bit = bit_places(hashes(batch), words)
                np.bitwise_or.at(held, word, np.uint64(1) << bit)
        word = np.flatnonzero(held)
        for k in range(0, len(word), 1 << 16):
            part = word[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part].view(np.int64))], names=["word", "bits"])

    rows = df.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def in_table(held, hashes):
    """Which of the hashes may be in the table."""
    word, bit = bit_places(hashes, len(held))
    return (held[word] >> bit) % 2 == 1
