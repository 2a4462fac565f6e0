"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship


#: Rows that a scan decodes at once where the session says nothing: texts are long.
READ_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if READ_ROWS[0] not in spark.conf.getAll:
        spark.conf.set(*READ_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all run in one
    process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, *by: str) -> str:
    """Writes df to the shared folder, in a folder a value of `by`; its path. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows that are sent to every task at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of one file, where their number can be told before.
FILE_ROWS = 20_000


def sided(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that has so many rows: sent to every task if they are few, else merged."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, keeps column pruning.

    rows: about how many there are; they go to as many files as that asks for, at most as many as a shuffle has parts.
    """
    if rows is not None:
        df = df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))))
    path = written(df)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._step = path
    return held


def release(*held: DataFrame) -> None:
    """Deletes what materialize wrote for these, once all that was made of them is written too."""
    for df in held:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._step)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """What is free goes back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """run over a task's batches, then give_back."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def schema_with(df: DataFrame, kept: list[str], extra: str) -> T.StructType:
    """The fields of df's columns kept, then those of a DDL string; any column name will do."""
    return T.StructType([*(df.schema[c] for c in kept), *T.StructType.fromDDL(extra)])


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about size bytes of one text column, a row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    start = done = 0
    for i, end in enumerate(ends.tolist()):
        if end - done >= size or i == len(ends) - 1:
            yield batch.slice(start, i + 1 - start)
            start, done = i + 1, end


def sample_per_label(known: DataFrame, label: str, key: str, per: int, total: int) -> DataFrame:
    """Of each label the `per` rows of smallest key hash; of very many labels fewer each, so that all have some and there
    are about `total` rows at most.

    A threshold on the hash, from the label's count, first leaves about twice as many, so a frequent label is never
    ranked as a whole.
    """
    counts = materialize(known.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    labels = counts.count()
    per = max(1, min(per, total // max(1, labels)))
    h = F.xxhash64(key, F.lit(2))
    near = known.join(sided(counts, labels), F.col(label) == F.col("_y")).filter(F.pmod(h, F.lit(1 << 40)) * F.col("_n").cast("decimal(20,0)") < F.lit((2 * per + 20) << 40).cast("decimal(38,0)"))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy(F.pmod(h, F.lit(1 << 40)), key)))
    return ranked.filter(F.col("_r") <= per).select(*known.columns)
