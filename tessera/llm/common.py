"""Shared helpers: reading tables, durable cut points, whole-text batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at a time; one longer text is taken alone, whole.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to Python at a time; SLICE_BYTES bounds what is worked on.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def _written(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: no executor's loss can undo it, and its values are fixed.

    The shuffles behind it are done with. Spark deletes the files of those that the driver no longer holds, so df is let go of
    here, before the driver's garbage is collected.
    """
    spark, schema = df.sparkSession, df.schema
    path = _written(df, name)
    del df
    _freed(spark)
    return spark.read.schema(schema).parquet(path)


def _freed(spark: SparkSession) -> None:
    """Collect the driver's garbage: Python's first, which holds Spark's frames in cycles, then the JVM's, which holds shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Cut points of one operator; those not dropped before are dropped at the end, when its result has been written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.held.copy())

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        schema, path = df.schema, _written(df, name)
        del df
        _freed(self.spark)
        found = self.spark.read.schema(schema).parquet(path)
        self.held[id(found)] = found
        return found

    def drop(self, *frames) -> None:
        """Delete the files of frames that nothing will read again."""
        for frame in frames:
            found = self.held.pop(frame if isinstance(frame, int) else id(frame), None)
            if found is not None:
                folder = found.inputFiles()
                for at in {x.rpartition("/")[0] for x in folder}:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together hold about ``most`` bytes; no text is split or shortened."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def same(left: DataFrame, right: DataFrame, *names: str):
    """Equality of the named columns in which nulls are equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_of(df: DataFrame, *without: str):
    """All columns of df but these, as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without))


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema in DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
