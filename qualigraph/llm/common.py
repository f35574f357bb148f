"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualigraph.operators.lineage import shared_folder

#: Characters that end a word in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set in a single process (tests)."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark removes the files once the frame is unreachable if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`, within one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, as a URI that every executor can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    uri = store.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch(spark: SparkSession, kind: str) -> str:
    """A new shared folder that goes when the driver ends, or earlier by `drop_folder`."""
    path = new_folder(spark, kind)
    _spilled[path] = spark
    return path


def lean(function):
    """`function` of batches, with its memory given back to the system when a task ends.

    A Python worker lives on after its task and would keep what its largest batch took, next to
    the workers and the JVM of the stages that follow.
    """

    def each(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other systems do it themselves
            if trim is not None:
                trim(0)

    return each


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `size` bytes of a text column at most, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            # a copy: not all Arrow kernels read slices rightly
            yield batch if upto - at == batch.num_rows else batch.take(pa.array(np.arange(at, upto)))
            at = upto


def may_be_among(df: DataFrame, values: DataFrame, name: str, bits: int, flag: str) -> DataFrame:
    """`df` with a boolean `flag`: false where `name` is surely not among those of `values`.

    A bitmap of `bits` bits, bits / 64 rows at most, is broadcast; so most rows that an exact
    join would drop (or leave alone) need not be shuffled for it.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = values.select(bit(F.col(name)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_marks"))
    met = df.withColumn("_bit", bit(F.col(name))).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    return met.withColumn(flag, F.expr("coalesce((shiftrightunsigned(_marks, cast(_bit & 63 as int)) & 1) = 1, false)")).drop("_bit", "_word", "_marks")


def marked(df: DataFrame, values: DataFrame, name: str, bits: int) -> DataFrame:
    """The rows of `df` whose `name` may be among those of `values`."""
    return may_be_among(df, values, name, bits, "_may").where("_may").drop("_may")


def spill(df: DataFrame, kind: str) -> DataFrame:
    """Write a large table to the shared folder as compressed Parquet and read it from there.

    Smaller than a checkpoint; the files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spill_path = path
    return out


def drop_spill(df: DataFrame) -> None:
    """Delete what `spill` wrote; nothing that still reads it may follow."""
    drop_folder(df._spill_path)


_spilled: dict[str, SparkSession] = {}


def drop_folder(path: str) -> None:
    """Delete a folder of `scratch` and all in it."""
    spark = _spilled.pop(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_spilled() -> None:
    for path in list(_spilled):
        try:
            drop_folder(path)
        except Exception:  # the session has ended and its files with it, or the store is gone
            return
