"""Incremental modes: rules, uniqueness, audit and store appends over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from qualigraph.operators import clean, graph, validate
from qualigraph.operators.lineage import exists
from qualigraph.plans.store import Store


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder, a bounded number a trigger."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def row_violations(stream: DataFrame, rules: list[validate.Rule], offset: str) -> DataFrame:
    """Violations of rules that look at one row; they need no state."""
    if any(r.tag == "unique" for r in rules):
        raise validate.RuleError("uniqueness needs state; use first_occurrences")
    return validate.violations(stream, rules, offset)


def first_occurrences(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def clean_into(stream: DataFrame, transforms: list[clean.Transform], offset: str, rows: str, log: str, checkpoint: str, run_id: str, source_id: str) -> StreamingQuery:
    """Append cleaned rows and their audit entries. A batch that is repeated after a failure overwrites its own folder, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        clean.clean(batch, transforms).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        clean.audit(batch, transforms, offset, run_id, source_id).write.mode("overwrite").json(f"{log}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def append_objects(stream: DataFrame, mapping: graph.Mapping, path: str, checkpoint: str) -> StreamingQuery:
    """Append the objects of a stream of records that the store at `path` doesn't have; resumes where it stopped."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = graph.objects(graph.split(batch, mapping)[0], mapping)
        shape = T.StructType().add("object_id", "string").add("object_type", "string").add("canonical_key", "string").add("batch", "integer")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        old = spark.read.schema(shape).parquet(path).where(F.col("batch") != number) if there else spark.createDataFrame([], shape)
        graph.insert_if_absent(old.drop("batch"), new, "object_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def import_records(stream: DataFrame, mapping: graph.Mapping, store: Store, checkpoint: str, source_id: str, run_id: str, offset: str, contract: graph.SourceContract | None = None) -> StreamingQuery:
    """Map a stream of records into a store; a restart goes on after the last batch that was committed.

    Rows are appended by id, so a batch that is repeated after a failure adds only what is missing.
    A checkpoint belongs to one source and one run: another one is refused.
    """
    spark, note = store.spark, f"{checkpoint.rstrip('/')}-of"
    if exists(spark, note):
        known = spark.read.schema("source_id string, run_id string").json(note).first()
        if (known.source_id, known.run_id) != (source_id, run_id):
            raise ValueError(f"the checkpoint is of source {known.source_id} and run {known.run_id}")
    else:
        spark.createDataFrame([(source_id, run_id)], "source_id string, run_id string").coalesce(1).write.json(note)

    def write(batch: DataFrame, number: int) -> None:
        store.load(batch, mapping, offset, run_id, contract)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
