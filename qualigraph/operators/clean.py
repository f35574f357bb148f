"""Versioned cleaning transforms, their audit log, and its replay."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.functions import text

FORMAT_VERSION = 1
BATCH_SIZE = 1024
KINDS = {"trim": 1, "uppercase": 1, "lowercase": 1, "replace": 1}


@dataclass(frozen=True)
class Transform:
    kind: str
    column: str
    needle: str | None = None
    replacement: str | None = None
    version: int = 1

    def __post_init__(self):
        if self.kind not in KINDS or self.version != KINDS[self.kind]:
            raise ValueError(f"unknown transform {self.kind}@{self.version}")
        if self.kind == "replace" and (not self.needle or self.replacement is None):
            raise ValueError("replace needs a needle and a replacement")
        if self.kind != "replace" and (self.needle is not None or self.replacement is not None):
            raise ValueError(f"{self.kind} takes no parameters")

    def of(self, c: Column) -> Column:
        if self.kind == "trim":
            return text.trim(c)
        if self.kind == "uppercase":
            return text.upper_ascii(c)
        if self.kind == "lowercase":
            return text.lower_ascii(c)
        return text.replace_all(c, self.needle, self.replacement)


def params_hash(transforms: list[Transform]) -> str:
    return hashlib.sha256(json.dumps([asdict(t) for t in transforms], sort_keys=True).encode()).hexdigest()


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def schema_hash(schema: T.StructType) -> str:
    return f"{fnv1a(json.dumps([[f.name, f.dataType.simpleString(), f.nullable] for f in schema.fields]).encode()):016x}"


def clean(df: DataFrame, transforms: list[Transform]) -> DataFrame:
    """All transforms in order, as one projection."""
    made = {f.name: F.col(f"`{f.name}`") for f in df.schema.fields}
    for t in transforms:
        if not isinstance(df.schema[t.column].dataType, T.StringType):
            raise ValueError(f"{t.column} holds no text")
        made[t.column] = t.of(made[t.column])
    return df.select(*[c.alias(name) for name, c in made.items()])


def audit(df: DataFrame, transforms: list[Transform], offset: str, run_id: str, source_id: str, source_version: int = 0, batch_size: int = BATCH_SIZE) -> DataFrame:
    """One entry a batch: what was applied to which rows of which source."""
    batch = F.floor(F.col(offset) / batch_size).cast("long").alias("batch_id")
    rows = df.groupBy(batch).agg(F.min(offset).cast("long").alias("first_row"), (F.max(offset) + 1).cast("long").alias("end_row"), F.count("*").alias("row_count"))
    fixed = {
        "format_version": F.lit(FORMAT_VERSION),
        "run_id": F.lit(run_id),
        "source_id": F.lit(source_id),
        "source_version": F.lit(source_version).cast("long"),
        "transforms": F.lit(",".join(f"{t.kind}@{t.version}:{t.column}" for t in transforms)),
        "params_hash": F.lit(params_hash(transforms)),
        "schema_hash": F.lit(schema_hash(df.schema)),
    }
    return rows.select("batch_id", "first_row", "end_row", "row_count", *[c.alias(k) for k, c in fixed.items()])


def replay(df: DataFrame, log: DataFrame, transforms: list[Transform], offset: str, source_id: str, source_version: int = 0, batch_size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, problems): the recorded transforms applied again, and what in the log doesn't fit.

    Problems: (batch_id, problem). The log and the source's batches meet in a full outer join of one row a batch.
    """
    want = audit(df, transforms, offset, "", source_id, source_version, batch_size)
    runs = log.agg(F.count_distinct("run_id").alias("runs"))
    met = want.alias("w").join(log.alias("l"), F.col("w.batch_id") == F.col("l.batch_id"), "full_outer").join(F.broadcast(runs))
    differs = lambda c: ~F.col(f"w.{c}").eqNullSafe(F.col(f"l.{c}"))
    problem = F.when(F.col("l.batch_id").isNull(), "missing_entry").when(F.col("w.batch_id").isNull(), "extra_entry").when(F.col("runs") > 1, "several_runs")
    for name in ("format_version", "params_hash", "source_id", "source_version", "schema_hash", "first_row", "end_row"):
        problem = problem.when(differs(name), f"{name}_differs")
    found = met.select(F.coalesce("w.batch_id", "l.batch_id").alias("batch_id"), problem.alias("problem")).where("problem is not null")
    return clean(df, transforms), found
