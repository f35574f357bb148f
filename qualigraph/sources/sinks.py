"""Sinks: CSV, JSON Lines, envelopes, memory, null, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT_VERSION = 1


def as_text(c: Column, kind: T.DataType) -> Column:
    """The exact text of a value: ISO dates, UTC times with Z (a time without a zone is taken as UTC), plain decimals.

    Years outside 0 to 9999 have no such text and raise.
    """
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        far = F.raise_error(F.concat(F.lit("no ISO text for "), c.cast("string"))).cast("string")
        utc = F.to_utc_timestamp(c, F.current_timezone()) if isinstance(kind, T.TimestampType) else c
        shown = F.date_format(utc, "yyyy-MM-dd" if isinstance(kind, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.when(F.year(utc).between(0, 9999), shown).when(c.isNotNull(), far)
    return c.cast("string")


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows, quotes where needed. Null and the empty text are both empty, as in the format."""
    df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value` of JSON objects; dates, times and decimals as text, non-finite numbers raise."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType):
            c = as_text(c, f.dataType)
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite")).cast("double")).otherwise(c)
        parts.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def envelopes(df: DataFrame, source_id: str, run_id: str, observed_at: str, offset: str = "_offset", batch_size: int = 1024, start: int = 0, rows: int | None = None) -> DataFrame:
    """(line): each record in an envelope that says where it comes from."""
    names = [c for c in df.columns if c != offset]
    at = F.col(offset)
    kept = df.where(at >= start) if rows is None else df.where((at >= start) & (at < start + rows))
    source = F.struct(F.lit(source_id).alias("source_id"), F.floor(at / batch_size).cast("long").alias("batch_id"), (at % batch_size).alias("row_id"), at.alias("global_offset"), F.lit(observed_at).alias("observed_at"))
    whole = F.struct(F.lit(CONTRACT_VERSION).alias("contract_version"), F.struct(*names).alias("record"), source.alias("source"), F.lit(run_id).alias("run_id"))
    return kept.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("line"))


def read_envelopes(lines: DataFrame, record: T.StructType, column: str = "value", longest: int = 1 << 20) -> DataFrame:
    """The envelopes of JSON lines; a line that is too long, malformed or of another contract raises."""
    source = T.StructType().add("source_id", "string").add("source_version", "string").add("batch_id", "long").add("row_id", "long").add("global_offset", "long").add("observed_at", "string").add("checksum", "string")
    shape = T.StructType().add("contract_version", "integer").add("record", record).add("source", source).add("run_id", "string")
    checked = F.when(F.octet_length(column) > longest, F.raise_error(F.lit("an envelope is too long"))).otherwise(F.col(column))
    out = lines.select(F.from_json(checked, shape, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    fine = (F.col("contract_version") == CONTRACT_VERSION) & F.col("source.source_id").isNotNull() & F.col("run_id").isNotNull()
    return out.withColumn("contract_version", F.when(fine, F.col("contract_version")).otherwise(F.raise_error(F.lit("not an envelope of this contract"))))


def to_memory(df: DataFrame, most_rows: int, most_bytes: int | None = None, schema: T.StructType | None = None) -> list:
    """All rows, or an error if there are more than `most_rows` or more than `most_bytes` of values; never more than one row beyond is fetched.

    A schema other than the one expected is an error too.
    """
    if schema is not None and [(f.name, f.dataType) for f in df.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
        raise ValueError("the rows have another schema")
    few = df.limit(most_rows + 1)
    if most_bytes is not None:
        size = few.agg(F.sum(payload(few))).first()[0] or 0
        if size > most_bytes:
            raise OverflowError(f"more than {most_bytes} bytes")
    rows = few.collect()
    if len(rows) > most_rows:
        raise OverflowError(f"more than {most_rows} rows")
    return rows


def payload(df: DataFrame) -> Column:
    """Bytes of a row's values: those of texts, and the width of others; nulls have none."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        wide = F.octet_length(c) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.when(c.isNotNull(), {T.BooleanType: 1, T.DateType: 4, T.IntegerType: 4, T.FloatType: 4, T.DecimalType: 16}.get(type(f.dataType), 8))
        size = size + F.coalesce(wide, F.lit(0))
    return size.cast("long")


def measured(df: DataFrame, sink, batch_size: int = 1024) -> dict:
    """Run `sink(df)` and return its metrics: rows, batches, bytes of values, seconds and rates, from one pass."""
    import time

    from pyspark.sql import Observation

    seen, began = Observation(), time.perf_counter()
    sink(df.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(payload(df)), F.lit(0)).alias("bytes"), F.coalesce(F.max(payload(df)), F.lit(0)).alias("largest_row_bytes")))
    took, found = max(time.perf_counter() - began, 1e-9), seen.get
    return found | {"batches": -(-found["rows"] // batch_size), "seconds": took, "rows_per_second": found["rows"] / took, "bytes_per_second": found["bytes"] / took}


def nowhere(df: DataFrame) -> None:
    """Run the plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def count_only(df: DataFrame) -> int:
    """Run the plan, keep nothing, and return the number of rows."""
    return measured(df, nowhere)["rows"]


def write_violations(found: DataFrame, path: str, most: int | None = None) -> int:
    """Write violations as JSON Lines, the first `most` in row and rule order if given; return how many there are."""
    total = found.count()
    kept = found.orderBy("offset", "ordinal", "code").limit(most) if most is not None else found
    kept.write.mode("overwrite").json(path)
    return total


def write_matches(matches: DataFrame, path: str, most: int = 100) -> int:
    """Write the first `most` matches by both ids as JSON Lines; return how many there are."""
    total = matches.count()
    matches.orderBy("candidate_id", "reference_id").limit(most).write.mode("overwrite").json(path)
    return total


def write_audit(entries: DataFrame, path: str) -> None:
    """Write audit entries as JSON Lines in the order of batches, one entry a batch; a batch with two entries is an error."""
    once = F.when(F.count("*") == 1, F.first("value")).otherwise(F.raise_error(F.concat(F.lit("two entries for batch "), F.first("batch_id").cast("string"))).cast("string"))
    lines = entries.select("batch_id", F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.groupBy("batch_id").agg(once.alias("value")).repartitionByRange("batch_id").sortWithinPartitions("batch_id").select("value").write.mode("overwrite").text(path)
