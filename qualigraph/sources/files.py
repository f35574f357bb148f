"""CSV, JSON Lines and JDBC readers; file versions and hashes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY = "\u0001"  # stands for "" while Spark's reader would make it null
MOST_RECORD_BYTES = 16 << 20
#: Lines in which a header has to end.
HEADER_LINES = 64


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Capabilities:
    replayable: bool
    seekable: bool
    bounded: bool
    schema_known: bool


FILES = Capabilities(True, False, True, True)
JDBC = Capabilities(False, False, False, True)


@dataclass(frozen=True)
class Source:
    """Rows and what is known of where they come from; all kinds of input look alike from here on."""

    rows: DataFrame
    capabilities: Capabilities
    path: str | None = None

    @property
    def schema(self) -> T.StructType:
        return self.rows.schema

    def identity(self) -> DataFrame:
        if self.path is None:
            raise SourceError("only files have an identity")
        return identity(self.rows.sparkSession, self.path)

    def bytes(self) -> int:
        """The size of the files."""
        return self.rows.sparkSession.read.format("binaryFile").load(self.path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def source(spark: SparkSession, kind: str, path: str, **options) -> Source:
    """A source of `kind` csv, csv_strict, jsonl, parquet or jdbc (`path` is its URL then)."""
    if kind == "jdbc":
        return Source(read_jdbc(spark, path, **options), JDBC)
    readers = {"csv": read_csv, "csv_strict": read_csv_strict, "jsonl": read_jsonl, "parquet": lambda spark, path: spark.read.parquet(path)}
    if kind not in readers:
        raise SourceError(f"unknown kind of source {kind}")
    return Source(readers[kind](spark, path, **options), FILES, path)


def split_record(line: str, delimiter: str = ",", quote: str = '"') -> list[str | None]:
    """Fields of one record by the strict grammar: an unquoted empty field is null, a quoted one ''."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == quote:
            i, parts = i + 1, []
            while True:
                j = line.find(quote, i)
                if j < 0:
                    raise SourceError("UnterminatedQuotedField")
                parts.append(line[i:j])
                i = j + 1
                if i < n and line[i] == quote:
                    parts.append(quote)
                    i += 1
                    continue
                break
            if i < n and line[i] != delimiter:
                raise SourceError("CharactersAfterClosingQuote")
            out.append("".join(parts))
        else:
            j = line.find(delimiter, i)
            j = n if j < 0 else j
            if quote in line[i:j]:
                raise SourceError("UnexpectedQuote")
            out.append(line[i:j] or None)
            i = j
        if i >= n:
            return out
        i += 1


def header(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> list[str]:
    """Names of the first record, as they stand; empty and repeated names are errors."""
    lines = [r[0] for r in spark.read.text(path).limit(HEADER_LINES).collect()]
    if not lines:
        raise SourceError("EmptySource")
    record = lines[0]
    for line in lines[1:]:  # a quoted name may go on in the next line
        if record.count(quote) % 2 == 0:
            break
        record = f"{record}\n{line}"
    names = split_record(record.removesuffix("\r"), delimiter, quote)
    if not all(names):
        raise SourceError("EmptyHeaderName")
    if len(set(names)) != len(names):
        raise SourceError("DuplicateHeaderName")
    return names


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', malformed: str = "fail") -> DataFrame:
    """All columns as text; multi-line quoted fields allowed; null and '' kept apart.

    `malformed`: fail, skip or pad (short rows padded with nulls, long ones cut). Spark's parser
    is lenient about quotes in odd places; `read_csv_strict` is not.
    """
    names = header(spark, path, delimiter, quote)
    shape = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(shape).options(header=True, sep=delimiter, quote=quote, escape=quote, multiLine=True, emptyValue=_EMPTY, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True).csv(path)
    # Spark refuses to read the corrupt record alone, as a bare count would
    whole = F.octet_length(F.concat_ws("", *[F.col(f"`{c}`") for c in names])) >= 0
    if malformed == "skip":
        raw = raw.where(F.col("_corrupt").isNull() & whole)
    elif malformed == "fail":
        raw = raw.withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("malformed record: "), "_corrupt"))).cast("string")).where(F.col("_corrupt").isNull() & whole)
    elif malformed != "pad":
        raise SourceError(f"unknown policy {malformed}")
    return raw.select(*[F.when(F.col(f"`{c}`") == _EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in names])


def _records(content: bytes, quote: bytes):
    """The records of a file as bytes: a line ends one unless a quoted field is open. Each byte is looked at a fixed number of times."""
    at, start, quotes = 0, 0, 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        quotes += content.count(quote, at, end)
        at = end + 1
        if quotes % 2 and at < len(content):
            continue
        yield content[start:end].removesuffix(b"\r")
        start, quotes = at, 0


def read_csv_strict(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', malformed: str = "fail", extra: str = "fail", missing: str = "fail", most_bytes: int = MOST_RECORD_BYTES, invalid_utf8: str = "fail") -> DataFrame:
    """The strict grammar, record by record, in one task a file: such files can't be split safely.

    `malformed` fail or skip, `extra` fail or ignore, `missing` fail or pad, `invalid_utf8` fail or allow
    (U+FFFD stands for bytes that are no text); skipping malformed records skips those with such
    bytes too, unless they are allowed. A blank line is a row of nulls. Files of 2 GB at most.
    """
    for name, value, known in (("malformed", malformed, ("fail", "skip")), ("extra", extra, ("fail", "ignore")), ("missing", missing, ("fail", "pad")), ("invalid_utf8", invalid_utf8, ("fail", "allow"))):
        if value not in known:
            raise SourceError(f"unknown policy {name}={value}")
    names = header(spark, path, delimiter, quote)
    shape = T.StructType([T.StructField(c, T.StringType()) for c in names])
    files = spark.read.format("binaryFile").load(path).select("content")

    def fields_of(record: bytes) -> list[str | None] | None:
        try:
            if len(record) > most_bytes:
                raise SourceError("RecordTooLarge")
            return split_record(record.decode("utf-8", "strict" if invalid_utf8 == "fail" else "replace"), delimiter, quote)
        except (SourceError, UnicodeDecodeError) as e:
            if malformed == "skip":
                return None
            raise SourceError("InvalidUtf8") if isinstance(e, UnicodeDecodeError) else e

    def read(batches):
        import pyarrow as pa

        def batch_of(rows):
            return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for n, record in enumerate(_records(content.as_py(), quote.encode())):
                    fields = fields_of(record) if n else None  # the first record is the header
                    if fields is None:
                        continue
                    if len(fields) > len(names) and extra == "fail":
                        raise SourceError("ExtraColumns")
                    if len(fields) < len(names) and missing == "fail" and record:
                        raise SourceError("MissingColumns")
                    rows.append((fields + [None] * len(names))[: len(names)])
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read, shape)


def json_type(value) -> T.DataType:
    """The type of a value of the first object."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):  # too great for 64 bits: the text is kept, not a rounded number
        return T.LongType() if -(1 << 63) <= value < 1 << 63 else T.StringType()
    if isinstance(value, float):
        return T.DoubleType()
    if value is None or isinstance(value, str):
        return T.StringType()
    raise SourceError("NestedJsonValueUnsupported")


def read_jsonl(spark: SparkSession, path: str, unknown: str = "fail") -> DataFrame:
    """Flat objects, one a line; the first object's keys, in its order, and types are the schema.

    A value of another type and nested values raise; missing keys are null. `unknown`: fail or ignore further keys.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.limit(1).collect()
    if not first:
        raise SourceError("EmptySource")
    kinds = {k: json_type(v) for k, v in json.loads(first[0][0]).items()}
    shape = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    value = F.col("value")
    if unknown == "fail":
        keys = F.json_object_keys("value")
        value = F.when(F.size(F.array_except(keys, F.array(*map(F.lit, kinds)))) > 0, F.raise_error(F.concat(F.lit("UnknownJsonField: "), "value"))).otherwise(value)
    return lines.select(F.from_json(value, shape, {"mode": "FAILFAST"}).alias("r")).select("r.*")


_KEEP = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's result: booleans, whole and floating numbers keep their kind, all else is text."""
    raw = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return narrowed(raw)


def narrowed(raw: DataFrame) -> DataFrame:
    out = []
    for f in raw.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = "boolean" if isinstance(f.dataType, T.BooleanType) else "double" if isinstance(f.dataType, T.FloatType | T.DoubleType) else "bigint" if isinstance(f.dataType, _KEEP) else "string"
        out.append(c.cast(kind).alias(f.name))
    return raw.select(*out)


def identity(spark: SparkSession, path: str) -> DataFrame:
    """(uri, source_version, content_sha256): what changes when a file changes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("uri"), F.xxhash64("path", "length", "modificationTime").alias("source_version"), F.sha2("content", 256).alias("content_sha256"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns under other names; a column that has none, and a name without its column, are errors."""
    if unknown := sorted(set(df.columns) - set(names)):
        raise SourceError(f"UnknownColumns: {', '.join(unknown)}")
    if absent := sorted(set(names) - set(df.columns)):
        raise SourceError(f"MissingColumns: {', '.join(absent)}")
    return df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns])


def preview(df: DataFrame, rows: int = 50) -> tuple[list, bool]:
    """The first rows and whether there are more."""
    found = df.limit(rows + 1).collect()
    return found[:rows], len(found) > rows
