"""Column profiles: one aggregation over the input, then one row a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.functions.text import PATTERNS
from qualigraph.operators.clean import schema_hash
from qualigraph.operators.lineage import checkpointed, spread

EXACT_DISTINCT = 10_000
PATTERN_ROWS = 4096
PATTERN_SHARE = 0.9


def _numeric(c: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        return c.cast("double")
    return None


def _stack(one: DataFrame, n: int) -> DataFrame:
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(n)])).alias("s")).select("s.*")


def nulls(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, null_rate); the rate of an empty input is 0."""
    parts = []
    for i, name in enumerate(df.columns):
        missing = F.count("*") - F.count(F.col(f"`{name}`"))
        rate = F.coalesce(missing / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
        parts.append(F.struct(F.lit(name).alias("column_name"), F.count("*").alias("row_count"), missing.alias("null_count"), rate.alias("null_rate")).alias(f"_{i}"))
    return _stack(df.agg(*parts), len(parts))


def numbers(df: DataFrame) -> DataFrame:
    """(column_name, min, max, mean, variance) of numeric, date and time columns; the variance is the sample's."""
    parts = []
    for f in df.schema.fields:
        if (c := _numeric(F.col(f"`{f.name}`"), f.dataType)) is not None:
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance")).alias(f"_{len(parts)}"))
    return _stack(df.agg(*parts), len(parts))


def decimals(df: DataFrame) -> DataFrame:
    """(column_name, min, max) of decimal columns as exact text."""
    parts = [F.struct(F.lit(f.name).alias("column_name"), F.min(f"`{f.name}`").cast("string").alias("min"), F.max(f"`{f.name}`").cast("string").alias("max")) for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return _stack(df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]), len(parts))


def lengths(df: DataFrame) -> DataFrame:
    """(column_name, min, max, mean) of the bytes of text columns."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            n = F.octet_length(F.col(f"`{f.name}`")).cast("long")
            parts.append(F.struct(F.lit(f.name).alias("column_name"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean")).alias(f"_{len(parts)}"))
    return _stack(df.agg(*parts), len(parts))


def _sketch(c: Column) -> Column:
    """Distinct values by a HyperLogLog sketch of 2**14 registers: one binary buffer a column, where the built-in estimate keeps thousands of fields."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), F.lit(14))), F.lit(0)).cast("long")


def _exact_small(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct counts of columns known to have few values: sets in one pass, no row is expanded or shuffled."""
    if not columns:
        return {}
    one = df.agg(*[F.size(F.collect_set(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: one[f"_{i}"] for i, c in enumerate(columns)}


def distinct(df: DataFrame, columns: list[str] | None = None, exact_up_to: int = EXACT_DISTINCT) -> DataFrame:
    """(column_name, distinct_count, mode): exact up to a limit, a sketch's estimate beyond.

    A sketch decides first, in one pass with a few kilobytes of state a column; only columns
    that may stay within the limit are counted exactly, so sets stay small and no wide
    distinct is shuffled.
    """
    columns = columns or df.columns
    sketched = df.agg(*[_sketch(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    exact = _exact_small(df, [c for i, c in enumerate(columns) if sketched[f"_{i}"] <= exact_up_to * 1.1])
    rows = [(c, exact[c], "exact") if exact.get(c, exact_up_to + 1) <= exact_up_to else (c, sketched[f"_{i}"], "approximate") for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, distinct_count long, mode string")


def distinct_exact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, distinct_count), exact whatever the size."""
    columns = columns or df.columns
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(F.col(f"`{c}`")).alias("distinct_count")).alias(f"_{i}") for i, c in enumerate(columns)])
    return _stack(one, len(columns))


def distinct_sketch(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, distinct_count) from HyperLogLog sketches of 2**14 registers."""
    columns = columns or df.columns
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), _sketch(F.col(f"`{c}`")).alias("distinct_count")).alias(f"_{i}") for i, c in enumerate(columns)])
    return _stack(one, len(columns))


def patterns(df: DataFrame, column: str, order: str, rows: int = PATTERN_ROWS, share: float = PATTERN_SHARE) -> DataFrame:
    """(column_name, sampled, pattern): the best pattern of the first non-null values, if enough have it; ties go to the first in the list."""
    first = df.where(F.col(column).isNotNull()).orderBy(order).limit(rows)  # a top-k, not a window over all rows
    counts = [F.sum(PATTERNS[p](F.col(column)).cast("long")).alias(p) for p in PATTERNS]
    one = first.agg(F.count("*").alias("sampled"), *counts)
    best = F.greatest(*[F.col(p) for p in PATTERNS])
    name = F.coalesce(*[F.when((F.col(p) == best) & (best >= share * F.col("sampled")) & (best > 0), F.lit(p)) for p in PATTERNS])
    return one.select(F.lit(column).alias("column_name"), "sampled", name.alias("pattern"))


REPORT = (
    "column_name string, type string, row_count long, null_count long, null_rate double, distinct_count long, mode string, "
    "min double, max double, mean double, variance double, min_decimal string, max_decimal string, min_bytes long, max_bytes long, mean_bytes double, "
    "pattern string, batches long, schema_hash string"
)


def _best_pattern(row, i: int, share: float = PATTERN_SHARE) -> str | None:
    counts = {p: row[f"{p}{i}"] or 0 for p in PATTERNS}
    best = max(counts, key=lambda p: counts[p])  # the first in the list among equals
    return best if counts[best] and counts[best] >= share * row[f"sampled{i}"] else None


def report(df: DataFrame, exact_up_to: int = EXACT_DISTINCT, order: str | None = None, batch_size: int = 1024) -> DataFrame:
    """The whole profile, a row for each column: one pass for all statistics, a second for exact small distinct counts.

    Patterns are those of the first `PATTERN_ROWS` values by `order`, or of as many rows that come first in the plan.
    What comes to the driver are rows of aggregates.
    """
    source, df = df, spread(df)
    parts, nothing = [F.count("*").alias("rows")], F.lit(None)
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        n, exact, text = _numeric(c, f.dataType), isinstance(f.dataType, T.DecimalType), isinstance(f.dataType, T.StringType)
        size = F.octet_length(c).cast("long") if text else None
        parts += [F.count(c).alias(f"present{i}"), _sketch(c).alias(f"distinct{i}")]
        if n is not None:
            parts += [g(n).alias(f"{k}{i}") for k, g in (("min", F.min), ("max", F.max), ("mean", F.avg), ("variance", F.var_samp))]
        if exact:
            parts += [g(c).cast("string").alias(f"{k}_decimal{i}") for k, g in (("min", F.min), ("max", F.max))]
        if text:
            parts += [g(size).cast(kind).alias(f"{k}_bytes{i}") for k, g, kind in (("min", F.min, "long"), ("max", F.max, "long"), ("mean", F.avg, "double"))]
    one = df.agg(*parts).first()
    small = _exact_small(df, [f.name for i, f in enumerate(df.schema.fields) if one[f"distinct{i}"] <= exact_up_to * 1.1])
    texts = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    found = {}
    for i, name in texts:
        first = source.where(F.col(f"`{name}`").isNotNull()).select(*{name, order} - {None})
        first = (first.orderBy(order) if order else first).limit(PATTERN_ROWS)
        found[i] = first.agg(F.count("*").alias(f"sampled{i}"), *[F.sum(PATTERNS[p](F.col(f"`{name}`")).cast("long")).alias(f"{p}{i}") for p in PATTERNS])
    rows, known = [], one.asDict()
    for i, f in enumerate(df.schema.fields):
        missing = one["rows"] - one[f"present{i}"]
        count, mode = (small[f.name], "exact") if small.get(f.name, exact_up_to + 1) <= exact_up_to else (one[f"distinct{i}"], "approximate")
        values = [known.get(f"{k}{i}") for k in ("min", "max", "mean", "variance", "min_decimal", "max_decimal", "min_bytes", "max_bytes", "mean_bytes")]
        pattern = _best_pattern(found[i].first(), i) if i in found else None
        rows.append((f.name, f.dataType.simpleString(), one["rows"], missing, missing / one["rows"] if one["rows"] else 0.0, count, mode, *values, pattern, -(-one["rows"] // batch_size), schema_hash(df.schema)))
    return df.sparkSession.createDataFrame(rows, REPORT)


def numbered(df: DataFrame, order: str, name: str = "_offset") -> DataFrame:
    """Rows with their global offset in the order of a key.

    Ranges of the key are sorted in parallel; a table with one row a partition turns places in a partition into global ones.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    # read twice below: cut, or the ranges could be dealt anew in between
    at = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.expr("_at & 8589934591L")
    return at.join(F.broadcast(base), "_part").withColumn(name, place).drop("_at", "_part", "_base")
