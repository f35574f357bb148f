"""The seven value types, their guarded parsers, and conservative inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualigraph.functions.text import lower_ascii, trim

#: In the order in which candidates are tried.
TAGS = ("boolean", "i64", "decimal", "f64", "date", "datetime")
NUMERIC = {"i64", "decimal", "f64"}
SAMPLE_ROWS = 4096


def parse(c: Column, tag: str, scale: int = 18) -> Column:
    """The typed value of a text, null where it isn't one. Strings keep their blanks.

    What is left of a text without its digits says whether it can be of the type, and a cast checks the rest;
    regular expressions stand only where texts with exponents or underscores need them.
    """
    if tag == "string":
        return c
    t = trim(c)
    left = F.translate(t, "0123456789", "")
    if tag == "boolean":
        low = lower_ascii(t)
        return F.when(low == "true", True).when(low == "false", False)
    if tag == "i64":
        grouped = F.when(t.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))
        return F.when(left.isin("", "+", "-"), t.try_cast("bigint")).when(F.contains(left, F.lit("_")), grouped)
    if tag == "decimal":
        return F.when(left.isin("", ".", "+", "-", "+.", "-."), t.try_cast(f"decimal(38,{scale})"))
    if tag == "f64":
        plain = F.when(left.isin("", ".", "+", "-", "+.", "-."), t.try_cast("double"))
        number = plain.when(t.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+\z"), t.try_cast("double"))
        return F.when(F.abs(number) < float("inf"), number)
    at = lambda k, mark: F.substring(t, k, 1) == mark
    if tag == "date":
        return F.when((left == "--") & (F.length(t) == 10) & at(5, "-") & at(8, "-"), t.try_cast("date"))
    if tag == "datetime":
        shaped = (left == "--T::Z") & (F.length(t) == 20) & at(5, "-") & at(8, "-") & at(11, "T") & at(14, ":") & at(17, ":") & at(20, "Z")
        return F.when(shaped, t.try_cast("timestamp"))
    raise ValueError(f"unknown type {tag}")


def leading_zero(c: Column) -> Column:
    return trim(c).rlike(r"\A[+-]?0[0-9]")


@dataclass(frozen=True)
class Field:
    name: str
    tag: str
    nullable: bool


def choose(shares: dict[str, float], has_leading_zero: bool, confidence: float = 1.0) -> str:
    """First candidate that qualifies; text if several of different nature do, or codes with leading zeros."""
    if has_leading_zero:
        return "string"
    fit = [t for t in TAGS if shares.get(t) is not None and shares[t] >= confidence]
    if not fit or (len(fit) > 1 and not set(fit) <= NUMERIC):
        return "string"
    return fit[0]


def shares(df: DataFrame) -> DataFrame:
    """One row a column: rows, values, leading zeros and the values that each candidate accepts; none for an empty input.

    Columns become rows first, so the plan has one set of expressions however many columns there are.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("c")) for c in df.columns])
    c = F.col("c")
    counts = [F.count(parse(c, t)).alias(t) for t in TAGS]
    long = df.select(F.explode(cells).alias("s")).select("s.*")
    return long.groupBy("column_name").agg(F.count("*").alias("n"), F.count("c").alias("present"), F.sum(leading_zero(c).cast("long")).alias("zeros"), *counts)


def infer(df: DataFrame, sample_rows: int = SAMPLE_ROWS, confidence: float = 1.0) -> list[Field]:
    """Types of text columns from the first rows; every field is nullable afterwards."""
    rows, found = {r["column_name"]: r for r in shares(df.limit(sample_rows)).collect()}, []  # one row a column
    for name in df.columns:
        r = rows.get(name)
        known = {t: r[t] / r["present"] for t in TAGS} if r and r["present"] else {}
        found.append(Field(name, choose(known, bool(r and r["zeros"]), confidence), True))
    return found


def convert(df: DataFrame, fields: list[Field], on_invalid: str = "null") -> DataFrame:
    """Typed columns; invalid texts become null or raise."""
    out = []
    for f in fields:
        raw = F.col(f"`{f.name}`").cast("string")
        value = parse(raw, f.tag)
        if on_invalid == "fail":
            value = F.when(raw.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"invalid {f.tag} in {f.name}: "), raw))).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def invalid_counts(df: DataFrame, fields: list[Field]) -> DataFrame:
    """(column_name, invalid_count): texts that their type doesn't accept."""
    counts = [F.sum((F.col(f"`{f.name}`").isNotNull() & parse(F.col(f"`{f.name}`").cast("string"), f.tag).isNull()).cast("long")).alias(f"_{i}") for i, f in enumerate(fields)]
    one = df.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.coalesce(f"_{i}", F.lit(0)).cast("long").alias("invalid_count")) for i, f in enumerate(fields)])).alias("s")).select("s.*")


def inferred(df: DataFrame, sample_rows: int = SAMPLE_ROWS, confidence: float = 1.0, batch_size: int = 1024) -> tuple[DataFrame, dict]:
    """(typed rows, report): schema from the first rows, then rows, batches and invalid texts over all of them."""
    fields = infer(df, sample_rows, confidence)
    invalid = invalid_counts(df, fields)
    rows = df.count()
    return convert(df, fields), {"rows": rows, "batches": -(-rows // batch_size), "invalid": {r["column_name"]: r["invalid_count"] for r in invalid.collect()}, "schema": [(f.name, f.tag, f.nullable) for f in fields]}
