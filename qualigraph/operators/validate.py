"""Declarative rules compiled into one projection; uniqueness by the least offset of each key."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.functions.text import PATTERNS, matches_regex, posix_regex

TAGS = ("required", "range", "enum_values", "string_length", "pattern", "regex", "unique")


@dataclass(frozen=True)
class Rule:
    id: int
    column: str
    tag: str
    min: str | None = None
    max: str | None = None
    values: tuple[str, ...] = field(default=())
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    regex: str | None = None

    @staticmethod
    def from_json(row: dict) -> Rule:
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if v is not None}
        return Rule(**known)


class RuleError(ValueError):
    pass


def check(rules: list[Rule], schema: T.StructType) -> None:
    """Refuse rules that can't be evaluated, before any plan is built."""
    kinds, seen = {f.name: f.dataType for f in schema.fields}, set()
    for r in rules:
        kind = kinds.get(r.column)
        text, number = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
        problem = (
            f"duplicate rule id {r.id}" if r.id in seen
            else f"unknown column {r.column}" if kind is None
            else f"unknown kind of rule {r.tag}" if r.tag not in TAGS
            else f"rule {r.id}: {r.tag} needs text" if r.tag in ("enum_values", "string_length", "pattern", "regex") and not text
            else f"rule {r.id}: range needs numbers" if r.tag == "range" and not number
            else f"rule {r.id}: no bounds" if (r.tag == "range" and r.min is None and r.max is None) or (r.tag == "string_length" and r.min_length is None and r.max_length is None)
            else f"rule {r.id}: bounds are inverted" if (r.tag == "range" and r.min is not None and r.max is not None and Decimal(r.min) > Decimal(r.max)) or (r.tag == "string_length" and r.min_length is not None and r.max_length is not None and r.min_length > r.max_length)
            else f"rule {r.id}: no values" if r.tag == "enum_values" and not r.values
            else f"rule {r.id}: unknown pattern {r.pattern}" if r.tag == "pattern" and r.pattern not in PATTERNS
            else f"rule {r.id}: no expression" if r.tag == "regex" and not r.regex
            else None
        )
        if problem:
            raise RuleError(problem)
        if r.tag == "regex":
            posix_regex(r.regex)
        seen.add(r.id)


def _codes(r: Rule, kind: T.DataType) -> list[tuple[Column, str]]:
    """(condition, code) pairs; only `required` fires on null."""
    c = F.col(f"`{r.column}`")
    if r.tag == "required":
        return [(c.isNull(), "required_missing")]
    if r.tag == "range":
        bound = lambda v: F.lit(v).cast(kind)
        low = [(c < bound(r.min), "below_minimum")] if r.min is not None else []
        return low + ([(c > bound(r.max), "above_maximum")] if r.max is not None else [])
    if r.tag == "enum_values":
        return [(~c.isin(*r.values), "enum_mismatch")]
    if r.tag == "string_length":
        n, bad = F.octet_length(c), F.lit(False)
        if r.min_length is not None:
            bad = bad | (n < r.min_length)
        if r.max_length is not None:
            bad = bad | (n > r.max_length)
        return [(bad, "invalid_length")]
    if r.tag == "pattern":
        return [(~PATTERNS[r.pattern](c), "pattern_mismatch")]
    if r.tag == "regex":
        return [(~matches_regex(c, r.regex), "regex_mismatch")]
    raise RuleError(f"{r.tag} looks at more than one row")


def violations(df: DataFrame, rules: list[Rule], offset: str) -> DataFrame:
    """(offset, rule_id, column_name, code), in row and then rule order if sorted by offset and ordinal.

    Row rules are one projection and an explode of what fired. Each unique rule takes the least
    offset of each key, with partial minima before the shuffle, and joins it back: a hot value is one
    row on one side and split by AQE on the other, and few values are broadcast. Offsets name rows,
    so no two rows have one; nulls are taken out first.
    """
    check(rules, df.schema)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fired = [
        F.when(condition, F.struct(F.lit(n).alias("ordinal"), F.lit(r.id).cast("long").alias("rule_id"), F.lit(r.column).alias("column_name"), F.lit(code).alias("code")))
        for n, r in enumerate(rules)
        if r.tag != "unique"
        for condition, code in _codes(r, kinds[r.column])
    ]
    parts = []
    if fired:
        found = F.filter(F.array(*fired), lambda v: v.isNotNull())
        parts.append(df.select(F.col(offset).alias("offset"), F.explode(found).alias("v")).select("offset", "v.*"))
    for n, r in enumerate(rules):
        if r.tag == "unique":
            key = df.where(F.col(f"`{r.column}`").isNotNull()).select(F.col(offset).alias("offset"), F.col(f"`{r.column}`").alias("key"))
            least = key.groupBy("key").agg(F.min("offset").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
            again = key.join(least, "key").where("offset != first")
            parts.append(again.select("offset", F.lit(n).alias("ordinal"), F.lit(r.id).cast("long").alias("rule_id"), F.lit(r.column).alias("column_name"), F.lit("duplicate_value").alias("code")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates_per_key(df: DataFrame, column: str) -> DataFrame:
    """(key, duplicates): how often a value comes again. Counts before the shuffle, so hot values cost one row a task."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg((F.count("*") - 1).alias("duplicates")).where("duplicates > 0")


def by_rule(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, violation_count), rules without violations included."""
    listed = found.sparkSession.createDataFrame([(r.id,) for r in rules], "rule_id long")
    counts = found.groupBy("rule_id").count()
    return F.broadcast(listed).join(counts, "rule_id", "left").select("rule_id", F.coalesce("count", F.lit(0)).alias("violation_count"))


def by_column(found: DataFrame, rules: list[Rule]) -> DataFrame:
    listed = found.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(r.column for r in rules)], "column_name string")
    counts = found.groupBy("column_name").count()
    return F.broadcast(listed).join(counts, "column_name", "left").select("column_name", F.coalesce("count", F.lit(0)).alias("violation_count"))


def totals(df: DataFrame, found: DataFrame) -> DataFrame:
    """(rows_processed, rows_with_violations, violation_count)."""
    counted = found.groupBy("offset").count().agg(F.count("*").alias("rows_with_violations"), F.coalesce(F.sum("count"), F.lit(0)).alias("violation_count"))
    return df.agg(F.count("*").alias("rows_processed")).join(F.broadcast(counted))


def sample(found: DataFrame, n: int = 100) -> DataFrame:
    """The first n violations in row and rule order."""
    return found.orderBy("offset", "ordinal", "code").limit(n)
