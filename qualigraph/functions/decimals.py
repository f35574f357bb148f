"""Exact decimals with a scale of their own, dates as days, and amounts of money.

A decimal is a struct of `coefficient` (38 digits) and `scale` (0 to 38); texts have no exponent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualigraph.functions.text import trim
from qualigraph.functions.typing import parse

MOST_DIGITS = 38
_FORM = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"


def parse_decimal(c: Column) -> Column:
    """The struct of a text, null where it isn't a decimal of 38 digits at most."""
    t = trim(c)
    after = F.coalesce(F.octet_length(F.regexp_extract(t, r"\.([0-9]*)\z", 1)), F.lit(0))
    digits = F.replace(t, F.lit("."), F.lit("")).try_cast(f"decimal({MOST_DIGITS},0)")
    return F.when(t.rlike(_FORM) & (after <= MOST_DIGITS) & digits.isNotNull(), F.struct(digits.alias("coefficient"), after.cast("int").alias("scale")))


def _digits(d: Column) -> Column:
    return F.regexp_replace(d["coefficient"].cast("string"), "^-", "")


def format_decimal(d: Column) -> Column:
    """Plain text with as many places as the scale."""
    n, sign = d["scale"], F.when(d["coefficient"] < 0, "-").otherwise("")
    digits = F.lpad(_digits(d), F.greatest(n + 1, F.length(_digits(d))), F.lit("0"))
    whole, rest = F.substring(digits, F.lit(1), F.length(digits) - n), F.substring(digits, F.length(digits) - n + 1, n)
    return F.when(n == 0, F.concat(sign, digits)).otherwise(F.concat(sign, whole, F.lit("."), rest))


def rescale(d: Column, scale: int | Column) -> Column:
    """The same value with another scale; null where digits would be lost or more than 38 be needed."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    more = scale - d["scale"]
    zeros, digits = F.repeat(F.lit("0"), F.greatest(more, F.lit(0))), d["coefficient"].cast("string")
    longer = F.concat(digits, zeros).try_cast(f"decimal({MOST_DIGITS},0)")
    gone = F.lpad(_digits(d), F.greatest(F.length(_digits(d)), 1 - more), F.lit("0"))
    exact = F.substring(gone, F.length(gone) + more + 1, -more) == F.repeat(F.lit("0"), -more)
    sign = F.when(d["coefficient"] < 0, "-").otherwise("")
    shorter = F.when(exact, F.concat(sign, F.substring(gone, F.lit(1), F.length(gone) + more)).try_cast(f"decimal({MOST_DIGITS},0)"))
    coefficient = F.when(more >= 0, longer).otherwise(shorter)
    return F.when(coefficient.isNotNull() & scale.between(0, MOST_DIGITS), F.struct(coefficient.alias("coefficient"), scale.cast("int").alias("scale")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, exactly, whatever the scales: signs first, then whole parts by length and text, then places."""
    sign = lambda d: F.signum(d["coefficient"].cast("double")).cast("int")

    def parts(d):
        digits = F.lpad(_digits(d), F.greatest(F.length(_digits(d)), d["scale"] + 1), F.lit("0"))
        whole = F.ltrim(F.substring(digits, F.lit(1), F.length(digits) - d["scale"]), F.lit("0"))
        return F.length(whole), whole, F.rpad(F.substring(digits, F.length(digits) - d["scale"] + 1, d["scale"]), F.lit(MOST_DIGITS), F.lit("0"))

    size = F.coalesce(*[F.when(x < y, -1).when(x > y, 1) for x, y in zip(parts(a), parts(b), strict=True)], F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(sign(a) != sign(b), F.when(sign(a) < sign(b), -1).otherwise(1)).otherwise(size * sign(a)))


def _checked(c: Column, value: Column, on_invalid: str, what: str) -> Column:
    if on_invalid == "null":
        return value
    if on_invalid != "fail":
        raise ValueError(f"unknown policy {on_invalid}")
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"invalid {what}: "), c)).cast("int")).otherwise(value)


def date_days(c: Column, on_invalid: str = "fail") -> Column:
    """Days since 1970-01-01 of an ISO date; others raise or become null."""
    return _checked(c, F.unix_date(parse(c, "date")), on_invalid, "date")


def currency(c: Column, scale: int = 2, separator: str = ".", on_invalid: str = "fail") -> Column:
    """An amount with its own decimal separator as decimal(38, scale); places that the scale hasn't got raise or make it null."""
    t = c if separator == "." else F.when(~F.contains(c, F.lit(".")), F.replace(c, F.lit(separator), F.lit(".")))
    exact = rescale(parse_decimal(t), scale)
    value = format_decimal(exact).try_cast(f"decimal({MOST_DIGITS},{scale})")
    if on_invalid == "fail":
        return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("invalid amount: "), c)).cast(f"decimal({MOST_DIGITS},{scale})")).otherwise(value)
    return _checked(c, value, on_invalid, "amount")
