import uuid

import pytest
from pyspark.sql import functions as F

from qualigraph.functions import decimals, similarity, text, typing


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("value,expression,want", [
    ("\t a b \r\n", lambda C: text.trim(C), "a b"),
    ("éAb", lambda C: text.upper_ascii(C), "éAB"),
    ("ÉaB", lambda C: text.lower_ascii(C), "Éab"),
    ("aaa", lambda C: text.replace_all(C, "aa", "b"), "ba"),
    ("  A -  B\t", lambda C: text.match_normal(C, drop_punctuation=True), "a b"),
    ("abc def", lambda C: text.block_key(C, "prefix", 5), "abc d"),
    ("abc def", lambda C: text.block_key(C, "token_prefix", 5), "abc"),
    (None, lambda C: text.trim(C), None),
    ("é", lambda C: text.edit_distance(C, F.lit("e"), 3), 2),
    ("abcdef", lambda C: text.edit_distance(C, F.lit(""), 3), None),
    ("a@b.c", lambda C: text.PATTERNS["email"](C), True),
    ("@b.c", lambda C: text.PATTERNS["email"](C), False),
    ("a@b@c.", lambda C: text.PATTERNS["email"](C), True),
    ("+1234567", lambda C: text.PATTERNS["phone_e164"](C), True),
    ("+1234567\n", lambda C: text.PATTERNS["phone_e164"](C), False),
    ("http://", lambda C: text.PATTERNS["url"](C), False),
    ("bob", lambda C: text.matches_regex(C, "^[[:upper:]]+$"), False),
    ("AB\n", lambda C: text.matches_regex(C, "^[[:upper:]]+$"), False),
])
def test_text(spark, value, expression, want):
    assert one(spark, value, expression) == want


def test_wrong_parameters(spark):
    C = F.col("c")
    for call in (lambda: text.replace_all(C, "", "x"), lambda: text.block_key(C, "prefix"), lambda: text.block_key(C, "other", 1), lambda: text.posix_regex("a" * 1025)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("name", ["", "a", "Customer:é", "x" * 200])
def test_uuid5(spark, name):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, name, lambda C: text.uuid5(space, C)) == str(uuid.uuid5(uuid.UUID(space), name))


@pytest.mark.parametrize("a,b,want", [(b"MARTHA", b"MARHTA", 0.961111), (b"DIXON", b"DICKSONX", 0.813333), (b"", b"a", 0.0), (b"a", b"a", 1.0), (b"abc", b"xyz", 0.0), (b"a" * 1025, b"a" * 1025, 0.0)])
def test_jaro_winkler(spark, a, b, want):
    assert abs(similarity.jaro_winkler_bytes(a, b) - want) < 1e-5
    got = spark.createDataFrame([(a.decode(), b.decode())], "a string, b string").select(similarity.jaro_winkler("a", "b").alias("r")).first().r
    assert abs(got - want) < 1e-5


def test_composite(spark):
    df = spark.createDataFrame([("jon smith", "john smith"), ("a", "zzzz"), ("same", "same")], "a string, b string")
    got = [r.r for r in df.select(similarity.composite(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[0] > 0.85 and got[1] is None and got[2] == 1.0


@pytest.mark.parametrize("value,tag,want", [
    (" 1_000 ", "i64", 1000), ("+5", "i64", 5), ("9223372036854775808", "i64", None), ("1.0", "i64", None),
    ("NaN", "f64", None), ("1e400", "f64", None), ("1e2", "f64", 100.0), ("TRUE ", "boolean", True), ("t", "boolean", None),
    ("2024-1-5", "date", None), ("2024-02-30", "date", None), ("1e2", "decimal", None), (" x ", "string", " x "),
])
def test_parse(spark, value, tag, want):
    assert one(spark, value, lambda C: typing.parse(C, tag)) == want


def test_inference(spark):
    rows = [("0012", "1", "1.5", "true", "2024-01-01", None, "2024-01-01T00:00:00Z", "1"), ("0013", "2", "2", "FALSE", "2024-02-01", None, "2024-01-01T00:00:01Z", "F5")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string")
    fields = typing.infer(df)
    assert [f.tag for f in fields] == ["string", "i64", "decimal", "boolean", "date", "string", "datetime", "string"]
    assert all(f.nullable for f in fields)
    wrong = [typing.Field("h", "i64", True)]
    assert typing.invalid_counts(df, wrong).first().invalid_count == 1
    assert [r.h for r in typing.convert(df, wrong).collect()] == [1, None]
    with pytest.raises(Exception, match="invalid i64"):
        typing.convert(df, wrong, "fail").collect()


@pytest.mark.parametrize("text,scale,want", [
    ("1.50", 1, "1.5"), ("1.50", 4, "1.5000"), ("1.55", 1, None), ("-0.05", 2, "-0.05"), ("-0.05", 1, None), (".5", 1, "0.5"), ("+7", 0, "7"), ("7.", 2, "7.00"), ("100", 0, "100"), ("1200", 0, "1200"),
    ("0", 3, "0.000"), ("1e2", 2, None), ("", 2, None), (None, 2, None), ("9" * 38, 0, "9" * 38), ("9" * 38, 1, None), ("9" * 39, 0, None), ("0." + "0" * 37 + "1", 38, "0." + "0" * 37 + "1"),
])
def test_decimals(spark, text, scale, want):
    assert one(spark, text, lambda c: decimals.format_decimal(decimals.rescale(decimals.parse_decimal(c), scale))) == want


def test_decimal_order(spark):
    from decimal import Decimal

    values = ["-10.5", "-10.05", "-0.0", "0", "0.10", "0.1", ".09", "2", "10", "9.99", "1" + "0" * 37, "0." + "1" * 38]
    rows = [(a, b) for a in values for b in values]
    a, b = (decimals.parse_decimal(F.col(c)) for c in "ab")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", decimals.compare(a, b).alias("r")).collect()
    assert all(r.r == (Decimal(r.a) > Decimal(r.b)) - (Decimal(r.a) < Decimal(r.b)) for r in got) and len(got) == len(rows)
    assert one(spark, None, lambda c: decimals.compare(decimals.parse_decimal(c), decimals.parse_decimal(F.lit("1")))) is None


def test_days_and_amounts(spark):
    from decimal import Decimal

    assert one(spark, "1970-01-11", decimals.date_days) == 10 and one(spark, "1970-1-11", lambda c: decimals.date_days(c, "null")) is None
    assert one(spark, "12,50", lambda c: decimals.currency(c, 2, ",")) == Decimal("12.50") and one(spark, "12", lambda c: decimals.currency(c, 1)) == Decimal("12.0")
    assert one(spark, "12.50", lambda c: decimals.currency(c, 2, ",", "null")) is None and one(spark, "1.555", lambda c: decimals.currency(c, 2, on_invalid="null")) is None
    for call in (decimals.date_days, lambda c: decimals.currency(c, 2)):
        with pytest.raises(Exception, match="invalid"):
            one(spark, "1.x", call)


def test_bounds_of_scores_hold(spark):
    import random

    rng = random.Random(4)
    rows = [("".join(rng.choices("abé ", k=rng.randrange(9))), "".join(rng.choices("abé ", k=rng.randrange(9)))) for _ in range(800)] + [("", ""), ("abcd", "abcd")]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", similarity.jaro_winkler(a, b).alias("jw"), similarity.jaro_winkler_bound(a, b).alias("most"), similarity.composite(a, b, threshold=0.6).alias("c"), similarity.may_reach(a, b, threshold=0.6).alias("may")).collect()
    assert all(r.jw <= r.most for r in got) and all(r.may for r in got if r.c is not None) and not all(r.may for r in got)
    assert one(spark, "", lambda c: similarity.jaro_winkler(c, F.lit(""))) == 1.0
