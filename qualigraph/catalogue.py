"""Every registered query with, where SQL can express it, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.functions import decimals, text, typing
from qualigraph.operators import clean, graph, match, profile, reason, validate
from qualigraph.operators.lineage import shared_folder
from qualigraph.plans.store import Store
from qualigraph.sources.sinks import as_text, envelopes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# ---- typing

_INFER_COLUMNS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*)::BIGINT AS n, count({c})::BIGINT AS present,
  count(*) FILTER (regexp_matches({c}::VARCHAR, '^[+-]?[0-9]+$') AND try_cast({c}::VARCHAR AS BIGINT) IS NOT NULL)::BIGINT AS integers,
  count(*) FILTER (regexp_matches({c}::VARCHAR, '^[+-]?0[0-9]'))::BIGINT AS zeros FROM lineitem"""
        for c in _INFER_COLUMNS
    )
)
def infer_types_lineitem(spark, sf_dir):
    found = typing.shares(_texts(_t(spark, sf_dir, "lineitem").select(*_INFER_COLUMNS)))
    return found.select("column_name", "n", "present", F.col("i64").alias("integers"), F.coalesce("zeros", F.lit(0)).cast("long").alias("zeros"))


@query(
    """SELECT o_orderkey, try_cast(o_orderkey::VARCHAR AS BIGINT) AS key_i64, CASE WHEN regexp_matches(o_orderpriority, '^[+-]?[0-9]+$') THEN try_cast(o_orderpriority AS BIGINT) END AS priority_i64,
  strftime(o_orderdate, '%Y-%m-%d')::DATE::VARCHAR AS day, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS is_final FROM orders"""
)
def typed_convert_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", " false ").otherwise("maybe")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", typing.parse(F.col("o_orderkey").cast("string"), "i64").alias("key_i64"), typing.parse(F.col("o_orderpriority"), "i64").alias("priority_i64"), typing.parse(day, "date").cast("string").alias("day"), typing.parse(status, "boolean").alias("is_final"))


@query(
    """SELECT 'event_type' AS column_name, count(*)::BIGINT AS invalid_count FROM events WHERE event_type IS NOT NULL AND NOT regexp_matches(event_type, '^[+-]?[0-9]+$')
UNION ALL SELECT 'k', count(*) FILTER (NOT regexp_matches(props::JSON->>'k', '^[+-]?[0-9]+$'))::BIGINT FROM events
UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NOT NULL AND NOT regexp_matches(user_id::VARCHAR, '^[+-]?[0-9]+$'))::BIGINT FROM events"""
)
def invalid_values_events(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("user_id"))
    return typing.invalid_counts(e, [typing.Field(c, "i64", True) for c in e.columns])


@query("SELECT p_partkey, replace(round(p_retailprice, 2)::DECIMAL(18,2)::VARCHAR, '.', ',') AS shown, round(p_retailprice, 2)::DECIMAL(18,2)::VARCHAR AS amount, (round(p_retailprice, 2)::DECIMAL(18,2) * 100)::BIGINT AS cents FROM part")
def decimal_normalize_price(spark, sf_dir):
    """Amounts as shops write them, with a comma, to exact decimals."""
    shown = F.replace(F.format_string("%.2f", F.round("p_retailprice", 2)), F.lit("."), F.lit(","))
    p = _t(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))
    amount = decimals.currency(F.col("shown"), 2, ",")
    return p.select("p_partkey", "shown", amount.cast("string").alias("amount"), (amount * 100).cast("long").alias("cents"))


@query("""WITH p AS (SELECT c_custkey, round(c_acctbal, 2)::DECIMAL(18,2) AS a FROM customer)
SELECT c_custkey, a::DECIMAL(18,4)::VARCHAR AS four, CASE WHEN a = a::DECIMAL(18,1) THEN a::DECIMAL(18,1)::VARCHAR END AS one, (CASE WHEN a < 1000.5 THEN -1 WHEN a > 1000.5 THEN 1 ELSE 0 END)::INTEGER AS side FROM p""")
def decimal_rescale_balance(spark, sf_dir):
    """Rescaled to four places and, where no digit is lost, to one; compared across scales."""
    value = decimals.parse_decimal(F.format_string("%.2f", F.round("c_acctbal", 2)))
    c = _t(spark, sf_dir, "customer").select("c_custkey", value.alias("d"))
    d = F.col("d")
    side = decimals.compare(d, decimals.parse_decimal(F.lit("1000.5")))
    return c.select("c_custkey", decimals.format_decimal(decimals.rescale(d, 4)).alias("four"), decimals.format_decimal(decimals.rescale(d, 1)).alias("one"), side.alias("side"))


@query("SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS day FROM orders")
def date_normalize_orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", decimals.date_days(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time_text, strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders")
def iso_text_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", as_text(F.col("o_orderdate"), o.schema["o_orderdate"].dataType).alias("time_text"), as_text(F.col("o_orderdate").cast("date"), T.DateType()).alias("date_text"))


# ---- profiling


def _union(parts):
    return "\nUNION ALL ".join(parts)


@query(_union(f"SELECT '{c}' AS column_name, count(*)::BIGINT AS row_count, (count(*) - count({e}))::BIGINT AS null_count, round((count(*) - count({e})) / count(*), 6) AS null_rate FROM orders" for c, e in (("o_orderkey", "o_orderkey"), ("status", "nullif(o_orderstatus, 'P')"))))
def profile_nulls(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return profile.nulls(o).withColumn("null_rate", F.round("null_rate", 6))


@query(_union(f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(var_samp({c}), 2) AS variance FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def profile_numeric(spark, sf_dir):
    found = profile.numbers(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_linenumber"))
    return found.withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 2)})


@query(_union(f"SELECT '{c}' AS column_name, min(octet_length(encode({c})))::BIGINT AS min, max(octet_length(encode({c})))::BIGINT AS max, round(avg(octet_length(encode({c}))), 4) AS mean FROM documents" for c in ("text", "lang", "source")))
def profile_length(spark, sf_dir):
    return profile.lengths(_t(spark, sf_dir, "documents").select("text", "lang", "source")).withColumn("mean", F.round("mean", 4))


@query(_union(f"SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_count FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")))
def profile_distinct(spark, sf_dir):
    return profile.distinct_exact(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag", "l_quantity"])


@query(_union(f"SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_count, CASE WHEN count(DISTINCT {c}) <= 10000 THEN 'exact' ELSE 'approximate' END AS mode FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")))
def profile_distinct_adaptive(spark, sf_dir):
    """Columns of few values, which the sketch leaves to an exact count."""
    return profile.distinct(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"])


@query(_union(f"SELECT '{c}' AS column_name, min(round({c}, 2)::DECIMAL(18,2))::VARCHAR AS min, max(round({c}, 2)::DECIMAL(18,2))::VARCHAR AS max FROM lineitem" for c in ("l_extendedprice", "l_tax")))
def profile_decimals(spark, sf_dir):
    return profile.decimals(_t(spark, sf_dir, "lineitem").select(*[F.round(c, 2).cast("decimal(18,2)").alias(c) for c in ("l_extendedprice", "l_tax")]))


@query()
def profile_distinct_approx(spark, sf_dir):
    return profile.distinct_sketch(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""WITH f AS (SELECT url FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 4096),
c AS (SELECT count(*) AS n, count(*) FILTER (strpos(url, '@') > 1 AND strpos(substr(url, strpos(url, '@') + 1), '.') > 0) AS email, count(*) FILTER (regexp_full_match(url, '\\+[0-9]{7,15}')) AS phone_e164, count(*) FILTER (regexp_full_match(url, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS date_iso,
  count(*) FILTER (regexp_full_match(url, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')) AS uuid, count(*) FILTER ((starts_with(url, 'http://') AND length(url) > 7) OR (starts_with(url, 'https://') AND length(url) > 8)) AS url FROM f),
p AS (UNPIVOT c ON email, phone_e164, date_iso, uuid, url INTO NAME pattern VALUE hits)
SELECT 'url' AS column_name, any_value(n)::BIGINT AS sampled, (list(pattern ORDER BY hits DESC, list_position(['email', 'phone_e164', 'date_iso', 'uuid', 'url'], pattern)) FILTER (hits > 0 AND hits >= 0.9 * n))[1] AS pattern FROM p""")
def profile_patterns(spark, sf_dir):
    return profile.patterns(_t(spark, sf_dir, "pages"), "url", "page_id")


@query()
def profile_report(spark, sf_dir):
    return profile.report(_t(spark, sf_dir, "lineitem"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _offset FROM orders")
def row_offsets(spark, sf_dir):
    return profile.numbered(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# ---- rules

_RULES = [
    validate.Rule(1, "status", "required"),
    validate.Rule(2, "o_totalprice", "range", min="5000", max="300000"),
    validate.Rule(3, "o_orderpriority", "enum_values", values=("1-URGENT", "2-HIGH", "3-MEDIUM")),
    validate.Rule(4, "o_orderpriority", "string_length", min_length=6, max_length=8),
    validate.Rule(5, "o_orderpriority", "regex", regex="^[[:digit:]]-[A-Z]+$"),
    validate.Rule(6, "o_custkey", "unique"),
    validate.Rule(7, "o_orderkey", "required"),
]
_V_SQL = """WITH o AS (SELECT o_orderkey AS "offset", nullif(o_orderstatus, 'P') AS status, * FROM orders),
n AS (SELECT "offset", row_number() OVER (PARTITION BY o_custkey ORDER BY "offset") AS nth FROM o),
v AS (
  SELECT "offset", 0 AS ordinal, 1 AS rule_id, 'status' AS column_name, 'required_missing' AS code FROM o WHERE status IS NULL
  UNION ALL SELECT "offset", 1, 2, 'o_totalprice', 'below_minimum' FROM o WHERE o_totalprice < 5000
  UNION ALL SELECT "offset", 1, 2, 'o_totalprice', 'above_maximum' FROM o WHERE o_totalprice > 300000
  UNION ALL SELECT "offset", 2, 3, 'o_orderpriority', 'enum_mismatch' FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT "offset", 3, 4, 'o_orderpriority', 'invalid_length' FROM o WHERE octet_length(encode(o_orderpriority)) NOT BETWEEN 6 AND 8
  UNION ALL SELECT "offset", 4, 5, 'o_orderpriority', 'regex_mismatch' FROM o WHERE NOT regexp_matches(o_orderpriority, '^[[:digit:]]-[A-Z]+$')
  UNION ALL SELECT "offset", 5, 6, 'o_custkey', 'duplicate_value' FROM n WHERE nth > 1)
"""


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))


def _violations(spark, sf_dir):
    return validate.violations(_orders(spark, sf_dir), _RULES, "o_orderkey")


@query(_V_SQL + 'SELECT "offset", rule_id::BIGINT AS rule_id, column_name, code FROM v')
def validation_violations(spark, sf_dir):
    return _violations(spark, sf_dir).drop("ordinal")


@query(_V_SQL + "SELECT r.id::BIGINT AS rule_id, count(v.rule_id)::BIGINT AS violation_count FROM range(1, 8) r(id) LEFT JOIN v ON v.rule_id = r.id GROUP BY ALL")
def validation_summary_by_rule(spark, sf_dir):
    return validate.by_rule(_violations(spark, sf_dir), _RULES)


@query(_V_SQL + "SELECT c AS column_name, count(v.column_name)::BIGINT AS violation_count FROM (VALUES ('status'), ('o_totalprice'), ('o_orderpriority'), ('o_custkey'), ('o_orderkey')) t(c) LEFT JOIN v ON v.column_name = c GROUP BY ALL")
def validation_summary_by_column(spark, sf_dir):
    return validate.by_column(_violations(spark, sf_dir), _RULES)


@query(_V_SQL + 'SELECT (SELECT count(*) FROM orders)::BIGINT AS rows_processed, count(DISTINCT "offset")::BIGINT AS rows_with_violations, count(*)::BIGINT AS violation_count FROM v')
def validation_totals(spark, sf_dir):
    return validate.totals(_orders(spark, sf_dir), _violations(spark, sf_dir))


@query(_V_SQL + 'SELECT "offset", rule_id::BIGINT AS rule_id, column_name, code FROM v ORDER BY "offset", ordinal, code LIMIT 100')
def validation_sample_100(spark, sf_dir):
    return validate.sample(_violations(spark, sf_dir)).drop("ordinal")


def _one_rule(table, key, rule, derive=None):
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, table)
        return validate.violations(derive(df) if derive else df, [rule], key).select("offset", "code")

    return run


for _name, _table, _key, _rule, _sql in (
    ("rule_required", "customer", "c_custkey", validate.Rule(1, "c_mktsegment", "required"), None),
    ("rule_range", "customer", "c_custkey", validate.Rule(1, "c_acctbal", "range", min="0", max="9000"), "SELECT c_custkey AS \"offset\", CASE WHEN c_acctbal < 0 THEN 'below_minimum' ELSE 'above_maximum' END AS code FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000"),
    ("rule_enum", "customer", "c_custkey", validate.Rule(1, "c_mktsegment", "enum_values", values=("BUILDING", "MACHINERY")), "SELECT c_custkey AS \"offset\", 'enum_mismatch' AS code FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("rule_length", "documents", "doc_id", validate.Rule(1, "text", "string_length", min_length=500, max_length=5000), "SELECT doc_id AS \"offset\", 'invalid_length' AS code FROM documents WHERE octet_length(encode(text)) NOT BETWEEN 500 AND 5000"),
    ("rule_pattern_url", "pages", "page_id", validate.Rule(1, "url", "pattern", pattern="url"), "SELECT page_id AS \"offset\", 'pattern_mismatch' AS code FROM pages WHERE NOT ((starts_with(url, 'http://') AND octet_length(encode(url)) > 7) OR (starts_with(url, 'https://') AND octet_length(encode(url)) > 8))"),
    ("rule_pattern_email", "documents", "doc_id", validate.Rule(1, "text", "pattern", pattern="email"), "SELECT doc_id AS \"offset\", 'pattern_mismatch' AS code FROM documents WHERE NOT (strpos(text, '@') > 1 AND strpos(substr(text, strpos(text, '@') + 1), '.') > 0)"),
    ("rule_regex", "customer", "c_custkey", validate.Rule(1, "c_name", "regex", regex="^Customer#[[:digit:]]*[02468]$"), "SELECT c_custkey AS \"offset\", 'regex_mismatch' AS code FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[[:digit:]]*[02468]$')"),
    ("rule_unique", "customer", "c_custkey", validate.Rule(1, "c_nationkey", "unique"), "SELECT c_custkey AS \"offset\", 'duplicate_value' AS code FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n > 1"),
):
    QUERIES[_name] = _one_rule(_table, _key, _rule)
    if _sql:
        ORACLES[_name] = _sql
QUERIES["rule_required"] = _one_rule("customer", "c_custkey", validate.Rule(1, "segment", "required"), lambda df: df.withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))))
ORACLES["rule_required"] = "SELECT c_custkey AS \"offset\", 'required_missing' AS code FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("""SELECT o_orderkey AS "offset", 'duplicate_value' AS code FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY round(o_totalprice / 1000)::DECIMAL(18,0) ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1""")
def rule_unique_decimal(spark, sf_dir):
    """Equal decimals are equal however many zeros they end with."""
    value = F.round(F.col("o_totalprice") / 1000).cast("decimal(18,0)")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, value.cast("decimal(28,6)")).otherwise(value).alias("v"))
    return validate.violations(o, [validate.Rule(1, "v", "unique")], "o_orderkey").select("offset", "code")


@query("""SELECT c_custkey AS "offset", r.id::BIGINT AS rule_id, 'pattern_mismatch' AS code FROM customer, (VALUES (1), (2), (3)) r(id) WHERE c_custkey % (r.id + 2) = 0""")
def rule_patterns(spark, sf_dir):
    """Phone numbers, dates and UUIDs, a share of each spoilt."""
    k, hexed = F.col("c_custkey"), F.md5(F.col("c_name").cast("binary"))
    part = lambda a, n: F.substring(hexed, a, n)
    c = _t(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.when(k % 3 == 0, "00").otherwise("+"), F.lpad(k.cast("string"), 9, "1")).alias("phone"),
        F.concat(F.lit("2024-01-"), F.when(k % 4 == 0, "1").otherwise("31")).alias("day"),
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), F.when(k % 5 == 0, part(21, 11)).otherwise(part(21, 12))).alias("uuid"),
    )
    rules = [validate.Rule(1, "phone", "pattern", pattern="phone_e164"), validate.Rule(2, "day", "pattern", pattern="date_iso"), validate.Rule(3, "uuid", "pattern", pattern="uuid")]
    return validate.violations(c, rules, "c_custkey").select("offset", "rule_id", "code")


@query("SELECT l_orderkey AS key, (count(*) - 1)::BIGINT AS duplicates FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_counts_lineitem(spark, sf_dir):
    return validate.duplicates_per_key(_t(spark, sf_dir, "lineitem"), "l_orderkey")


# ---- cleaning

_AZ = "abcdefghijklmnopqrstuvwxyz"
_UP = f"translate(%s, '{_AZ}', '{_AZ.upper()}')"
_LOW = f"translate(%s, '{_AZ.upper()}', '{_AZ}')"


@query(r"SELECT p_partkey, trim(chr(9) || '  ' || p_name || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS p_name FROM part")
def clean_trim(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("\t  "), "p_name", F.lit("\n ")).alias("p_name"))
    return clean.clean(p, [clean.Transform("trim", "p_name")])


@query(f"SELECT doc_id, {_UP % 'text'} AS text FROM documents")
def clean_upper(spark, sf_dir):
    return clean.clean(_t(spark, sf_dir, "documents").select("doc_id", "text"), [clean.Transform("uppercase", "text")])


@query(f"SELECT doc_id, {_LOW % 'text'} AS text FROM documents")
def clean_lower(spark, sf_dir):
    return clean.clean(_t(spark, sf_dir, "documents").select("doc_id", "text"), [clean.Transform("lowercase", "text")])


@query("SELECT c_custkey, replace(c_name, 'Customer#', 'C-') AS c_name FROM customer")
def clean_replace(spark, sf_dir):
    return clean.clean(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [clean.Transform("replace", "c_name", "Customer#", "C-")])


_CHAIN = [clean.Transform("uppercase", "c_name"), clean.Transform("replace", "c_name", "CUSTOMER#0", "#"), clean.Transform("lowercase", "c_mktsegment")]


@query(f"SELECT c_custkey, replace({_UP % 'c_name'}, 'CUSTOMER#0', '#') AS c_name, {_LOW % 'c_mktsegment'} AS c_mktsegment FROM customer")
def clean_chain(spark, sf_dir):
    return clean.clean(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), _CHAIN)


_AUDIT = [clean.Transform("trim", "o_orderpriority"), clean.Transform("lowercase", "o_orderpriority")]


@query("SELECT (o_orderkey // 1024)::BIGINT AS batch_id, min(o_orderkey)::BIGINT AS first_row, (max(o_orderkey) + 1)::BIGINT AS end_row, count(*)::BIGINT AS row_count, 'trim@1:o_orderpriority,lowercase@1:o_orderpriority' AS transforms FROM orders GROUP BY 1")
def audit_entries(spark, sf_dir):
    log = clean.audit(_t(spark, sf_dir, "orders"), _AUDIT, "o_orderkey", "run-1", "orders")
    return log.select("batch_id", "first_row", "end_row", "row_count", "transforms")


@query("""WITH b AS (SELECT (o_orderkey // 1024)::BIGINT AS batch_id, min(o_orderkey) AS first_row, max(o_orderkey) + 1 AS end_row FROM orders GROUP BY 1),
log AS (SELECT batch_id, first_row, CASE WHEN batch_id % 5 = 3 THEN end_row + 1 ELSE end_row END AS end_row FROM b WHERE batch_id % 4 <> 2)
SELECT coalesce(b.batch_id, log.batch_id) AS batch_id, CASE WHEN log.batch_id IS NULL THEN 'missing_entry' WHEN b.batch_id IS NULL THEN 'extra_entry' WHEN b.first_row <> log.first_row THEN 'first_row_differs' ELSE 'end_row_differs' END AS problem
FROM b FULL JOIN log ON b.batch_id = log.batch_id WHERE log.batch_id IS NULL OR b.batch_id IS NULL OR b.first_row <> log.first_row OR b.end_row <> log.end_row""")
def replay_verify(spark, sf_dir):
    """A log with a quarter of its entries lost and a fifth changed, checked against its source."""
    o = _t(spark, sf_dir, "orders")
    log = clean.audit(o, _AUDIT, "o_orderkey", "run-1", "orders").where("batch_id % 4 != 2")
    log = log.withColumn("end_row", F.when(F.col("batch_id") % 5 == 3, F.col("end_row") + 1).otherwise(F.col("end_row")))
    return clean.replay(o, log, _AUDIT, "o_orderkey", "orders")[1]


# ---- matching

_NORM = rf"lower_ascii(trim(regexp_replace(%s, '[ \t\n\r\x0b\x0c]+', ' ', 'g')))"


def _norm(c):
    return _LOW % rf"trim(regexp_replace({c}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_norm('text')}) AS normal_md5 FROM documents")
def match_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_normal(F.col("text")).cast("binary")).alias("normal_md5"))


@query(f"WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS reference_id, b.doc_id AS candidate_id FROM n a JOIN n b ON a.t = b.t WHERE a.t <> ''")
def match_exact_docs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return match.exact(d, d, "doc_id", "text")


@query(f"WITH n AS (SELECT p_partkey AS k, {_norm('p_name')} AS t FROM part) SELECT a.k AS candidate_id, count(*)::BIGINT AS matches FROM n a JOIN n b ON a.t = b.t WHERE a.t <> '' GROUP BY 1")
def match_exact_counts(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return match.exact_counts(p, p, "p_partkey", "p_name")


@query(f"""WITH n AS (SELECT s_suppkey AS k, {_norm('s_name')} AS t FROM supplier), b AS (SELECT k, t, split_part(t, ' ', 1)[1:4] AS block FROM n WHERE t <> '')
SELECT a.k AS reference_id, b.k AS candidate_id, levenshtein(a.t, b.t)::INTEGER AS score FROM b a JOIN b ON a.block = b.block WHERE levenshtein(a.t, b.t) <= 1""")
def match_token_prefix_block(spark, sf_dir):
    """Blocks by the first four bytes of the first word."""
    p = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return match.by_edits(p, p, "s_suppkey", "s_name", "token_prefix", 4, 1, most_candidates=None)


@query(f"WITH n AS (SELECT p_partkey AS k, {_norm('p_name')} AS t FROM part) SELECT a.k AS reference_id, b.k AS candidate_id, levenshtein(a.t, b.t)::INTEGER AS score FROM n a JOIN n b ON a.t[1:3] = b.t[1:3] WHERE a.t <> '' AND levenshtein(a.t, b.t) <= 3")
def match_levenshtein_block(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return match.by_edits(p, p, "p_partkey", "p_name", "prefix", 3, 3, most_candidates=None)


@query()
def match_composite(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return match.by_composite(p, p, "p_partkey", "p_name", "prefix", 3, most_candidates=None)


_EXACT = ORACLES["match_exact_docs"]


@query(f"WITH m AS ({_EXACT}) SELECT (SELECT count(*) FROM documents)::BIGINT AS reference_rows, (SELECT count(*) FROM documents)::BIGINT AS candidate_rows, count(*)::BIGINT AS matches FROM m")
def match_summary(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return match.counts(d, d, match.exact_counts(d, d, "doc_id", "text"))


@query(f"WITH m AS ({_EXACT}) SELECT candidate_id, count(*)::BIGINT AS matches FROM m GROUP BY 1 HAVING count(*) > 3")
def match_caps(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return match.exact_counts(d, d, "doc_id", "text").where("matches > 3")


# ---- graph

_CUSTOMER = graph.ObjectMapping(
    "Customer",
    (graph.Property("customer_key", "c_custkey", "integer"),),
    (graph.Property("name", "c_name", transforms=("trim", "upper"), required=True, max_length=40), graph.Property("segment", "c_mktsegment", "enum", values=("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")), graph.Property("balance", "c_acctbal", "decimal", minimum=-900.0)),
)
_NATION = graph.ObjectMapping("Nation", (graph.Property("nation_key", "n_nationkey", "integer"),), (graph.Property("name", "n_name"),))
_REGION = graph.ObjectMapping("Region", (graph.Property("region_key", "n_regionkey", "integer"),))
_MAPPING = graph.Mapping((_CUSTOMER, _NATION, _REGION), (graph.RelationMapping("LIVES_IN", _CUSTOMER, _NATION), graph.RelationMapping("PART_OF", _NATION, _REGION)))


def _joined(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation")
    return _t(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations


def _records(spark, sf_dir):
    return graph.split(_joined(spark, sf_dir), _MAPPING)


_STORES: dict[tuple[str, str], Store] = {}


def _store(spark, sf_dir) -> Store:
    """The graph of customers, nations and regions: imported once a session, into its shared folder, and read by all queries on the graph."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = Store(spark, f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
        store.load(_joined(spark, sf_dir), _MAPPING, "c_custkey")
        _STORES[key] = store
    return _STORES[key]


_NS = graph.NAMESPACE.replace("-", "")


def _uuid(name):
    h = f"sha1(unhex('{_NS}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _key(prop, column):
    return f"""('[{{"property":"{prop}","type":"integer","value":' || {column}::VARCHAR || '}}]')"""


def _plain(column):
    """A double as a plain decimal without trailing zeros."""
    return f"regexp_replace(rtrim({column}::VARCHAR::DECIMAL(38,18)::VARCHAR, '0'), '[.]$', '')"


_CK, _NK, _RK = _key("customer_key", "c_custkey"), _key("nation_key", "n_nationkey"), _key("region_key", "n_regionkey")
_BAD = """CASE WHEN length(c_name) > 40 THEN 'name: too long' WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN 'segment: not allowed'
  WHEN c_acctbal < -900 THEN 'balance: below minimum' END"""
_G = f"""WITH rec AS (SELECT *, {_BAD} AS error FROM customer JOIN nation ON c_nationkey = n_nationkey),
good AS (SELECT *, {_uuid(f"'Customer:' || {_CK}")} AS cid, {_uuid(f"'Nation:' || {_NK}")} AS nid, {_uuid(f"'Region:' || {_RK}")} AS rid FROM rec WHERE error IS NULL),
obj AS (SELECT DISTINCT cid AS object_id, 'Customer' AS object_type, {_CK} AS canonical_key FROM good
  UNION SELECT nid, 'Nation', {_NK} FROM good UNION SELECT rid, 'Region', {_RK} FROM good),
rel AS (SELECT DISTINCT {_uuid("'LIVES_IN:' || cid || ':' || nid")} AS relation_id, 'LIVES_IN' AS relation_type, cid AS source_id, nid AS target_id FROM good
  UNION SELECT {_uuid("'PART_OF:' || nid || ':' || rid")}, 'PART_OF', nid, rid FROM good),
ass AS (SELECT c_custkey AS "offset", cid AS subject_id, 'customer_key' AS predicate, 'integer' AS value_type, c_custkey::VARCHAR AS value, 'observed' AS kind FROM good
  UNION ALL SELECT c_custkey, cid, 'name', 'string', upper(c_name), CASE WHEN upper(c_name) = c_name THEN 'observed' ELSE 'transformed' END FROM good
  UNION ALL SELECT c_custkey, cid, 'segment', 'enum', c_mktsegment, 'observed' FROM good
  UNION ALL SELECT c_custkey, cid, 'balance', 'decimal', {_plain('c_acctbal')}, 'observed' FROM good
  UNION ALL SELECT c_custkey, nid, 'nation_key', 'integer', n_nationkey::VARCHAR, 'observed' FROM good
  UNION ALL SELECT c_custkey, nid, 'name', 'string', n_name, 'observed' FROM good
  UNION ALL SELECT c_custkey, rid, 'region_key', 'integer', n_regionkey::VARCHAR, 'observed' FROM good)
"""


@query(_G + "SELECT * FROM obj")
def mat_objects(spark, sf_dir):
    return graph.objects(_records(spark, sf_dir)[0], _MAPPING)


@query(_G + "SELECT * FROM rel")
def mat_relations(spark, sf_dir):
    return graph.relations(_records(spark, sf_dir)[0], _MAPPING)


def _assertions(spark, sf_dir):
    return graph.assertions(_records(spark, sf_dir)[0], _MAPPING, "c_custkey")


@query(_G + 'SELECT * FROM ass')
def mat_assertions(spark, sf_dir):
    """All seven properties of the mapping."""
    return _assertions(spark, sf_dir).select("offset", "subject_id", "predicate", "value_type", "value", "kind")


@query(_G + "SELECT c_custkey, error FROM rec WHERE error IS NOT NULL")
def mat_quarantine(spark, sf_dir):
    return _records(spark, sf_dir)[1].select("c_custkey", "error")


@query(_G + "SELECT object_id, object_type FROM obj WHERE object_id IN (SELECT subject_id FROM ass WHERE predicate = 'name' AND value = 'CUSTOMER#000000007')")
def graph_lookup(spark, sf_dir):
    found = _store(spark, sf_dir).lookup("name", "CUSTOMER#000000007")
    return found.select("object_id", "object_type")


_FIND = {
    "equals": ("segment", "equals", "BUILDING", "value = 'BUILDING'"),
    "not_equals": ("segment", "not_equals", "BUILDING", "value <> 'BUILDING'"),
    "less": ("customer_key", "less", 500, "value::BIGINT < 500"),
    "at_most": ("customer_key", "at_most", 500, "value::BIGINT <= 500"),
    "greater": ("customer_key", "greater", 500, "value::BIGINT > 500"),
    "at_least": ("customer_key", "at_least", 500, "value::BIGINT >= 500"),
    "contains": ("name", "contains", "99", "contains(value, '99')"),
    "in": ("segment", "in", ("BUILDING", "MACHINERY"), "value IN ('BUILDING', 'MACHINERY')"),
}


def _finder(predicate, op, value):
    return lambda spark, sf_dir: _store(spark, sf_dir).find("Customer", [(predicate, op, value)], 50, 2).select("object_id")


for _op, (_p, _o, _v, _w) in _FIND.items():
    QUERIES[f"graph_find_{_op}"] = _finder(_p, _o, _v)
    ORACLES[f"graph_find_{_op}"] = _G + f"SELECT object_id FROM obj WHERE object_type = 'Customer' AND object_id IN (SELECT subject_id FROM ass WHERE predicate = '{_p}' AND {_w}) ORDER BY object_id LIMIT 50 OFFSET 2"


def _history(spark, sf_dir):
    """Orders as a history of assertions: each order of a customer replaces the one before."""
    o = _t(spark, sf_dir, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(
        F.col("o_orderkey").cast("string").alias("assertion_id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.lit("status").alias("predicate"),
        F.lit("string").alias("value_type"),
        F.col("o_orderstatus").alias("value"),
        F.col("o_orderkey").alias("offset"),
        F.lag(F.col("o_orderkey").cast("string")).over(w).alias("supersedes"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_orderdate") + F.expr("interval 400 days")).cast("timestamp")).alias("valid_to"),
    )


@query("SELECT max(o_orderkey)::VARCHAR AS assertion_id, o_custkey::VARCHAR AS subject_id FROM orders GROUP BY o_custkey")
def graph_active_assertions(spark, sf_dir):
    return graph.active(_history(spark, sf_dir)).select("assertion_id", "subject_id")


@query("""WITH a AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT o_orderkey::VARCHAR AS assertion_id, o_custkey::VARCHAR AS subject_id FROM a WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1997-01-01')""")
def graph_as_of(spark, sf_dir):
    return graph.active(_history(spark, sf_dir), F.lit("1997-01-01").cast("timestamp")).select("assertion_id", "subject_id")


def _start(objects):
    return objects.where("object_type = 'Nation'")


_EDGE = {"outgoing": "SELECT relation_id, relation_type, source_id AS near, target_id AS far FROM rel", "incoming": "SELECT relation_id, relation_type, target_id AS near, source_id AS far FROM rel"}
_EDGE["both"] = f"{_EDGE['outgoing']} UNION ALL {_EDGE['incoming']}"


def _neighbors(direction):
    def run(spark, sf_dir):
        store = _store(spark, sf_dir)
        return store.neighbors(_start(store.table("objects")), direction)

    return run


for _d, _n in (("outgoing", "out"), ("incoming", "in"), ("both", "both")):
    QUERIES[f"graph_neighbors_{_n}"] = _neighbors(_d)
    ORACLES[f"graph_neighbors_{_n}"] = _G + f", e AS ({_EDGE[_d]}) SELECT near AS object_id, relation_id, relation_type, far AS neighbor_id, o.object_type AS neighbor_type FROM e JOIN obj s ON s.object_id = near JOIN obj o ON o.object_id = far WHERE s.object_type = 'Nation'"

_HOP1 = "h1 AS (SELECT DISTINCT far AS id FROM e JOIN obj ON object_id = near WHERE object_type = 'Region')"
_HOP = _G + f", e AS ({_EDGE['incoming']}), {_HOP1}, h2 AS (SELECT DISTINCT far AS id FROM e JOIN h1 ON near = h1.id)"


@query(
    _HOP
    + """ SELECT 'node' AS kind, object_id AS id, 0 AS depth FROM obj WHERE object_type = 'Region' UNION ALL SELECT 'node', id, 1 FROM h1 UNION ALL SELECT 'node', id, 2 FROM h2
UNION ALL SELECT DISTINCT 'edge', relation_id, 1 FROM e WHERE relation_type = 'PART_OF' UNION ALL SELECT DISTINCT 'edge', relation_id, 2 FROM e WHERE relation_type = 'LIVES_IN'"""
)
def graph_traverse_2hop(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store.traverse(store.table("objects").where("object_type = 'Region'"), ["incoming", "incoming"])


@query(
    _HOP
    + """ SELECT 'node' AS kind, object_id AS id, 0 AS depth FROM obj WHERE object_type = 'Region' UNION ALL SELECT 'node', id, 1 FROM h1
UNION ALL SELECT DISTINCT 'edge', relation_id, 1 FROM e WHERE relation_type = 'PART_OF'"""
)
def graph_traverse_include_once(spark, sf_dir):
    """Back to where it came from: the edges are known and the nodes visited, so the second hop adds nothing."""
    store = _store(spark, sf_dir)
    return store.traverse(store.table("objects").where("object_type = 'Region'"), ["incoming", "outgoing"], include_once=True)


@query(
    _HOP1.replace("h1 AS", _G + f", e AS ({_EDGE['incoming']}), h1 AS")
    + """, far AS (SELECT DISTINCT far AS id FROM e JOIN h1 ON near = h1.id JOIN ass ON subject_id = far WHERE predicate = 'segment' AND value = 'BUILDING'),
pick AS (SELECT id FROM far ORDER BY id LIMIT 40)
SELECT 'node' AS kind, object_id AS id, 0 AS depth FROM obj WHERE object_type = 'Region' UNION ALL SELECT 'node', id, 1 FROM h1 UNION ALL SELECT 'node', id, 2 FROM pick
UNION ALL SELECT DISTINCT 'edge', relation_id, 1 FROM e WHERE relation_type = 'PART_OF' UNION ALL SELECT DISTINCT 'edge', relation_id, 2 FROM e JOIN pick ON far = pick.id WHERE relation_type = 'LIVES_IN'"""
)
def graph_traverse_filtered(spark, sf_dir):
    """From regions to nations to customers of one segment; the walk ends with its limit of new nodes."""
    store = _store(spark, sf_dir)
    hops = [graph.Hop("incoming", ("PART_OF",), "Nation"), graph.Hop("incoming", ("LIVES_IN",), "Customer", (("segment", "equals", "BUILDING"),))]
    nations = store.table("objects").where("object_type = 'Nation'").count()
    return store.traverse(store.table("objects").where("object_type = 'Region'"), hops, most_nodes=nations + 40)


@query(_G + f", e AS ({_EDGE['both']}) SELECT near AS object_id, relation_id, relation_type, far AS neighbor_id, o.object_type AS neighbor_type FROM e JOIN obj s ON s.object_id = near JOIN obj o ON o.object_id = far WHERE s.object_type = 'Nation' ORDER BY relation_id, near LIMIT 50 OFFSET 10")
def graph_neighbors_page(spark, sf_dir):
    """A page of neighbors in the order of relations."""
    store = _store(spark, sf_dir)
    return store.neighbors(_start(store.table("objects")), "both", limit=50, offset=10)


@query(_G + f"SELECT subject_id, predicate, value FROM (SELECT *, {_uuid("'run:' || \"offset\" || ':' || subject_id || ':' || predicate || ':' || value")} AS assertion_id FROM ass) WHERE predicate = 'segment' ORDER BY assertion_id LIMIT 100")
def graph_assertion_page(spark, sf_dir):
    return _store(spark, sf_dir).assertions(F.col("subject_id").isNotNull(), predicate="segment").select("subject_id", "predicate", "value")


@query(_G + "SELECT object_id, object_type FROM obj ORDER BY object_id LIMIT 30 OFFSET 5")
def store_scan_page(spark, sf_dir):
    return _store(spark, sf_dir).scan("objects", 30, 5).select("object_id", "object_type")


@query(_G + "SELECT object_id, object_type, coalesce((SELECT min(value) FROM ass WHERE subject_id = object_id AND predicate = 'name'), canonical_key) AS label FROM obj")
def graph_nodes(spark, sf_dir):
    """Nodes with labels, for a picture of the graph."""
    store = _store(spark, sf_dir)
    return graph.labelled(store.table("objects"), store.table("assertions"))


@query(_G + "SELECT relation_id AS id, relation_type AS label, source_id AS source, target_id AS target FROM rel")
def graph_edges(spark, sf_dir):
    return _store(spark, sf_dir).table("relations").select(F.col("relation_id").alias("id"), F.col("relation_type").alias("label"), F.col("source_id").alias("source"), F.col("target_id").alias("target"))


@query(_G + 'SELECT DISTINCT subject_id, "offset" FROM ass WHERE predicate = \'region_key\'')
def graph_provenance(spark, sf_dir):
    return _store(spark, sf_dir).provenance(F.col("predicate") == "region_key")


@query(_G + "SELECT * FROM obj WHERE object_type <> 'Nation'")
def store_insert_if_absent(spark, sf_dir):
    objects = _store(spark, sf_dir).table("objects")
    return graph.insert_if_absent(objects.where("object_type = 'Nation'"), objects.unionByName(objects), "object_id")


@query(_G + "SELECT 'objects' AS table_name, count(*)::BIGINT AS row_count FROM obj UNION ALL SELECT 'relations', count(*)::BIGINT FROM rel UNION ALL SELECT 'assertions', count(*)::BIGINT FROM ass UNION ALL SELECT 'resolutions', 0::BIGINT UNION ALL SELECT 'schemas', 0::BIGINT")
def store_statistics(spark, sf_dir):
    return _store(spark, sf_dir).statistics()


@query(_G + "SELECT relation_id FROM rel WHERE relation_type = 'PART_OF'")
def store_bad_ends(spark, sf_dir):
    return graph.bad_ends(_store(spark, sf_dir).table("relations"), _store(spark, sf_dir).table("objects"), "Customer", "Nation").select("relation_id")


_INFER = [
    reason.Rule("a-builder", (reason.Condition("customer_key"), reason.Condition("segment", "equals", "BUILDING")), "trade", "building"),
    reason.Rule("b-visit", (reason.Condition("trade", "equals", "building"), reason.Condition("name")), "visit", "due"),
]


@query(_G + "SELECT subject_id, 'trade' AS predicate, 'building' AS value, 'a-builder' AS rule_id, 1 AS iteration FROM ass WHERE predicate = 'segment' AND value = 'BUILDING' UNION ALL SELECT subject_id, 'visit', 'due', 'b-visit', 2 FROM ass WHERE predicate = 'segment' AND value = 'BUILDING'")
def reason_fixpoint(spark, sf_dir):
    """All facts: the limit that an interactive call has by default is lifted."""
    facts = reason.apply(_store(spark, sf_dir).table("assertions"), _INFER, most_assertions=None, most_objects=None)[0]
    return facts.select("subject_id", "predicate", "value", "rule_id", "iteration")


@query(_G + "SELECT 1 AS depth, count(*)::BIGINT * 4 AS links FROM ass WHERE predicate = 'segment' AND value = 'BUILDING' UNION ALL SELECT 2, count(*)::BIGINT * 2 FROM ass WHERE predicate = 'segment' AND value = 'BUILDING'")
def reason_explain(spark, sf_dir):
    facts = reason.apply(_store(spark, sf_dir).table("assertions"), _INFER, most_assertions=None, most_objects=None)[0]
    return reason.explain(facts).groupBy("depth").agg(F.count("*").alias("links"))


_COPY = [
    reason.Rule("copy-name", (reason.Condition("name"), reason.Condition("segment", "not_equals", "BUILDING")), "greeting", copy_from="name", confidence=0.5),
    reason.Rule("greeted", (reason.Condition("greeting"), reason.Condition("customer_key")), "served", "yes", confidence=0.5),
]
_DECLARED = {"name": "string", "segment": "enum", "customer_key": "integer", "greeting": "string", "served": "string"}


@query(
    _G
    + """, c AS (SELECT n.subject_id, n.value, n.observed_at, n.v FROM (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST("offset" % 30 AS INTEGER)) AS observed_at, 1 + "offset" % 3 AS v FROM ass) n
  WHERE predicate = 'name' AND subject_id IN (SELECT subject_id FROM ass WHERE predicate = 'segment' AND value <> 'BUILDING'))
SELECT subject_id, 'greeting' AS predicate, value, 0.45::DECIMAL(19,18)::VARCHAR AS confidence, strftime(observed_at, '%Y-%m-%d') AS observed_at, v::INTEGER AS mapping_version FROM c
UNION ALL SELECT subject_id, 'served', 'yes', 0.225::DECIMAL(19,18)::VARCHAR, strftime(observed_at, '%Y-%m-%d'), v::INTEGER FROM c"""
)
def reason_combine(spark, sf_dir):
    """Conclusions that copy a value and carry confidence, observation and mapping version on; rules are checked against declared predicates."""
    known = _store(spark, sf_dir).table("assertions").withColumns(
        {"observed_at": F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(offset % 30 as int))"), "mapping_version": (1 + F.col("offset") % 3).cast("int"), "confidence": F.lit("0.9").cast("decimal(19,18)")}
    )
    facts = reason.apply(known, _COPY, most_assertions=None, most_objects=None, declared=_DECLARED)[0]
    return facts.select("subject_id", "predicate", "value", F.col("confidence").cast("string").alias("confidence"), F.date_format("observed_at", "yyyy-MM-dd").alias("observed_at"), "mapping_version")


@query("""WITH h AS (SELECT *, 1 + o_orderkey % 3 AS k FROM orders), a AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'O') AS s1, min(o_orderkey::VARCHAR) FILTER (o_orderstatus = 'O') AS i1, min(o_orderkey::VARCHAR) FILTER (o_orderstatus = 'F') AS i2 FROM orders GROUP BY 1),
p AS (SELECT a.o_custkey, x.o_orderdate AS f1, y.o_orderdate AS f2, x.o_orderdate + INTERVAL 700 DAY AS t1, y.o_orderdate + INTERVAL 400 DAY AS t2 FROM a JOIN orders x ON x.o_orderkey::VARCHAR = i1 JOIN orders y ON y.o_orderkey::VARCHAR = i2)
SELECT o_custkey::VARCHAR AS subject_id, strftime(greatest(f1, f2), '%Y-%m-%d') AS valid_from, strftime(least(t1, t2), '%Y-%m-%d') AS valid_to FROM p WHERE greatest(f1, f2) <= least(t1, t2)""")
def reason_temporal(spark, sf_dir):
    """What follows holds while all premises do; premises that never hold together yield nothing."""
    o = _t(spark, sf_dir, "orders")
    days = F.when(F.col("o_orderstatus") == "F", F.expr("interval 400 days")).otherwise(F.expr("interval 700 days"))
    facts = o.select(
        F.col("o_orderkey").cast("string").alias("assertion_id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.lit("status").alias("predicate"),
        F.col("o_orderstatus").alias("value"),
        F.lit(None).cast("string").alias("supersedes"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        (F.col("o_orderdate") + days).cast("timestamp").alias("valid_to"),
    )
    rule = reason.Rule("both", (reason.Condition("status", "equals", "O"), reason.Condition("status", "equals", "F")), "mixed", "yes")
    return reason.apply(facts, [rule], most_assertions=None, most_objects=None)[0].select("subject_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_to")])


# ---- mapping: identities of text and decimals, defaults, contracts, properties of relations

_ORDER = graph.ObjectMapping("Order", (graph.Property("label", "label"), graph.Property("price", "price", "decimal")), (graph.Property("channel", "channel", default="shop"), graph.Property("day", "day", "date")))
_BUYER = graph.ObjectMapping("Buyer", (graph.Property("customer_key", "o_custkey", "integer"),))
_SALES = graph.Mapping((_ORDER, _BUYER), (graph.RelationMapping("BOUGHT", _BUYER, _ORDER, properties=(graph.Property("priority", "o_orderpriority", transforms=("lower",)),), confidence="0.75"),), "sales", 2)
_MARKS = """']}"' || chr(92) || '{[' """


def _sales(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    label = F.concat("o_orderstatus", F.lit(']}"\\{['), "o_orderpriority")
    price = F.concat(F.format_string("%.2f", F.round("o_totalprice", -2)), F.lit("00"))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", label.alias("label"), price.alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_SK = f"""('[{{"property":"label","type":"string","value":' || to_json(o_orderstatus || {_MARKS} || o_orderpriority)::VARCHAR || '}},{{"property":"price","type":"decimal","value":"' || regexp_replace(rtrim(round(o_totalprice, -2)::DECIMAL(18,2)::VARCHAR, '0'), '[.]$', '') || '"}}]')"""
_BK = _key("customer_key", "o_custkey")
_S = f"""WITH s AS (SELECT *, {_SK} AS sk, {_uuid(f"'Order:' || {_SK}")} AS oid, {_uuid(f"'Buyer:' || {_BK}")} AS bid FROM orders)
"""


@query(_S + f"SELECT DISTINCT oid AS object_id, 'Order' AS object_type, sk AS canonical_key FROM s UNION SELECT bid, 'Buyer', {_BK} FROM s")
def mat_identity_text(spark, sf_dir):
    """Identities of text with brackets, quotes and backslashes and of decimals with trailing zeros."""
    return graph.objects(graph.split(_sales(spark, sf_dir), _SALES)[0], _SALES)


@query(_S + "SELECT o_orderkey AS \"offset\", oid AS subject_id, 'channel' AS predicate, 'shop' AS value, 'transformed' AS kind, 'default@1' AS transformations FROM s UNION ALL SELECT o_orderkey, oid, 'day', strftime(o_orderdate, '%Y-%m-%d'), 'observed', '' FROM s")
def mat_defaults(spark, sf_dir):
    """A property whose column the source lacks takes its default, and the provenance says so."""
    found = graph.assertions(graph.split(_sales(spark, sf_dir), _SALES)[0], _SALES, "o_orderkey")
    return found.where(F.col("predicate").isin("channel", "day")).select("offset", "subject_id", "predicate", "value", "kind", F.concat_ws(",", "transformations").alias("transformations"))


@query(_S + f"SELECT o_orderkey AS \"offset\", {_uuid("'BOUGHT:' || bid || ':' || oid")} AS subject_id, lower(o_orderpriority) AS value, CASE WHEN lower(o_orderpriority) = o_orderpriority THEN 'observed' ELSE 'transformed' END AS kind, '0.75' AS confidence, 2 AS mapping_version FROM s")
def mat_relation_properties(spark, sf_dir):
    found = graph.assertions(graph.split(_sales(spark, sf_dir), _SALES)[0], _SALES, "o_orderkey").where("predicate = 'priority'")
    return found.select("offset", "subject_id", "value", "kind", graph.canonical(F.col("confidence").cast("string"), "decimal").alias("confidence"), "mapping_version")


@query(_S + f"SELECT DISTINCT {_uuid("'NEAR:' || least(bid, oid) || ':' || greatest(bid, oid)")} AS relation_id, 'NEAR' AS relation_type, least(bid, oid) AS source_id, greatest(bid, oid) AS target_id FROM s")
def mat_undirected(spark, sf_dir):
    """An undirected relation has its smaller end first."""
    either = graph.Mapping((_ORDER, _BUYER), (graph.RelationMapping("NEAR", _BUYER, _ORDER, directed=False),))
    return graph.relations(_sales(spark, sf_dir), either)


_CONTRACT = graph.SourceContract("sales", (graph.SourceField("o_orderkey", "integer", False, True), graph.SourceField("o_custkey", "integer"), graph.SourceField("o_orderpriority"), graph.SourceField("label", nullable=False), graph.SourceField("price", "decimal"), graph.SourceField("day", "date")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'note: outside the contract' WHEN o_orderkey % 7 = 0 THEN 'label: null against the contract' WHEN o_orderkey % 5 = 0 THEN 'price: not of type decimal' ELSE 'day: not of type date' END AS error
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0""")
def mat_contract(spark, sf_dir):
    """Records that break the source's contract, with the first breach."""
    k = F.col("o_orderkey")
    rows = _sales(spark, sf_dir).withColumns(
        {
            "note": F.when(k % 11 == 0, "x"),
            "label": F.when(k % 7 != 0, F.col("label")),
            "price": F.when(k % 5 == 0, F.concat("price", F.lit(" EUR"))).otherwise(F.col("price")),
            "day": F.when(k % 3 == 0, F.replace("day", F.lit("-"), F.lit("/"))).otherwise(F.col("day")),
        }
    )
    return graph.split(rows, _SALES, _CONTRACT)[1].select("o_orderkey", "error")


_PAIRS = f"WITH n AS (SELECT doc_id::VARCHAR AS id, {_norm('text')} AS t, n_chars FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id FROM n a JOIN n b ON a.t = b.t WHERE a.id <> b.id AND a.t <> '')"


def _candidates(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pairs = match.exact(d, d, "doc_id", "text").select(F.col("reference_id").alias("a"), F.col("candidate_id").alias("b"))
    return reason.candidates(pairs, F.lit(1.0))


@query(_PAIRS + f" SELECT {_uuid('''\'candidate:\' || left_id || \':\' || right_id''')} AS candidate_id, left_id, right_id, 1.0::DOUBLE AS confidence FROM p")
def resolve_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(
    _PAIRS
    + f""", c AS (SELECT left_id, right_id, {_uuid("'canonical:' || left_id || ':' || right_id")} AS cid FROM p), o AS (SELECT id, min(cid) AS cid FROM (SELECT left_id AS id, cid FROM c UNION ALL SELECT right_id, cid FROM c) GROUP BY id)
SELECT doc_id::VARCHAR AS object_id, coalesce(o.cid, doc_id::VARCHAR) AS canonical_id FROM documents LEFT JOIN o ON o.id = doc_id::VARCHAR"""
)
def resolve_canonical(spark, sf_dir):
    objects = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("object_id"))
    return reason.resolve(objects, reason.decide(_candidates(spark, sf_dir), 0.9), "least")


@query("""SELECT '{"contract_version":1,"record":{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"},"source":{"source_id":"nation","batch_id":0,"row_id":' || n_nationkey || ',"global_offset":' || n_nationkey || ',"observed_at":"2024-01-01T00:00:00Z"},"run_id":"run-1"}' AS line FROM nation""")
def export_envelope(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return envelopes(_texts(n).withColumn("_offset", F.col("n_nationkey").cast("long")), "nation", "run-1", "2024-01-01T00:00:00Z")


@query("""WITH r AS (SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 2 = 1 THEN (s_suppkey - 1)::VARCHAR END AS other FROM supplier), m AS (SELECT other, id, """ + _uuid("'canonical:' || least(other, id) || ':' || greatest(other, id)") + """ AS cid FROM r WHERE other IN (SELECT id FROM r)),
two AS (SELECT other AS id, cid FROM m UNION ALL SELECT id, cid FROM m)
SELECT r.id AS asked_id, CASE WHEN two.cid IS NOT NULL AND r.id::BIGINT % 4 < 2 THEN two.cid ELSE r.id END AS object_id FROM r LEFT JOIN two ON two.id = r.id""")
def resolve_get_object(spark, sf_dir):
    """Suppliers merged in pairs; the merged object is stored for every other pair, and elsewhere the one asked for answers."""
    own = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("object_id"))
    pairs = own.where("cast(object_id as long) % 2 = 1").select(F.col("object_id").alias("a"), (F.col("object_id").cast("long") - 1).cast("string").alias("b"))
    pairs = pairs.join(own.withColumnRenamed("object_id", "b"), "b", "left_semi").select("a", "b")
    decided = reason.decide(reason.candidates(pairs, F.lit(1.0)), 0.9)
    stored = decided.where("least(cast(left_id as long), cast(right_id as long)) % 4 < 2").select(F.col("canonical_id").alias("object_id"))
    return reason.get_object(own.unionByName(stored), decided, own).select("asked_id", "object_id")
