import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph import catalogue
from qualigraph.functions.similarity import jaro_winkler_bytes
from qualigraph.operators import clean, graph, match, profile, reason, validate


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "é")], "n int, s string")
    rows = {r.column_name: r for r in profile.report(df).collect()}
    assert (rows["n"].null_count, rows["n"].mean, rows["n"].variance) == (1, 1.5, 0.5)
    assert (rows["s"].min_bytes, rows["s"].max_bytes, rows["s"].distinct_count, rows["s"].mode) == (1, 2, 2, "exact")
    assert rows["n"].batches == 1 and rows["n"].schema_hash == clean.schema_hash(df.schema) and rows["s"].pattern is None
    mails = profile.report(spark.createDataFrame([(i, f"a{i}@b.c") for i in range(12)], "k int, s string"), order="k", batch_size=5).collect()
    assert [(r.pattern, r.batches) for r in mails] == [(None, 3), ("email", 3)]
    assert profile.report(df.limit(0)).count() == 2
    assert profile.nulls(df.limit(0)).first().null_rate == 0
    many = spark.range(30_000).withColumn("k", F.col("id") % 5)
    found = {r.column_name: r for r in profile.distinct(many).collect()}
    assert found["id"].mode == "approximate" and abs(found["id"].distinct_count - 30_000) < 1500 and found["k"].distinct_count == 5
    offsets = [r._offset for r in profile.numbered(many, "id").orderBy("id").collect()]
    assert offsets == list(range(30_000))


def test_patterns(spark):
    df = spark.createDataFrame([(i, "a@b.c" if i < 9 else "x") for i in range(10)], "k int, s string")
    assert profile.patterns(df, "s", "k").first().pattern == "email"
    assert profile.patterns(df.where("k > 5"), "s", "k").first().pattern is None


def test_rules(spark):
    df = spark.createDataFrame([(5, "NL-7", "oak", 40), (6, "NL-7", None, None), (8, None, "elm", 12), (9, "NL-7", "oak", 12)], "o int, code string, wood string, age int")
    rules = [
        validate.Rule(11, "code", "string_length", max_length=3),
        validate.Rule(12, "age", "required"),
        validate.Rule(13, "age", "range", min="15", max="30"),
        validate.Rule(14, "wood", "enum_values", values=("oak", "ash")),
        validate.Rule(15, "code", "unique"),
        validate.Rule.from_json({"id": 16, "column": "wood", "tag": "regex", "regex": "k$", "values": None}),
    ]
    found = validate.violations(df, rules, "o")
    got = [(r.offset, r.rule_id, r.code) for r in validate.sample(found).collect()]
    want = [(5, 11, "invalid_length"), (5, 13, "above_maximum"), (6, 11, "invalid_length"), (6, 12, "required_missing"), (6, 15, "duplicate_value"), (8, 13, "below_minimum"), (8, 14, "enum_mismatch"), (8, 16, "regex_mismatch")]
    assert got == [*want, (9, 11, "invalid_length"), (9, 13, "below_minimum"), (9, 15, "duplicate_value")]
    assert validate.totals(df, found).first() == (4, 4, 11)
    assert {r.rule_id: r.violation_count for r in validate.by_rule(found, rules).collect()} == {11: 3, 12: 1, 13: 3, 14: 1, 15: 2, 16: 1}
    only = validate.violations(df, [validate.Rule(1, "age", "unique")], "o").collect()
    assert [(r.offset, r.code) for r in only] == [(9, "duplicate_value")]


@pytest.mark.parametrize("rule", [
    validate.Rule(1, "nope", "required"), validate.Rule(1, "s", "range", min="1"), validate.Rule(1, "n", "range"), validate.Rule(1, "n", "range", min="2", max="1"),
    validate.Rule(1, "s", "enum_values"), validate.Rule(1, "n", "regex", regex="a"), validate.Rule(1, "s", "string_length", min_length=2, max_length=1), validate.Rule(1, "s", "odd"), validate.Rule(1, "s", "pattern", pattern="odd"),
])
def test_wrong_rules(rule):
    with pytest.raises(validate.RuleError):
        validate.check([rule], T.StructType().add("s", "string").add("n", "integer"))


def test_clean_audit_and_replay(spark):
    df = spark.createDataFrame([(i, f" Name{i} ") for i in range(10)], "o long, name string")
    steps = [clean.Transform("trim", "name"), clean.Transform("uppercase", "name"), clean.Transform("replace", "name", "NAME", "n")]
    log = clean.audit(df, steps, "o", "r", "s", batch_size=4)
    assert [(r.batch_id, r.first_row, r.end_row) for r in log.orderBy("batch_id").collect()] == [(0, 0, 4), (1, 4, 8), (2, 8, 10)]
    rows, problems = clean.replay(df, log, steps, "o", "s", batch_size=4)
    assert [r.name for r in rows.orderBy("o").collect()] == [f"n{i}" for i in range(10)] and problems.count() == 0
    assert {r.problem for r in clean.replay(df, log, steps[:1], "o", "s", batch_size=4)[1].collect()} == {"params_hash_differs"}
    assert {r.problem for r in clean.replay(df, log.where("batch_id = 0"), steps, "o", "s", batch_size=4)[1].collect()} == {"missing_entry"}
    for bad in (("odd", "c"), ("replace", "c"), ("replace", "c", "", "x"), ("trim", "c", "x")):
        with pytest.raises(ValueError):
            clean.Transform(*bad)


def test_matching(spark):
    left = spark.createDataFrame([(1, " Jon  SMITH"), (2, None), (3, ""), (4, "jon smith")], "k long, s string")
    right = spark.createDataFrame([(10, "jon smith"), (11, "jon smyth"), (12, None)], "k long, s string")
    assert sorted(map(tuple, match.exact(left, right, "k", "s").collect())) == [(1, 10), (4, 10)]
    found = match.by_edits(left, right, "k", "s", "prefix", 3, 1)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 0), (1, 11, 1), (4, 10, 0), (4, 11, 1)]
    assert match.by_composite(left, right, "k", "s").count() == 4
    assert match.summary(left, right, found, batch_size=2).first() == (4, 3, 4, 2, 2)
    assert sorted(map(tuple, match.exact_counts(left, right, "k", "s").collect())) == [(10, 2)]
    long = spark.createDataFrame([(1, "x" * 500), (2, "X" * 500 + " "), (3, "x" * 501)], "k long, s string")
    assert sorted(map(tuple, match.exact(long, long, "k", "s").collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    first, n = match.sample(found, 2)
    assert [(r.candidate_id, r.reference_id) for r in first.collect()] == [(10, 1), (10, 4)] and n == 4
    assert match.by_edits(left, right, "k", "s", "prefix", 3, 1, most_candidates=2).count() == 4
    with pytest.raises(Exception, match="too many candidates"):
        match.by_edits(left, right, "k", "s", "prefix", 3, 1, most_candidates=1).collect()
    assert match.over_limit(found, 1).count() == 2 and match.capped(found, 2).count() == 4
    with pytest.raises(Exception, match="too many matches"):
        match.capped(found, 1).collect()
    with pytest.raises(ValueError):
        match.by_edits(left, right, "k", "s", "whole")


def pairs_by_hand(left, right, size, most):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    met = [(k, n, edits(a.encode(), b.encode())) for k, a in left for n, b in right if a and b and a.encode()[:size] == b.encode()[:size]]
    return sorted(((k, n, d) for k, n, d in met if d <= most), key=str)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_fuzzy_matching_finds_every_pair(spark, monkeypatch, most):
    """Against brute force: many rows of a form, forms of a block over several units, null keys, bytes beyond ASCII, long forms."""
    monkeypatch.setattr(match, "UNIT", 3)
    monkeypatch.setattr(match, "LONGEST_NEIGHBOURHOOD", 12)
    draw = random.Random(most)
    names = ["".join(draw.choice("abé") for _ in range(draw.randint(1, 7))) for _ in range(40)] + ["aab" + "c" * n for n in range(5, 13)] + ["aab", "aab" + "c" * 8 + "d"]
    left = [(draw.choice([None, *range(90)]), draw.choice(names)) for _ in range(140)] + [(7, "aab")] * 8
    right = [(i, draw.choice(names)) for i in range(110)]
    a, b = (spark.createDataFrame(rows, "k long, s string") for rows in (left, right))
    found = match.by_edits(a, b, "k", "s", "prefix", 2, most, most_candidates=None)
    assert sorted(map(tuple, found.collect()), key=str) == pairs_by_hand(left, right, 2, most)


def test_token_prefix_block_beyond_the_limit_of_candidates(spark, tmp_path):
    """All suppliers are one block; this one has more than 10,000 rows."""
    names = F.concat(F.lit("Supplier#"), F.md5(F.col("s_suppkey").cast("string")))
    spark.range(10_001).select(F.col("id").alias("s_suppkey")).withColumn("s_name", names).write.parquet(str(tmp_path / "supplier.parquet"))
    found = catalogue.QUERIES["match_token_prefix_block"](spark, str(tmp_path))
    assert found.agg(F.count("*"), F.count_if(F.expr("reference_id = candidate_id and score = 0")), F.count_distinct("reference_id")).first() == (10_001, 10_001, 10_001)



@pytest.fixture(scope="session")
def crowded_parts(spark, tmp_path_factory):
    """One block of 10,100 parts: 101 names far from each other, of 100 parts each."""
    folder = tmp_path_factory.mktemp("crowded")
    names = F.concat(F.lit("Red "), F.md5((F.col("p_partkey") % 101).cast("string")))
    spark.range(10_100).select(F.col("id").alias("p_partkey")).withColumn("p_name", names).write.parquet(str(folder / "part.parquet"))
    return str(folder)


def same_names(found):
    return found.agg(F.count("*"), F.count_if(F.expr("(reference_id - candidate_id) % 101 = 0")), F.count_distinct("reference_id", "candidate_id"), F.min("score"), F.max("score")).first()


def test_composite_beyond_the_limit_of_candidates(spark, crowded_parts):
    assert same_names(catalogue.QUERIES["match_composite"](spark, crowded_parts)) == (1_010_000, 1_010_000, 1_010_000, 1.0, 1.0)


def test_levenshtein_block_beyond_the_limit_of_candidates(spark, crowded_parts):
    assert same_names(catalogue.QUERIES["match_levenshtein_block"](spark, crowded_parts)) == (1_010_000, 1_010_000, 1_010_000, 0, 0)


def test_composite_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(match, "UNIT", 3)
    draw = random.Random(5)
    names = ["mar" + "".join(draw.choice("tinhé") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    left, right = [(i, draw.choice(names)) for i in range(130)] + [(None, names[0])] * 5, [(i, draw.choice(names)) for i in range(100)]
    a, b = (spark.createDataFrame(rows, "k long, s string") for rows in (left, right))
    found = match.by_composite(a, b, "k", "s", most_candidates=None).groupBy("reference_id", "candidate_id", F.round("score", 5)).count().collect()
    texts, want = dict(right), {}
    for k, x in left:
        for _, n, d in pairs_by_hand([(k, x)], right, 3, 99):
            edits = 1 - d / max(len(x.encode()), len(texts[n].encode())) if d <= 3 else 0
            score = 0.4 * edits + 0.6 * jaro_winkler_bytes(x.encode(), texts[n].encode())
            if score >= 0.85:
                want[k, n, round(score, 5)] = want.get((k, n, round(score, 5)), 0) + 1
    assert {tuple(r)[:3]: r[3] for r in found} == want and len(want) > 200


CUSTOMER = graph.ObjectMapping("Customer", (graph.Property("key", "id", transforms=("trim", "upper")),), (graph.Property("name", "name", required=True),))
MAIL = graph.ObjectMapping("Mail", (graph.Property("address", "mail", transforms=("trim", "lower")),))
MAPPING = graph.Mapping((CUSTOMER, MAIL), (graph.RelationMapping("OWNS", CUSTOMER, MAIL),))


def records(spark):
    rows = [(0, " a", "Ann", "X@y.z"), (1, "A ", "Anna", "x@y.z"), (2, "b", None, "q@y.z"), (3, "", "Eve", "e@y.z"), (4, "c", "Cyd", "x@y.z ")]
    return spark.createDataFrame(rows, "o long, id string, name string, mail string")


def test_materialize(spark):
    good, bad = graph.split(records(spark), MAPPING)
    assert {r.o: r.error for r in bad.collect()} == {2: "name: missing", 3: "Customer: no identity"}
    objects, relations, assertions = graph.objects(good, MAPPING), graph.relations(good, MAPPING), graph.assertions(good, MAPPING, "o")
    assert (objects.count(), relations.count(), assertions.count()) == (3, 2, 9)
    assert {r.canonical_key for r in objects.collect()} >= {'[{"property":"key","type":"string","value":"A"}]'}
    assert {r.kind for r in assertions.where("predicate = 'name'").collect()} == {"observed"}
    both = graph.neighbors(objects.where("object_type = 'Mail'"), relations, objects, "incoming")
    assert both.count() == 2 and {r.neighbor_type for r in both.collect()} == {"Customer"}
    walk = graph.traverse(objects.where("canonical_key like '%\"A\"%'"), relations, ["outgoing", "incoming", "outgoing"]).collect()
    assert sorted((r.kind, r.depth) for r in walk) == [("edge", 1), ("edge", 2), ("node", 0), ("node", 1), ("node", 2)]
    assert graph.find(objects, assertions, "Customer", [("name", "contains", "nn"), ("name", "equals", "Anna")]).count() == 1
    assert graph.find(objects, assertions, "Customer", [("name", "at_least", 3)]).count() == 0
    assert graph.insert_if_absent(objects.limit(1), objects, "object_id").count() == 2
    assert graph.collisions(objects, objects.withColumn("object_type", F.lit("x")), "object_id").count() == 3
    assert graph.bad_ends(relations, objects, "Customer", "Mail").count() == 0
    with pytest.raises(ValueError):
        graph.traverse(objects, relations, ["both"] * 17)


def test_every_property_of_the_mapping_is_asserted(spark):
    from qualigraph import catalogue

    sf_dir = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    plain = lambda x: format(Decimal(str(x)).normalize(), "f") if x else "0"
    nations, want = {n.n_nationkey: n for n in read("nation")}, []
    for c in read("customer"):
        n = nations.get(c.c_nationkey)
        if n is None or c.c_mktsegment not in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD") or c.c_acctbal < -900 or len(c.c_name) > 40:
            continue
        want += [(c.c_custkey, "customer_key", str(c.c_custkey)), (c.c_custkey, "name", c.c_name.upper()), (c.c_custkey, "segment", c.c_mktsegment), (c.c_custkey, "balance", plain(c.c_acctbal))]
        want += [(c.c_custkey, "nation_key", str(n.n_nationkey)), (c.c_custkey, "name", n.n_name), (c.c_custkey, "region_key", str(n.n_regionkey))]
    got = catalogue.QUERIES["mat_assertions"](spark, sf_dir).collect()
    assert {r.predicate for r in got} >= {"balance"} and {(r.value_type, r.kind) for r in got if r.predicate == "balance"} == {("decimal", "observed")}
    assert sorted((r.offset, r.predicate, r.value) for r in got) == sorted(want)
    subjects = {r.offset: r.subject_id for r in got if r.predicate == "customer_key"}
    assert all(r.subject_id == subjects[r.offset] for r in got if r.predicate == "balance")


def test_reasoning(spark):
    good, _ = graph.split(records(spark), MAPPING)
    facts = graph.assertions(good, MAPPING, "o")
    rules = [reason.Rule("post", (reason.Condition("address"),), "reach", "mail"), reason.Rule("invite", (reason.Condition("reach", "equals", "mail"), reason.Condition("address", "not_equals", "none")), "guest", copy_from="address", confidence=0.5)]
    found, iterations = reason.apply(facts, rules)
    assert (found.count(), iterations) == (2, 3)
    guest = found.where("predicate = 'guest'").first()
    assert (guest.value, guest.confidence, guest.iteration, guest.mapping_version) == ("x@y.z", Decimal("0.5"), 2, 1)
    assert reason.apply(facts, rules, most_assertions=1)[0].count() == 1
    assert reason.apply(facts, rules, most_iterations=1)[0].count() == 1
    assert reason.apply(facts, rules, most_objects=1)[0].count() <= 2
    assert {r.depth: r.n for r in reason.explain(found).groupBy("depth").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 1}
    declared = {"address": "string", "reach": "string", "guest": "string"}
    assert reason.apply(facts, rules, declared=declared)[0].count() == 2
    for wrong in (declared | {"guest": "integer"}, {"reach": "string", "guest": "string"}):
        with pytest.raises(reason.ReasoningError):
            reason.apply(facts, rules, declared=wrong)
    for make in (lambda: reason.Rule("r", (), "p", "v"), lambda: reason.Rule("r", (reason.Condition("a"),), "p"), lambda: reason.Rule("r", (reason.Condition("a"),), "p", copy_from="b"), lambda: reason.Rule("r", (reason.Condition("a"),), "p", "v", confidence=2)):
        with pytest.raises(reason.ReasoningError):
            make()


def test_inferred_facts_combine_their_premises(spark):
    day = lambda d: None if d is None else datetime(2024, 1, d)
    rows = [  # id, subject, predicate, confidence, observed, from, to
        ("1", "s", "a", Decimal("0.9"), 3, 2, 20),
        ("2", "s", "b", Decimal("0.8"), 5, None, 10),
        ("3", "t", "a", None, 1, 1, 4),
        ("4", "t", "b", None, 2, 5, None),
        ("5", "u", "a", None, None, None, None),
        ("6", "u", "b", None, None, None, None),
    ]
    schema = "assertion_id string, subject_id string, predicate string, value string, supersedes string, confidence decimal(19,18), observed_at timestamp, valid_from timestamp, valid_to timestamp"
    facts = spark.createDataFrame([(i, s, p, "x", None, c, day(o), day(a), day(b)) for i, s, p, c, o, a, b in rows], schema)
    rules = [reason.Rule("r1", (reason.Condition("a"), reason.Condition("b")), "c", "y", confidence=0.9), reason.Rule("r2", (reason.Condition("c"),), "d", "z", confidence=0.5)]
    got = {(r.subject_id, r.predicate): (r.confidence, r.observed_at, r.valid_from, r.valid_to) for r in reason.apply(facts, rules)[0].collect()}
    # t's premises have no day in common
    assert got == {
        ("s", "c"): (Decimal("0.72"), day(5), day(2), day(10)),
        ("s", "d"): (Decimal("0.36"), day(5), day(2), day(10)),
        ("u", "c"): (Decimal("0.9"), None, None, None),
        ("u", "d"): (Decimal("0.45"), None, None, None),
    }
    versions = facts.withColumn("mapping_version", F.col("assertion_id").cast("int"))
    assert {(r.subject_id, r.mapping_version) for r in reason.apply(versions, rules)[0].collect()} == {("s", 2), ("u", 6)}


def test_resolution(spark):
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "d"), ("a", "a"), ("b", "e")], "a string, b string")
    candidates = reason.candidates(pairs, F.when(F.col("a") == "c", 0.5).otherwise(0.95))
    decided = reason.decide(candidates, 0.9)
    assert sorted((r.left_id, r.right_id, r.decision) for r in decided.collect()) == [("a", "b", "merge"), ("b", "e", "merge"), ("c", "d", "reject")]
    assert [r.object_id for r in reason.conflicts(decided).collect()] == ["b"]
    objects = spark.createDataFrame([("a",), ("c",)], "object_id string")
    got = {r.object_id: r.canonical_id for r in reason.resolve(objects, decided, "least").collect()}
    assert got["c"] == "c" and got["a"] != "a"
    with pytest.raises(Exception, match="conflicting merges"):
        reason.resolve(objects, decided).collect()
    once = decided.where("right_id = 'b'")
    kept = objects.withColumn("n", F.lit(1))
    assert [(r.asked_id, r.object_id) for r in reason.get_object(kept, once, objects).orderBy("asked_id").collect()] == [("a", "a"), ("c", "c")]
    merged = once.select(F.col("canonical_id").alias("object_id"), F.lit(2).alias("n"))
    assert [(r.asked_id, r.n) for r in reason.get_object(kept.unionByName(merged), once, objects).orderBy("asked_id").collect()] == [("a", 2), ("c", 1)]
    low, high = reason.intersect([F.lit(1), F.lit(None)], [F.lit(5), F.lit(3)])
    assert spark.range(1).select(low, high).first() == (1, 3)
