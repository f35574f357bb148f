import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.functions import typing
from qualigraph.operators import clean, graph, validate
from qualigraph.plans import registry
from qualigraph.plans.pipeline import Pipeline, PipelineError
from qualigraph.plans.store import Store
from qualigraph.sources import files, sinks
from qualigraph.streaming import incremental


def put(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, 'id,text\n1,"a, ""b""\nc"\n2,\n3,""\n')
    want = [("1", 'a, "b"\nc'), ("2", None), ("3", "")]
    for read in (files.read_csv, files.read_csv_strict):
        assert sorted(map(tuple, read(spark, path).collect())) == want
    assert files.preview(files.read_csv(spark, path), 2)[1] is True


@pytest.mark.parametrize("text,error", [("a,b\n1\n", "MissingColumns"), ("a,b\n1,2,3\n", "ExtraColumns"), ('a,b\n"1,2\n', "UnterminatedQuotedField"), ('a,b\n"1"x,2\n', "CharactersAfterClosingQuote"), ('a,b\n1"2,3\n', "UnexpectedQuote")])
def test_strict_csv_errors(spark, tmp_path, text, error):
    with pytest.raises(Exception, match=error):
        files.read_csv_strict(spark, put(tmp_path, text)).collect()


def test_strict_csv_policies(spark, tmp_path):
    path = put(tmp_path, 'a,b\n1\n"x"y,2\n1,2,3\n\n')
    got = files.read_csv_strict(spark, path, malformed="skip", extra="ignore", missing="pad").collect()
    assert [tuple(r) for r in got] == [("1", None), ("1", "2"), (None, None)]
    for text, error in (("a,a\n", "DuplicateHeaderName"), ("a,\n", "EmptyHeaderName")):
        with pytest.raises(files.SourceError, match=error):
            files.read_csv(spark, put(tmp_path, text))
    short = put(tmp_path, "a,b\n1\n2,3\n", "y.csv")
    assert files.read_csv(spark, short, malformed="skip").count() == 1 and files.read_csv(spark, short, malformed="pad").count() == 2
    with pytest.raises(Exception, match="malformed"):
        files.read_csv(spark, short).collect()


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, '{"id":1,"name":"Ada","active":true,"score":1.5}\n\n{"score":2,"id":2,"name":null}\n')
    df = files.read_jsonl(spark, path)
    assert df.columns == ["id", "name", "active", "score"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Ada", True, 1.5), (2, None, None, 2.0)]
    for text, error in (('{"a":{"b":1}}\n', "Nested"), ('{"a":1}\n{"a":1,"b":2}\n', "UnknownJsonField"), ('{"a":1}\n{"a":"x"}\n', "")):
        with pytest.raises(Exception, match=error):
            files.read_jsonl(spark, put(tmp_path, text, "bad.jsonl")).collect()
    assert files.read_jsonl(spark, put(tmp_path, '{"a":1}\n{"a":1,"b":2}\n', "ok.jsonl"), unknown="ignore").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "", 1.5)], "id long, s string, d double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part*")).count('"a,""b"""') == 1
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())[0] == '{"id":1,"s":"a,\\"b\\"","d":null}'
    with pytest.raises(Exception, match="not finite"):
        sinks.json_lines(df.withColumn("d", F.lit(float("nan")))).collect()
    assert sinks.count_only(df) == 2 and len(sinks.to_memory(df, 2)) == 2
    with pytest.raises(OverflowError):
        sinks.to_memory(df, 1)
    lines = sinks.envelopes(df.select(F.col("s"), F.col("id").alias("_offset")), "src", "run", "2024-01-01T00:00:00Z", start=2)
    back = sinks.read_envelopes(lines, T.StructType().add("s", "string"), "line").collect()
    assert [(r.record.s, r.source.global_offset, r.run_id) for r in back] == [("", 2, "run")]
    with pytest.raises(Exception):
        sinks.read_envelopes(spark.createDataFrame([('{"contract_version":2}',)], "line string"), T.StructType().add("s", "string"), "line").collect()
    found = validate.violations(df, [validate.Rule(1, "d", "required")], "id")
    assert sinks.write_violations(found, str(tmp_path / "v"), 10) == 1


def test_identity(spark, tmp_path):
    path = put(tmp_path, "a\n1\n")
    first = files.identity(spark, path).first()
    put(tmp_path, "a\n2\n3\n")
    second = files.identity(spark, path).first()
    assert first.uri == second.uri and first.source_version != second.source_version and first.content_sha256 != second.content_sha256
    raw = spark.range(1).selectExpr("cast(id as decimal(10,2)) d", "cast(id as int) i", "date'2024-01-01' t")
    assert [f.dataType.simpleString() for f in files.narrowed(raw).schema] == ["string", "bigint", "string"]


def test_pipeline(spark):
    df = spark.createDataFrame([("0", " a ", "1"), ("1", "b", "x")], "o string, s string, n string")
    got = []
    p = Pipeline(df, "o").with_types([typing.Field("o", "i64", True), typing.Field("s", "string", True), typing.Field("n", "i64", True)]).with_profile()
    p.with_validation([validate.Rule(1, "n", "required")]).with_transform(clean.Transform("trim", "s"))
    with pytest.raises(PipelineError, match="DuplicateTransform"):
        p.with_transform(clean.Transform("trim", "s"))
    with pytest.raises(PipelineError, match="MissingSink"):
        p.run()
    r = p.with_sink(lambda d: got.extend(d.collect())).run()
    assert sorted(x.s for x in got) == ["a", "b"] and r.rows == 2 and r.violations.count() == 1
    assert {x.column_name: x.invalid_count for x in r.invalid.collect()} == {"o": 0, "s": 0, "n": 1}
    with pytest.raises(PipelineError, match="AlreadyRun"):
        p.run()


def test_registry():
    p = registry.PropertyType
    one = registry.Definition("d", 1, (registry.ObjectType("A", (p("x", "integer"), p("y", "string", required=True)), ("x",)),))
    two = registry.Definition("d", 2, (registry.ObjectType("A", (p("x", "decimal"), p("z", "string")), ("x",)),))
    r = registry.Registry()
    assert r.publish(one) == [] and r.publish(one) == []
    with pytest.raises(ValueError, match="A.y"):
        r.publish(two)
    assert [(c.path, c.breaking) for c in r.publish(two, {"A.y"})] == [("A.x", False), ("A.y", True), ("A.z", False)]
    assert r.latest("d") is two
    with pytest.raises(ValueError):
        registry.ObjectType("A", (p("x", "string"),), ("q",))


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i, f" n{i % 3} ") for i in range(9)], "o long, name string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.read(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    steps = [clean.Transform("trim", "name")]
    for _ in range(2):  # the second start finds nothing new
        incremental.clean_into(stream, steps, "o", str(tmp_path / "rows"), str(tmp_path / "log"), str(tmp_path / "cp"), "r", "s").awaitTermination()
    assert sorted(r.o for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == list(range(9))
    mapping = graph.Mapping((graph.ObjectMapping("N", (graph.Property("name", "name", transforms=("trim",)),)),))
    incremental.append_objects(stream, mapping, str(tmp_path / "store"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    found = incremental.row_violations(stream, [validate.Rule(1, "name", "string_length", max_length=3)], "o")
    assert found.isStreaming
    with pytest.raises(validate.RuleError):
        incremental.row_violations(stream, [validate.Rule(1, "name", "unique")], "o")


def test_checkpointed_import(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(6)], "o long, name string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    mapping = graph.Mapping((graph.ObjectMapping("N", (graph.Property("name", "name"),)),))
    store, stream = Store(spark, str(tmp_path / "store")), incremental.read(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    go = lambda source="s", run="r": incremental.import_records(stream, mapping, store, str(tmp_path / "cp"), source, run, "o").awaitTermination()
    go()
    rows.limit(3).write.mode("append").parquet(str(tmp_path / "in"))
    go()  # the new file holds records that are known
    assert store.table("objects").count() == 3 and store.table("assertions").count() == 6
    for other in (("s", "r2"), ("s2", "r")):
        with pytest.raises(ValueError, match="checkpoint"):
            go(*other)


def test_bytes_that_are_no_text(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    (tmp_path / "b.csv").write_bytes(b"a,b\n1,\xff\n2,x\n")
    with pytest.raises(Exception, match="InvalidUtf8"):
        files.read_csv_strict(spark, path).collect()
    assert [tuple(r) for r in files.read_csv_strict(spark, path, malformed="skip").collect()] == [("2", "x")]
    assert [tuple(r) for r in files.read_csv_strict(spark, path, invalid_utf8="allow").collect()] == [("1", "\ufffd"), ("2", "x")]
    with pytest.raises(files.SourceError):
        files.read_csv_strict(spark, path, invalid_utf8="odd")
    many = put(tmp_path, 'a,"b\nc"\n"' + "x\n" * 20_000 + '",1\n', "long.csv")  # linear in the length of a quoted field
    assert files.header(spark, many) == ["a", "b\nc"]
    assert [len(r[0]) for r in files.read_csv_strict(spark, many).collect()] == [40_000]


def test_sources_look_alike(spark, tmp_path):
    csv, jsonl = put(tmp_path, "a\n1\n"), put(tmp_path, '{"a":123456789012345678901}\n', "x.jsonl")
    one, two = files.source(spark, "csv", csv), files.source(spark, "jsonl", jsonl)
    assert one.rows.count() == two.rows.count() == 1 and one.capabilities.replayable and one.bytes() == 4 and one.identity().count() == 1
    assert two.schema["a"].dataType.simpleString() == "string" and two.rows.first().a == "123456789012345678901"
    with pytest.raises(files.SourceError):
        files.source(spark, "odd", csv)
    assert files.renamed(one.rows, {"a": "b"}).columns == ["b"]
    for names in ({}, {"a": "b", "c": "d"}):
        with pytest.raises(files.SourceError):
            files.renamed(one.rows, names)


def test_bounded_memory_metrics_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "é")], "id long, s string")
    assert sinks.measured(df, sinks.nowhere, 2)["batches"] == 2 and sinks.measured(df, sinks.nowhere)["bytes"] == 29
    assert len(sinks.to_memory(df, 3, 29, df.schema)) == 3
    for call in (lambda: sinks.to_memory(df, 3, 28), lambda: sinks.to_memory(df, 2)):
        with pytest.raises(OverflowError):
            call()
    with pytest.raises(ValueError):
        sinks.to_memory(df, 3, None, T.StructType().add("id", "string"))
    times = spark.sql("select timestamp'2024-05-06 07:08:09' a, timestamp_ntz'2024-05-06 07:08:09' b, date'2024-05-06' c, cast(null as date) d")
    assert sinks.json_lines(times).first().value == '{"a":"2024-05-06T07:08:09Z","b":"2024-05-06T07:08:09Z","c":"2024-05-06","d":null}'
    with pytest.raises(Exception, match="no ISO text"):
        sinks.json_lines(spark.sql("select cast('+12000-01-01' as date) a")).collect()
    log = clean.audit(df, [clean.Transform("trim", "s")], "id", "r", "s", batch_size=2)
    sinks.write_audit(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    with pytest.raises(Exception, match="two entries"):
        sinks.write_audit(log.unionAll(log), str(tmp_path / "log2"))
    pairs = spark.createDataFrame([(1, 5), (2, 5), (1, 4)], "reference_id long, candidate_id long")
    assert sinks.write_matches(pairs, str(tmp_path / "m"), 2) == 3 and spark.read.json(str(tmp_path / "m")).count() == 2
    assert clean.fnv1a(b"") == 0xCBF29CE484222325 and clean.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_inferred(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "a string, b string")
    rows, report = typing.inferred(df, batch_size=2)
    assert rows.schema["a"].dataType.simpleString() == "bigint" and report == {"rows": 3, "batches": 2, "invalid": {"a": 0, "b": 0}, "schema": [("a", "i64", True), ("b", "string", True)]}
