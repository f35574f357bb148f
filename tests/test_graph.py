import pytest
from pyspark.sql import functions as F

from qualigraph.operators import graph
from qualigraph.plans import mapping as compiler
from qualigraph.plans import registry
from qualigraph.plans.store import CollisionError, Store, schema_rows

P = registry.PropertyType
BOOK, SHELF = "Book", "Shelf"
DEFINITION = registry.Definition(
    "library",
    1,
    (
        registry.ObjectType(BOOK, (P("title", "string"), P("price", "decimal"), P("genre", "string", default="none"), P("out", "date")), ("title", "price")),
        registry.ObjectType(SHELF, (P("number", "integer"),), ("number",)),
    ),
    (registry.RelationType("STANDS_ON", BOOK, SHELF, properties=(P("since", "date"),)),),
)
BOOKS = graph.ObjectMapping(BOOK, (graph.Property("title", "t", transforms=("trim",)), graph.Property("price", "p", "decimal")), (graph.Property("genre", "g", default="none"), graph.Property("out", "d", "date")))
SHELVES = graph.ObjectMapping(SHELF, (graph.Property("number", "n", "integer"),))
MAPPING = graph.Mapping((BOOKS, SHELVES), (graph.RelationMapping("STANDS_ON", BOOKS, SHELVES, properties=(graph.Property("since", "s", "date"),), confidence="0.5"),), "books", 3)
FIELDS = {"t": ("string", False, True), "p": ("string", True, True), "g": ("string", True, False), "d": ("string", True, False), "n": ("integer", True, True), "s": ("string", True, False)}
CONTRACT = graph.SourceContract("books", tuple(graph.SourceField(k, *v) for k, v in FIELDS.items()))
ROWS = [(0, " a]}b ", "1.50", None, 1, "2024-02-03"), (1, "a}b", "1.5", "2020-01-01", 1, None), (2, 'q"\\é', "-0.0", None, 2, None), (3, "x", "1e", None, 2, None), (4, None, "1", None, 1, None), (5, "y", "2", "2020-1-1", 1, None)]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(ROWS, "o long, t string, p string, d string, n int, s string")


def test_identities_and_defaults(books):
    good, bad = graph.split(books, MAPPING, CONTRACT, offset="o")
    assert {r.o: r.error for r in bad.collect()} == {3: "Book: no identity", 4: "t: null against the contract", 5: "out: not of type date"}
    assert {r.o: r.error for r in graph.split(books, MAPPING)[1].collect()} == {3: "Book: no identity", 4: "Book: no identity", 5: "out: not of type date"}
    keys = {r.canonical_key for r in graph.objects(good, MAPPING).where("object_type = 'Book'").collect()}
    head = '[{"property":"title","type":"string","value":'
    assert keys == {head + '"a]}b"},{"property":"price","type":"decimal","value":"1.5"}]', head + '"a}b"},{"property":"price","type":"decimal","value":"1.5"}]', head + '"q\\"\\\\é"},{"property":"price","type":"decimal","value":"0"}]'}
    found = graph.assertions(good, MAPPING, "o").collect()
    assert {(r.value, r.kind, tuple(r.transformations)) for r in found if r.predicate == "genre"} == {("none", "transformed", ("default@1",))}
    assert {(r.offset, r.kind) for r in found if r.predicate == "title"} == {(0, "transformed"), (1, "observed"), (2, "observed")}
    since = [r for r in found if r.predicate == "since"]
    assert [(r.offset, r.value, str(r.confidence)[:3]) for r in since] == [(0, "2024-02-03", "0.5")] and {r.mapping_version for r in found} == {3}
    relations = {r.relation_id for r in graph.relations(good, MAPPING).collect()}
    assert since[0].subject_id in relations and len(relations) == 3
    with pytest.raises(Exception, match="no identity|not of type"):
        graph.split(books, MAPPING, policy="reject")[0].collect()
    extra = graph.split(books.withColumn("z", F.lit(1)), MAPPING, CONTRACT, offset="o")[1]
    assert {r.error for r in extra.collect()} == {"z: outside the contract"}
    with pytest.raises(ValueError):
        graph.ObjectMapping("J", (graph.Property("j", "j", "json"),))


@pytest.mark.parametrize("text,kind,want", [
    ("+07", "integer", "7"), ("1.0", "integer", None), ("10.500", "decimal", "10.5"), ("100", "decimal", "100"), ("-0.00", "decimal", "0"), ("0.000000000000000001", "decimal", "0.000000000000000001"),
    ("TRUE", "boolean", "true"), ("yes", "boolean", None), ("2024-02-30", "date", None), ("2024-02-29", "date", "2024-02-29"), ("2024-01-01T10:00:00+02:00", "datetime", "2024-01-01T08:00:00+00:00"),
    ("{\"a\":1}", "json", "{\"a\":1}"), ("{", "json", None), ("6BA7B810-9DAD-11D1-80B4-00C04FD430C8", "reference", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("", "string", ""),
])
def test_canonical_values(spark, text, kind, want):
    assert spark.createDataFrame([(text,)], "c string").select(graph.canonical(F.col("c"), kind)).first()[0] == want


def test_compiler():
    assert compiler.compiled(MAPPING, DEFINITION, CONTRACT).objects[0].properties[0].absent is False
    without = graph.SourceContract("books", tuple(f for f in CONTRACT.fields if f.name != "g"))
    with pytest.raises(compiler.MappingError, match="no field g"):
        compiler.compiled(MAPPING, DEFINITION, without)
    other = lambda o=BOOKS, r=MAPPING.relations: graph.Mapping((o, SHELVES), r)
    make = lambda **k: graph.ObjectMapping(BOOK, k.get("identity", BOOKS.identity), k.get("properties", ()))
    for wrong, what in (
        (other(graph.ObjectMapping("Film", BOOKS.identity)), "no such type of object"),
        (other(make(identity=BOOKS.identity[:1])), "lacks price"),
        (other(make(properties=(graph.Property("colour", "g"),))), "no such property"),
        (other(make(properties=(graph.Property("out", "d"),))), "declared as date"),
        (other(make(properties=(graph.Property("out", "n", "date"),))), "integer can't be date"),
        (other(make(properties=(graph.Property("genre", "g"),))), "default"),
        (other(r=(graph.RelationMapping("OWNS", BOOKS, SHELVES),)), "no such type of relation"),
        (other(r=(graph.RelationMapping("STANDS_ON", SHELVES, BOOKS),)), "the source is Book"),
        (other(r=(graph.RelationMapping("STANDS_ON", BOOKS, SHELVES, directed=False),)), "directed"),
        (other(r=(graph.RelationMapping("STANDS_ON", BOOKS, SHELVES, confidence="1.5"),)), "confidence"),
    ):
        with pytest.raises(compiler.MappingError, match=what):
            compiler.compiled(wrong, DEFINITION, CONTRACT)


def test_relation_types_and_manifest():
    change = lambda **k: registry.Definition("library", 2, DEFINITION.types, (registry.RelationType(**({"name": "STANDS_ON", "source": BOOK, "target": SHELF, "properties": (P("since", "date"),)} | k)),))
    seen = lambda new: [(c.path, c.breaking) for c in registry.differences(DEFINITION, new)]
    assert seen(change()) == [] and seen(change(target=BOOK)) == [("STANDS_ON", True)] and seen(change(cardinality="1-n")) == [("STANDS_ON", True)]
    assert seen(change(temporal=True)) == [("STANDS_ON", False)] and seen(change(properties=())) == [("STANDS_ON.since", True)]
    assert seen(registry.Definition("library", 2, DEFINITION.types)) == [("STANDS_ON", True)]
    with pytest.raises(ValueError):
        registry.Definition("d", 1, (), (registry.RelationType("R", "A", "B"),))
    one, two = registry.manifest(DEFINITION, MAPPING), registry.manifest(DEFINITION, graph.Mapping((BOOKS,)))
    assert one["definition"] == two["definition"] and one["digest"] != two["digest"] and one == registry.manifest(DEFINITION, MAPPING)


def test_store(spark, books, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.scan("objects").count() == 0
    for _ in range(2):  # the second load finds everything there
        assert store.load(books, MAPPING, "o", contract=CONTRACT).count() == 3
    store.put("schemas", schema_rows(spark, DEFINITION))
    assert {r.table_name: r.row_count for r in store.statistics().collect()} == {"objects": 5, "relations": 3, "assertions": 14, "schemas": 1, "resolutions": 0}
    with pytest.raises(CollisionError):
        store.put("objects", store.table("objects").withColumn("canonical_key", F.lit("other")))
    shelf = store.lookup("number", "1")
    assert shelf.count() == 0 and store.find("Shelf", [("number", "equals", 1)]).count() == 1
    start = store.find("Shelf", [("number", "equals", 1)])
    page = [r.relation_id for r in store.neighbors(start, "incoming", limit=10).collect()]
    assert len(page) == 2 and page == sorted(page) and [r.relation_id for r in store.neighbors(start, "incoming", limit=1, offset=1).collect()] == page[1:]
    walk = lambda *hops, **k: sorted((r.kind, r.depth) for r in store.traverse(start, list(hops), **k).collect())
    assert walk(graph.Hop("incoming", ("STANDS_ON",), BOOK)) == [("edge", 1)] * 2 + [("node", 0)] + [("node", 1)] * 2
    assert walk(graph.Hop("incoming", ("OTHER",))) == walk(graph.Hop("incoming", (), SHELF)) == [("node", 0)]
    assert walk(graph.Hop("incoming", filters=(("out", "equals", "2020-01-01"),))) == [("edge", 1), ("node", 0), ("node", 1)]
    assert walk("incoming", "outgoing", most_nodes=1) == [("edge", 1), ("node", 0), ("node", 1)]
    ids = [r.assertion_id for r in store.assertions(F.lit(True), limit=5).collect()]
    assert ids == sorted(ids) and len(ids) == 5 and store.assertions(F.lit(True), predicate="out").count() == 1
    assert store.provenance(F.col("predicate") == "title", 2).count() == 2
    for bad in (lambda: store.scan("objects", 0), lambda: store.scan("objects", 10_001), lambda: store.assertions(F.lit(True), limit=0)):
        with pytest.raises(ValueError):
            bad()
    labels = {r.label for r in graph.labelled(store.table("objects"), store.table("assertions"), ("title",)).where("object_type = 'Book'").collect()}
    assert labels == {"a]}b", "a}b", 'q"\\é'}
