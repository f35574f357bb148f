"""The graph's tables as Parquet in one folder: rows are appended once, by id, and read by queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualigraph.operators import graph
from qualigraph.operators.lineage import checkpointed, exists

#: Each table's key and columns; the column after which its files are parted comes last.
TABLES = {
    "schemas": ("schema_id", "schema_id string, name string, version int, digest string, body string", None),
    "objects": ("object_id", "object_id string, canonical_key string, object_type string", "object_type"),
    "relations": ("relation_id", "relation_id string, source_id string, target_id string, relation_type string", "relation_type"),
    "assertions": (
        "assertion_id",
        "assertion_id string, subject_id string, value_type string, value string, kind string, offset long, supersedes string, valid_from timestamp, "
        "valid_to timestamp, confidence decimal(19,18), observed_at timestamp, mapping_version int, transformations array<string>, predicate string",
        "predicate",
    ),
    "resolutions": ("candidate_id", "candidate_id string, decision string, canonical_id string, left_id string, right_id string", None),
}


class CollisionError(ValueError):
    pass


class Store:
    """Tables under `path`, a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        _, shape, _ = TABLES[name]
        where = f"{self.path}/{name}"
        return self.spark.read.schema(shape).parquet(where) if exists(self.spark, where) else self.spark.createDataFrame([], shape)

    def put(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        """Append the rows whose ids are new, the first of each id by `order`; the number appended.

        An id that comes with another shape than it has is an error, and nothing is written.
        """
        key, shape, parted = TABLES[name]
        there = self.table(name)
        rows = checkpointed(rows.select(*there.columns, *([order] if order and order not in there.columns else [])))
        new = checkpointed(graph.insert_if_absent(there, rows, key, order).select(*there.columns))
        first = graph.collisions(there.unionByName(new), rows.select(*there.columns), key).limit(1).collect()
        if first:
            raise CollisionError(f"{name}: {first[0][0]} has another shape already")
        out = new.write.mode("append")
        (out.partitionBy(parted) if parted else out).parquet(f"{self.path}/{name}")
        return new.count()

    def load(self, records: DataFrame, mapping: graph.Mapping, offset: str, run_id: str = "run", contract: graph.SourceContract | None = None) -> DataFrame:
        """Map records, append what is new, and return the quarantined ones. A record counts once, however often it comes."""
        good, bad = graph.split(records, mapping, contract, offset=offset)
        self.put("objects", graph.objects(good, mapping))
        if mapping.relations:
            self.put("relations", graph.relations(good, mapping))
        self.put("assertions", graph.assertions(good, mapping, offset, run_id))
        return bad

    def statistics(self) -> DataFrame:
        """(table_name, row_count) of all five tables."""
        return graph.statistics(**{name: self.table(name) for name in TABLES})

    def scan(self, name: str = "objects", limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of a table in the order of its ids."""
        graph._page(limit, offset)
        return self.table(name).orderBy(TABLES[name][0]).offset(offset).limit(limit)

    def lookup(self, predicate: str, value: str) -> DataFrame:
        """Objects that have the value among their active assertions."""
        return graph.matching(self.table("objects"), self.table("assertions"), [(predicate, "equals", value)])

    def find(self, object_type: str, filters: list, limit: int = 100, offset: int = 0) -> DataFrame:
        return graph.find(self.table("objects"), self.table("assertions"), object_type, filters, limit, offset)

    def neighbors(self, start: DataFrame, direction: str = "both", types: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return graph.neighbors(start, self.table("relations"), self.table("objects"), direction, types, limit, offset)

    def traverse(self, start: DataFrame, hops: list, include_once: bool = False, most_nodes: int | None = None) -> DataFrame:
        return graph.traverse(start, self.table("relations"), hops, include_once, self.table("objects"), self.table("assertions"), most_nodes)

    def assertions(self, subject: Column, **how) -> DataFrame:
        return graph.assertion_page(self.table("assertions"), subject, **how)

    def provenance(self, subject: Column, limit: int | None = None) -> DataFrame:
        return graph.provenance(self.table("assertions"), subject, limit)


def schema_rows(spark: SparkSession, *definitions) -> DataFrame:
    """Published definitions as rows of the table of schemas."""
    rows = [(f"{d.name}@{d.version}", d.name, d.version, d.digest(), d.body()) for d in definitions]
    return spark.createDataFrame(rows, TABLES["schemas"][1]).withColumn("version", F.col("version").cast("int"))
