"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from qualigraph import catalogue
from qualigraph.functions import typing
from qualigraph.operators import clean
from qualigraph.operators.lineage import spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def typed_lineitem(spark: SparkSession, sf_dir: str):
    """Text columns to types, the work of an ingestion."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    texts = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return typing.convert(texts(spread(raw)), typing.infer(texts(raw)))


def cleaned_lineitem(spark: SparkSession, sf_dir: str):
    return clean.clean(typed_lineitem(spark, sf_dir), [clean.Transform("lowercase", "l_returnflag")])


HEADLINE = {"ingest_typed_lineitem": typed_lineitem, "pipeline_lowercase_lineitem": cleaned_lineitem} | {
    name: catalogue.QUERIES[name]
    for name in ("profile_report", "profile_distinct", "validation_violations", "rule_unique", "unique_counts_lineitem", "match_exact_docs", "match_exact_counts", "match_levenshtein_block", "mat_objects", "mat_relations", "mat_assertions", "graph_lookup", "graph_find_equals", "graph_neighbors_both", "graph_traverse_2hop", "reason_fixpoint")
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="qualigraph-bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    took = {}
    for name, query in HEADLINE.items():
        began = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
