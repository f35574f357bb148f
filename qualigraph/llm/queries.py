"""The queries opN_<name> and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualigraph.llm import bpe, collisions, dac, jaccard, packing, pii, quality, sharding, suffix, warc
from qualigraph.llm.common import cut, drop_folder, scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id").select("doc_id", "slot", "shard")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = _vocabulary("byte_bpe_50k.json")
    return bpe.decode(bpe.encode(docs, path, stable=True), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Pages whose replica op5 lets rot, to have something to find: a fixed share by a hash of the key.
ROT = "00"


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of all pages, one byte of some records changed in the second, and the audit's finding for each page and each extra record."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, copy = scratch(spark, "warc"), scratch(spark, "warc-copy")

    def wear(key: str, record: bytes) -> bytes:
        rots = hashlib.md5(f"rot:{key}".encode()).hexdigest()[:2] == ROT
        half = len(record) // 2
        return record[:half] + b"~" + record[half + 1 :] if rots else record

    manifest = warc.write(warc.records(pages), folder)
    manifests = [(folder, manifest), (copy, warc.replicate(folder, manifest, copy, wear))]
    found = []
    for where, files in manifests:
        found.append(cut(warc.read(where, files)))
        drop_folder(where)  # the digests stand for the files now
    return warc.report(*found).select(F.col("key").alias("page_id"), "file", "ordinal", "offset", "length", "digest", "status")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "dac")
    manifest = dac.write(docs, _vocabulary("word_bpe_49k.json"), folder, end_id=2)
    return dac.read(folder, manifest, checksums=True).withColumnRenamed("key", "doc_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return pii.find(docs).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("_quality")
    m = q["measures"]
    return quality.apply_rules(docs).select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        q["base_failed"].alias("base_failed"),
        q["kept"].alias("kept"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op5_warc": op5_warc,
    "op4_bpe": op4_bpe,
    "op6_jaccard": op6_jaccard,
    "op7_token_codes": op7_token_codes,
    "op8_pii": op8_pii,
    "op9_collisions": op9_collisions,
    "op10_quality": op10_quality,
}
