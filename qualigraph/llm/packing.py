"""Packing with optimal length buckets.

The lengths of all sequences are counted into one global histogram; dynamic programming over
it chooses the bucket boundaries with the least padding; batches of a token budget form
inside each bucket. A text longer than the context is cut into whole contexts and a rest, so
no token is lost and the histogram has `max_length` + 1 cells at most, whatever the input:
that is all that the driver sees.

A row's place in its bucket comes from a range partitioning by (bucket, key, sequence, length,
hash of the text, place in the input), the row's number in its partition, and the sums of a
table with one row for each partition and bucket. No bucket and no key, however full, meets in
one task, and only rows that are equal in key and text stand in no fixed order.

Defined results: null and empty texts have length 0 and one sequence of no tokens, in the
smallest bucket. Null keys come first; rows with equal keys stay apart, the shorter sequence
first and then by the hash of the text; repeated rows are packed one by one. Other columns are not
carried. An empty table has no batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualigraph.llm.common import WORD_PATTERN, cut, text_or_empty

MAX_LENGTH = 2048
BUCKETS = 16
TOKEN_BUDGET = 16384


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket lengths, at most `buckets`, the last one the greatest length.

    Exact: best[k][j] is the least padding of the first j lengths in k buckets; a bucket over
    lengths i..j-1 pads each of its sequences to lengths[j-1].
    """
    order = np.argsort(np.asarray(lengths, np.int64))
    size = np.asarray(lengths, np.int64)[order]
    count = np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * size)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut_at = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            padding = best[:j] + size[j - 1] * (upto[j] - upto[:j]) - (tokens[j] - tokens[:j])
            cut_at[j] = np.argmin(padding)
            now[j] = padding[cut_at[j]]
        cuts.append(cut_at)
        best = now
    found, j = [], n
    for cut_at in reversed(cuts):
        if j:
            found.append(int(size[j - 1]))
            j = int(cut_at[j])
    return found[::-1]


def sequences(df: DataFrame, key: str = "doc_id", length: Column | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """(key, sequence, start, n_tokens, tie): each text's whole contexts and its rest; `tie` is a hash of the text, or 0 without one."""
    size = F.greatest(F.coalesce(length if length is not None else word_count(), F.lit(0).cast("long")), F.lit(0).cast("long"))
    tie = F.xxhash64("text") if "text" in df.columns else F.lit(0).cast("long")
    counted = df.select(F.col(key).alias("key"), size.cast("long").alias("size"), tie.alias("tie"))
    last = F.greatest(F.ceil(F.col("size") / F.lit(max_length)) - 1, F.lit(0)).cast("long")
    each = counted.select("key", "size", "tie", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("sequence"))
    start = F.col("sequence") * max_length
    return each.select("key", "sequence", start.alias("start"), F.least(F.col("size") - start, F.lit(max_length).cast("long")).alias("n_tokens"), "tie")


def pack(df: DataFrame, key: str = "doc_id", length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Return key, sequence, start, n_tokens, bucket_length, batch, slot.

    A batch holds token_budget // bucket_length sequences of one bucket, all padded to its
    length; only the last batch of a bucket may hold fewer. Batches are numbered from 0.
    """
    if token_budget < max_length:
        raise ValueError("a batch has to hold one sequence of the greatest length")
    spark = df.sparkSession
    # rows equal in all that orders them are dealt by where they lie, so no key fills a range of its own
    parts = cut(sequences(df, key, length, max_length).withColumn("row", F.monotonically_increasing_id()))
    histogram = parts.groupBy("n_tokens").count().collect()  # max_length + 1 rows at most
    bounds = optimal_boundaries([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    batches_before, room, total = [], [], 0
    for low, high in zip([-1, *bounds], bounds, strict=False):
        rows = sum(r["count"] for r in histogram if low < r["n_tokens"] <= high)
        room.append(token_budget // max(high, 1))
        batches_before.append(total)
        total += -(-rows // room[-1])
    numbered = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(numbered, lambda b: b < F.col("n_tokens")))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", F.col("key").asc_nulls_first(), "sequence", "n_tokens", "tie", "row"]
    dealt = (
        parts.withColumn("bucket", bucket)
        .repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = cut(dealt).withColumn("part", F.shiftright("at", 33).cast("int"))
    # one row for each partition and bucket
    ranges = placed.groupBy("part", "bucket").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", "bucket", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") - F.col("first")
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [0]]), F.col("bucket") + 1)
    return placed.join(ranges, ["part", "bucket"]).select(
        F.col("key").alias(key),
        "sequence",
        "start",
        "n_tokens",
        of(bounds).alias("bucket_length"),
        (of(batches_before) + F.floor(rank / of(room))).cast("long").alias("batch"),
        (rank % of(room)).cast("long").alias("slot"),
    )
