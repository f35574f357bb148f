"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (offset and skip
from two hashes of its name). Shards take turns; in its turn a shard claims the next slot of
its permutation that is still free, until the table is full. Shares differ by one slot at
most, and a change of one shard moves few slots of the others. Placement of a row is one
hash and one lookup in the broadcast table.

The table has a fixed number of slots, whatever the number of rows, so broadcasting it is
bounded by its construction. Rows are placed by built-in expressions only.

Defined results: a null key is hashed as the empty string with a leading mark, so all null
keys go to one shard and differ from the key ''. Repeated keys go to the same shard. An
empty table stays empty. Columns of the input named slot or shard are refused, not
overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualigraph.llm.common import shuffle_partitions

#: Prime, about a hundred slots for each of 64 shards.
SLOTS = 6553
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. O(slots log slots) steps on average, independent of the rows."""
    if not is_prime(slots):
        raise ValueError(f"{slots} slots: the table's size has to be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards have to be distinct, one at least, and no more than slots")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    owner = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[at := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            owner[at] = i
            left -= 1
            if not left:
                break
    return owner


def table_frame(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """The lookup table as (slot, shard), from a literal."""
    digits = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(digits).alias("slot", "shard")).select(
        F.col("slot").cast("long"), F.col("shard").cast("long")
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Sixty bits of md5 over the key's text, modulo the table's size."""
    marked = F.coalesce(F.concat(F.lit("k:"), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(marked.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add slot and shard; one broadcast join, no shuffle."""
    if clash := {"slot", "shard"} & set(df.columns):
        raise ValueError(f"the input has columns named {sorted(clash)}")
    owner = table_frame(df.sparkSession, lookup_table(shards, slots))
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(owner), "slot")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, files_per_shard: int | None = None) -> None:
    """Write one folder for each shard, in `files_per_shard` files (by default as many as make use of all shuffle partitions).

    Rows are dealt to a shard's files in turn, not by key, so a key with very many rows fills no single task.
    """
    files = files_per_shard or max(1, shuffle_partitions(df.sparkSession) // len(shards))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    placed = place(df, key, shards, slots).withColumn("_turn", turn)
    placed.repartition(len(shards) * files, "shard", "_turn").drop("_turn").write.partitionBy("shard").parquet(path)
