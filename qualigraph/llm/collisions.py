"""Embedding near-duplicates by counting collisions of projections.

Each unit vector is projected on `PROJECTIONS` random directions. A pair at the threshold's
distance falls into a window of half-width `WINDOW` around either end with a known
probability, the same for each direction, so the number of windows that two vectors share is binomial and the least
count to ask for follows from the recall wanted (`calibrate`). Pairs that reach it are
verified by their cosine in double precision; no pair below the threshold is linked.

Equal vectors collapse first. The rest are sorted by their first projection into blocks;
pairs of blocks further apart than nearly all links reach are left out, every other pair is one unit of work of
bounded size, whatever the labels or the density of vectors. Inside it each projection of one block is sorted,
the window of each query is a range of ranks, and counts add up over projections. A unit returns a count
for each vector and links that span its components, never the pairs.

The work is quadratic in the number of different vectors, with a small constant: that is in
the nature of one-dimensional windows, which unrelated vectors also share a third of the time.

Defined results: null or empty vectors, zero vectors and those with null or non-finite
components link with nothing; vectors of different lengths don't link. Rows with a null id are
no part of the graph (no links, null component, kept). Rows of one id are one node. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.llm.common import cut
from qualigraph.llm.components import components
from qualigraph.llm.jaccard import _groups

THRESHOLD = 0.9
PROJECTIONS = 24
WINDOW = 0.6
RECALL = 0.999
BLOCK = 8192
SEED = 20240229


def directions(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, count))


def chance(distance: float, window: float) -> float:
    """Probability that two unit vectors at this distance share a window."""
    return math.erf(window / (distance * math.sqrt(2)))


def calibrate(threshold: float = THRESHOLD, count: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The greatest count that pairs at the threshold reach with probability `recall`."""
    p = chance(math.sqrt(2 - 2 * threshold), window)
    above = 0.0
    for k in range(count, 0, -1):
        above += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if above >= recall:
            return k
    return 0


def reach(threshold: float = THRESHOLD) -> float:
    """Difference of one projection that a pair at the threshold exceeds once in 30,000 times."""
    return 4.2 * math.sqrt(2 - 2 * threshold)


def unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    scaled = wide / np.abs(wide).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def pairs(left: np.ndarray, right: np.ndarray, same: bool, threshold: float = THRESHOLD, count: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (i of left, j of right) of unit vectors, some queries at a time; i < j if `same`."""
    need = calibrate(threshold, count, window, recall)
    along = directions(left.shape[1], count)
    here, there = left @ along, right @ along
    rank = np.empty((count, len(right)), np.uint16)
    low, wide = np.empty((count, len(left)), np.uint16), np.empty((count, len(left)), np.uint16)
    for k in range(count):
        order = np.argsort(there[:, k], kind="stable")
        rank[k, order] = np.arange(len(right))
        ordered = there[order, k]
        lo = np.searchsorted(ordered, here[:, k] - window, "left")
        low[k], wide[k] = np.minimum(lo, 65535), np.searchsorted(ordered, here[:, k] + window, "right") - lo
    for a in range(0, len(left), rows):
        b = min(a + rows, len(left))
        first = a if same else 0
        hits = np.zeros((b - a, len(right) - first), np.uint8)
        for k in range(count):
            hits += (rank[k, None, first:] - low[k, a:b, None]) < wide[k, a:b, None]
        i, j = np.nonzero(hits >= need)
        i, j = i + a, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 200_000):
            x, y = i[at : at + 200_000], j[at : at + 200_000]
            good = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
            yield x[good], y[good]


def roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label of each node's component, by hooking and halving.

    `label` holds the roots from the links seen before. Roots are hooked, not the ends of the
    new links, so that what hangs below a root moves with it.
    """
    while True:
        new, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of `df`."""
    spark = df.sparkSession
    parts, block = int(spark.conf.get("spark.sql.shuffle.partitions")), block or BLOCK
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind, span = np.float32 if single else np.float64, reach(threshold)

    def described(batches):
        for batch in batches:
            content, body, dims, at = [], [], [], []
            for row in batch.column(1):
                values = row.values.to_numpy(zero_copy_only=False).astype(kind) if row.is_valid and len(row.values) and not row.values.null_count else np.zeros(0, kind)
                good = len(values) and np.isfinite(values).all() and values.any()
                content.append(xxhash.xxh3_128_digest(values.tobytes()) if good else None)
                body.append(values.tobytes() if good else None)
                dims.append(len(values))
                at.append(float((unit(values[None]) @ directions(len(values))[:, :1])[0, 0]) if good else None)
            yield pa.record_batch([batch.column(0), pa.array(content, pa.binary()), pa.array(body, pa.binary()), pa.array(dims, pa.int32()), pa.array(at, pa.float64())], ["id", "content", "body", "dim", "at"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(described, "id long, content binary, body binary, dim int, at double")
    every = cut(rows)
    known = every.where(F.col("id").isNotNull() & F.col("content").isNotNull())
    one = cut(known.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("body").alias("body"), F.first("dim").alias("dim"), F.first("at").alias("at")).select("rep", "content", "copies", "body", "dim", "at"))
    blocks = max(1, -(-one.count() // block))
    # bounds of blocks: one number for each
    bounds = np.array(one.approxQuantile("at", [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else [], np.float64)
    lows, highs = np.concatenate([[-np.inf], bounds]), np.concatenate([bounds, [np.inf]])

    def dealt(batches):
        for batch in batches:
            own = np.searchsorted(bounds, batch.column("at").to_numpy(), "right")
            # block i meets j >= i while their intervals are within reach
            last = np.searchsorted(lows, highs + span, "right") - 1
            take, i, j, side = [], [], [], []
            for r, b in enumerate(own.tolist()):
                for k in range(int(np.searchsorted(last, b, "left")), int(last[b]) + 1):
                    take.append(r)
                    i.append(min(b, k))
                    j.append(max(b, k))
                    side.append(2 if b == k else int(k < b))
            yield pa.record_batch([batch.column("dim").take(pa.array(take, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(side, pa.int32()), *(batch.column(c).take(pa.array(take, pa.int64())) for c in ("rep", "copies", "body"))], ["dim", "i", "j", "side", "rep", "copies", "body"])

    meet = one.mapInArrow(dealt, "dim int, i int, j int, side int, rep long, copies long, body binary")
    where = ["dim", "i", "j"]

    def joined(batches):
        for group in _groups(batches, 3):
            group = group.combine_chunks().sort_by([("rep", "ascending")])
            dim, same = group["dim"][0].as_py(), group["i"][0].as_py() == group["j"][0].as_py()
            body = np.frombuffer(b"".join(group["body"].to_pylist()), kind).reshape(-1, dim)
            x, side, copies = unit(body), group["side"].to_numpy(), group["copies"].to_numpy()
            at_left = np.arange(len(x)) if same else np.flatnonzero(side == 0)
            at_right = at_left if same else np.flatnonzero(side == 1)
            links = np.zeros(len(x), np.int64)
            label = np.arange(len(x))
            for a in range(0, len(at_left), 32768):
                for b in range(a if same else 0, len(at_right), 32768):
                    left, right = at_left[a : a + 32768], at_right[b : b + 32768]
                    for i, j in pairs(x[left], x[right], same and a == b, threshold):
                        i, j = left[i], right[j]
                        np.add.at(links, i, copies[j])
                        np.add.at(links, j, copies[i])
                        label = roots(len(x), i, j, label)
            rep = group["rep"].to_numpy()
            live = links > 0
            yield pa.record_batch([pa.array(rep[live]), pa.array(links[live]), pa.array(rep[label[live]])], ["rep", "links", "to"])

    found = cut(meet.repartition(parts * 2, *where).sortWithinPartitions(*where).mapInArrow(joined, "rep long, links long, to long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rep")
    per_rep = one.select("rep", "content", "copies").join(counts, "rep", "left").join(linked, "rep", "left").select("content", "rep", "copies", "links", "component")
    out = every.select("id", "content").join(per_rep, "content", "left")
    n = F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    live = F.col("id").isNotNull()
    return out.select(F.col("id").alias(key), F.when(live, n).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
