"""Exact Jaccard join of word shingles in a metric space.

1 - Jaccard is a metric, so a document's distance to a pivot bounds its distance to every
other document near that pivot. The join goes in four steps:

1. Sets. Each text becomes its set of hashed shingles; equal sets become one document.
   Shingles have one global order, frequent ones last (the `HOT` most frequent, a list of
   fixed size), the rest by hash. Two sets within the limit share a shingle among their
   first n - ceil(n * s) + 1.
2. Pivots. The smallest document of each such shingle is a pivot, and the documents that
   have the shingle can be near it. Each document goes to the region of the pivot with
   which it shares most; its distance to it is computed exactly, and it is linked if near.
3. Boundaries. A document is replicated into every region where a partner may lie, and all
   regions whose members are connected already are done. Of the rest, members with no partner left after
   a lower bound on the symmetric difference (from the shingles already at hand) go.
4. Regions. What is left is joined exactly in each region by ball partitioning: two
   pivots split the members, the triangle inequality's window joins those on both sides
   of the boundary, and both halves recurse. Only links between different components leave a region.

A region over `REGION` members is cut into pairs of blocks, so no task gathers an unbounded group; near
copies of one document never come so far, since step 2 has connected them one by one.

Defined results: null and empty texts and those without words have no shingles and link with
nothing; fewer than five words are one shingle. Rows of one key are one document of the graph. Rows
with a null key count their shingles and have a null component. Extra columns are not
carried. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualigraph.llm.common import cut, free, marked, slices, text_or_empty
from qualigraph.llm.components import components

WIDTH = 5
#: Link when PERCENT / 100 of the union is shared.
PERCENT = 80
HOT = 1 << 17
HOT_FROM = 64
REGION = 4096
#: Share of a document's first shingles that makes a pivot worth an exact comparison at once.
LIKELY = 0.5
_TOP = np.uint64(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, hot: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """A sorted array of unsigned keys for each text; hot shingles have the top bit and so come last."""
    # case is folded on the distinct words: the kernels that change case misread slices of arrays
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    coded = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    words = pc.ascii_lower(coded.dictionary).to_pylist()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64)
    empty = words.index("") if "" in words else -1
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if empty >= 0:
        there = coded.indices.to_numpy() != empty
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        hashed = hashed[there]
    n = len(hashed)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + len(rolled)]
        rolled = _mix(rolled)
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= width:
                keys = np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashed[a:b]:
                    short = short * np.uint64(0x9E3779B97F4A7C15) + h
                keys = _mix(np.array([short], np.uint64))
            else:
                keys = np.zeros(0, np.uint64)
            keys >>= np.uint64(1)
            if len(hot) and len(keys):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                is_hot = hot[at] == keys
                keys = np.concatenate([keys[~is_hot], keys[is_hot] | _TOP])
            out.append(keys)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def near(shared, n, m, percent: int = PERCENT):
    return 100 * shared >= percent * (n + m - shared)


def _sets(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), hot, width)
            first = [s[: prefix_length(len(s), percent)].view(np.int64) for s in sets]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in first])]), pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first) if first else [], pa.int64()))],
                ["doc", "n", "content", "first"],
            )

    return docs.mapInArrow(each, "doc long, n long, content binary, first array<long>")


def hot_shingles(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> np.ndarray:
    """The HOT most frequent shingles at least, if HOT_FROM documents have them; counted over all documents."""
    each = _sets(docs, np.zeros(0, np.uint64), width, percent).select(F.explode("first").alias("s"))
    counted = each.groupBy("s").count().where(F.col("count") >= HOT_FROM)
    top = counted.orderBy(F.desc("count"), "s").limit(HOT)
    return np.sort(np.array([r["s"] for r in top.select("s").collect()], np.int64).view(np.uint64))


def some_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose `doc` is in `ids` (column doc)."""
    return marked(docs, ids, "doc", 1 << 22).join(ids.select("doc").distinct(), "doc", "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are near, each compared exactly from the two texts."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    texts = cut(some_of(docs, ids))
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("right")), "b")

    def each(batches):
        for batch in slices(slices(batches, 2), 3):
            left, right = (shingle_sets(batch.column(i), hot, width) for i in (2, 3))
            keep = [near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(each, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Tables of equal first `width` columns, from sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)]) if batch.num_rows else np.zeros((width, 0))
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = tuple(keys[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def can_be_near(sets: list[np.ndarray], n: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Members with a partner of another component that a lower bound doesn't exclude.

    `sets` are the upper halves of the first shingles' keys, in the global order. Of two sets, all shingles up to the
    smaller of their last known ones are known; those that one alone has count as differing. Sides 0 and 1 are
    two blocks that meet; 2 is a block with itself.
    """
    keep = np.zeros(len(sets), bool)
    flat = np.concatenate(sets)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(code.max() + 1, bool)
    last = np.array([s[-1] for s in sets])
    for i in range(len(sets)):
        if keep[i] and side[i] == 2 and i + 1 == len(sets):
            continue
        own = code[ends[i] : ends[i + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[code], ends[:-1])
        mark[own] = False
        may = (component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (shared > 0)
        may &= (side != side[i]) | (side == 2)
        may[: i + 1] = False
        for j in np.flatnonzero(may & ~(keep & keep[i])):
            upto = min(last[i], last[j])
            known = np.searchsorted(sets[i], upto, "right") + np.searchsorted(sets[j], upto, "right")
            differing = known - 2 * shared[j]
            # near: differing <= union - shared, at most (100 - percent) / (100 + percent) of n + m
            if differing * (100 + percent) <= (100 - percent) * (n[i] + n[j]):
                keep[i] = keep[j] = True
    return keep


class _Forest:
    def __init__(self, labels):
        names = {c: i for i, c in enumerate(dict.fromkeys(labels))}
        self.of = [names[c] for c in labels]
        self.up = list(range(len(names)))

    def root(self, i: int) -> int:
        x = self.of[i]
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def region_join(sets: list[np.ndarray], labels: list[int], percent: int = PERCENT, small: int = 24) -> list[tuple[int, int]]:
    """Links that join members of different components, enough to connect all that are near.

    Ball partitioning with two pivots; pairs across the boundary are those whose distances to
    the first pivot differ by the limit at most, as the triangle inequality asks.
    """
    eps = 1 - percent / 100 + 1e-9
    flat = np.concatenate(sets)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, code = np.unique(flat, return_inverse=True)
    parts = [code[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    size = np.array([len(s) for s in sets])
    mark = np.zeros(code.max() + 1, bool)
    forest, found = _Forest(labels), []

    def shared(i: int, others: np.ndarray) -> np.ndarray:
        mark[parts[i]] = True
        out = np.array([np.count_nonzero(mark[parts[j]]) for j in others])
        mark[parts[i]] = False
        return out

    def distances(i: int, others: np.ndarray) -> np.ndarray:
        both = shared(i, others)
        for j in others[near(both, size[i], size[others], percent) & (others != i)]:
            if forest.join(i, int(j)):
                found.append((i, int(j)))
        return 1 - both / (size[i] + size[others] - both)

    def brute(left: np.ndarray, right: np.ndarray | None) -> None:
        for at, i in enumerate(left):
            others = right if right is not None else left[at + 1 :]
            others = np.array([j for j in others if forest.root(int(i)) != forest.root(int(j))], np.int64)
            if len(others):
                distances(int(i), others)

    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(sets)), None)]
    while stack:
        left, right = stack.pop()
        everyone = left if right is None else np.concatenate([left, right])
        if not len(left) or (right is not None and not len(right)) or len({forest.root(int(i)) for i in everyone}) < 2:
            continue
        if len(everyone) <= small:
            brute(left, right)
            continue
        one = int(everyone[0])
        d = distances(one, everyone)
        other = int(everyone[np.argmax(d)])
        e = distances(other, everyone)
        mine = d <= e
        here, there = everyone[mine], everyone[~mine]
        # near pairs on both sides of the boundary have |d - e| <= 2 eps
        border = np.abs(d - e) <= 2 * eps
        if max(mine.sum(), (~mine).sum()) > 0.9 * len(everyone) or border.sum() > 0.9 * len(everyone):
            # no pivot separates these; windows of the distance to the first one
            order = np.argsort(d, kind="stable")
            ranked, at = everyone[order], d[order]
            upto = np.searchsorted(at, at + eps, "right")
            for k, i in enumerate(ranked):
                others = np.array([j for j in ranked[k + 1 : upto[k]] if forest.root(int(i)) != forest.root(int(j))], np.int64)
                if len(others):
                    distances(int(i), others)
            continue
        if right is None:
            stack += [(here, None), (there, None), (everyone[mine & border], everyone[~mine & border])]
        else:
            in_left = np.concatenate([np.ones(len(left), bool), np.zeros(len(right), bool)])
            stack += [(everyone[m & in_left], everyone[m & ~in_left]) for m in (mine, ~mine)]
            stack += [(everyone[mine & border & in_left], everyone[~mine & border & ~in_left]), (everyone[mine & border & ~in_left], everyone[~mine & border & in_left])]
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id), one row for each row of `df`."""
    docs = df.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    hot = hot_shingles(docs, width, percent)
    free(df.sparkSession)
    sets = cut(_sets(docs, hot, width, percent))
    known = sets.where(F.col("doc").isNotNull() & F.col("content").isNotNull())
    one = cut(known.groupBy("content").agg(F.min(F.struct("doc", "n", "first")).alias("r")).select("content", "r.*"))
    sets = cut(sets.select("doc", "n", "content"))
    del known
    free(df.sparkSession)

    each = one.select("doc", F.explode("first").alias("s"), F.size("first").alias("length"))
    pivots = each.groupBy("s").agg(F.min("doc").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("s", "pivot")
    pivots = cut(pivots)
    member = cut(marked(each, pivots, "s", 1 << 25).join(pivots, "s").groupBy("doc", "pivot").agg(F.count("*").alias("shared"), F.first("length").alias("length")))
    # the upper halves of the keys keep the order and can only hide differences: the bound still holds
    one = cut(one.select("content", "doc", "n", F.transform("first", lambda x: F.shiftright(x, 32).cast("int")).alias("first")))
    del each, pivots
    free(df.sparkSession)

    others = member.where("doc != pivot")
    best = others.groupBy("doc").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("back"), "length")).alias("best"))
    likely = best.where(F.col("best.shared") >= LIKELY * F.col("best.length")).select(F.col("doc").alias("a"), (-F.col("best.back")).alias("b"))
    links = cut(_verify(likely, docs, hot, width, percent))

    labelled = components(links)
    placed = member.join(labelled.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    regions = placed.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high")
    blocks = F.ceil(F.col("size") / REGION).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    meet = (
        placed.join(regions.select("pivot", blocks.alias("blocks")), "pivot")
        .withColumn("own", own)
        .select("pivot", "doc", "component", "own", F.explode(spread).alias("p"))
        .select("pivot", "p.i", "p.j", "doc", "component", F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("own") == F.col("p.i"), 0).otherwise(1).alias("side"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = meet.join(one.select("doc", "n", "first"), "doc").select("pivot", "i", "j", "doc", "component", "side", "n", "first")
    where = ["pivot", "i", "j"]

    def filtered(batches):
        for region in _groups(batches, 3):
            if region.num_rows < 2:
                continue
            region = region.combine_chunks()
            first = [x.values.to_numpy().view(np.uint32) for x in region["first"]]
            keep = can_be_near(first, region["n"].to_numpy(), region["component"].to_numpy(), region["side"].to_numpy(), percent)
            yield from region.select(["pivot", "i", "j", "doc", "component"]).filter(pa.array(keep)).to_batches()

    left = cut(sketched.repartition(parts, *where).sortWithinPartitions(*where).mapInArrow(filtered, "pivot long, i int, j int, doc long, component long"))
    free(df.sparkSession)
    texts = some_of(docs, left.select("doc"))

    def joined(batches):
        for region in _groups(batches, 3):
            members, labels = region["doc"].to_pylist(), region["component"].to_pylist()
            found = region_join(shingle_sets(region["text"].combine_chunks(), hot, width), labels, percent)
            yield pa.record_batch([pa.array([members[i] for i, _ in found], pa.int64()), pa.array([members[j] for _, j in found], pa.int64())], ["a", "b"])

    late = left.join(texts, "doc").select("pivot", "i", "j", "doc", "component", "text").repartition(parts, *where).sortWithinPartitions(*where).mapInArrow(joined, "a long, b long")
    links = links.union(cut(late))
    final = components(links).withColumnRenamed("id", "rep")
    named = sets.select("doc", "n", "content").join(one.select("content", F.col("doc").alias("rep")), "content", "left").join(final, "rep", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    out = named.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` whose key is the smallest of its component; rows without key stay."""
    first = near_duplicates(df, key, text).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_first")).distinct()
    return df.join(first, df[key] == first["_first"], "left_semi").unionByName(df.where(F.col(key).isNull()))
