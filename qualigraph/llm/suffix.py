"""Suffix-array deduplication of every byte range that an earlier place has too.

A byte is removed if a string of `length` bytes that covers it also starts earlier (smaller
key, or same document and earlier start). Strings are judged on the input.

1. Anchors. Of each window of `length` bytes the least hashed `GRAM`-byte string, leftmost on
   ties, is the anchor, so equal windows have equal anchors at equal places. Windows with the same
   anchor are neighbours; together they are one context. Only contexts whose anchor occurs
   twice go on; anchors are counted over all documents with partial sums, and a bitmap of
   fixed size keeps most others from being shuffled at all (an exact count follows).
2. Copies. Equal contexts collapse into their first occurrence before anything is gathered;
   the others are removed whole.
3. Column-wise construction. Different contexts with one anchor that share enough around it
   to hold an equal window become a collection of short
   strings. One symbol of every string is inserted each round, from the right; a round reads
   and rewrites the collection's Burrows-Wheeler transform and common-prefix file of each
   first symbol, one after the other. Suffixes with `length` common bytes are equal windows;
   all but the first are removed.
4. Removed ranges go back to their documents.

Batches of step 3 hold `BATCH` strings. An anchor with more different contexts than `HOT` (a passage's edge in
many documents) is cut into its windows, which collapse by a 128-bit hash with partial minima
instead: no group is gathered in one task, whatever its size.

Defined results: null and empty texts and those shorter than `length` lose nothing. A null key
is greater than all others. Rows of one key are ordered by a hash of their texts; rows equal in key and text are
one document and get one result. Extra columns are not carried by `spans`. Empty tables give empty tables.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.llm.common import cut, drop_spill, free, marked, may_be_among, slices, spill, text_or_empty
from qualigraph.llm.jaccard import _groups

LENGTH = 100
#: A multiple of eight, long enough that unrelated texts rarely share one.
GRAM = 32
BATCH = 20_000
#: Different contexts of one anchor from which they are cut into windows.
HOT = 20_000
BITMAP_BITS = 1 << 26
DOC_BITS = 1 << 22
#: Bytes handled at once, few enough for a processor's cache; positions take 24 bits of a key.
PIECE = 128 << 10
LAST_KEY = (1 << 63) - 1


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, hashed anchor, its place) of each context.

    `data` are documents end to end, `ends` their ends from 0; at most 2**24 bytes.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), none
    padded = np.concatenate([data, np.zeros(gram + 16, np.uint8)])
    eight = np.empty(n + gram, np.uint64)
    for j in range(8):
        part = eight[j::8]
        part[:] = padded[j : j + 8 * len(part)].view("<u8")
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    part = np.empty(n, np.uint64)
    for j in range(8, gram, 8):
        np.multiply(eight[j : j + n], np.uint64((0xC2B2AE3D27D4EB4F * (2 * j + 1)) & ((1 << 64) - 1)), out=part)
        h += part
    np.right_shift(h, np.uint64(32), out=part)
    h ^= part
    h *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(h, np.uint64(32), out=part)
    h ^= part
    least = np.bitwise_and(h, np.uint64(~((1 << 24) - 1) & (1 << 64) - 1), out=part)
    least |= np.arange(n, dtype=np.uint64)
    width = length - gram + 1
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)[: n - length + 1]
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(at)]
    inside = np.ones(len(at), bool)
    for end in ends[1:-1].tolist():  # windows that would leave their document
        inside[max(0, end - length + 1) : end] = False
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    # a context ends where the next begins or where windows leave the document
    stop = np.flatnonzero(new | ~inside)
    upto = np.append(stop, len(at))[np.searchsorted(stop, first, "right")]
    return doc[first], first, upto - first, h[at[first]], at[first]


def pieces(batches: Iterator[pa.RecordBatch], piece: int = PIECE, length: int = LENGTH) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, data, ends, shift of positions): documents end to end, long ones in overlapping parts."""
    keys, parts, shifts, size = [], [], [], 0

    def out():
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return keys, data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array(shifts, np.int64)

    for batch in slices(batches, 2):
        texts = batch.column(2).cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        for key, salt, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for at in range(a, max(a + 1, b - length + 1), piece):
                part = raw[at : min(b, at + piece + length - 1)]
                if parts and size + len(part) > piece + length:
                    yield out()
                    keys, parts, shifts, size = [], [], [], 0
                keys.append((key, salt))
                parts.append(part)
                shifts.append(at - a)
                size += len(part)
    if parts:
        yield out()


class Files:
    """Transform and common prefixes of the suffixes of each first symbol, a file for each.

    A file is read whole and written whole in place, front to back; `folder` None keeps the
    same bytes in memory.
    """

    def __init__(self, symbols: int, folder: str | None):
        self.sizes = [0] * symbols
        self.counts = np.zeros((symbols, symbols), np.int64)  # of each symbol in each file
        self.held = [(np.zeros(0, np.uint8),) * 2] * symbols
        self.open = [os.open(os.path.join(folder, f"{c}"), os.O_RDWR | os.O_CREAT) for c in range(symbols)] if folder else []

    def get(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.open:
            return self.held[c]
        n = self.sizes[c]
        both = np.frombuffer(os.pread(self.open[c], 2 * n, 0), np.uint8)
        return both[:n], both[n:]

    def put(self, c: int, transform: np.ndarray, common: np.ndarray) -> None:
        self.sizes[c] = len(transform)
        if not self.open:
            self.held[c] = (transform, common)
            return
        data, at = memoryview(np.concatenate([transform, common])), 0
        while at < len(data):
            at += os.pwrite(self.open[c], data[at:], at)

    def close(self) -> None:
        for f in self.open:
            os.close(f)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both included, for each pair."""
    if not len(lo):
        return np.zeros(0, np.uint8)
    counts = hi - lo + 1
    ends = np.cumsum(counts)
    index = np.arange(ends[-1]) + np.repeat(lo - np.concatenate([[0], ends[:-1]]), counts)
    return np.minimum.reduceat(values[index], np.concatenate([[0], ends[:-1]]))


def equal_windows(strings: list[bytes], length: int = LENGTH, external: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, string, start) of the suffixes that share `length` bytes with another, group by group.

    Column-wise construction: round j holds all suffixes of j symbols at most, in order.
    `at[i]` is the place of string i's longest suffix among those of its first symbol; the
    symbol there says where the next one goes (as many places down as that symbol occurs
    above). Strings are at most 255 bytes long, so a common prefix fits a byte.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    longest = int(sizes.max(initial=0))
    if longest > 255:
        raise ValueError("strings of 255 bytes at most")
    raw = np.frombuffer(b"".join(strings), np.uint8)
    used, codes = np.unique(raw, return_inverse=True)
    wide = len(used) > 255  # all byte values: with the end, symbols take 16 bits
    kind = np.uint16 if wide else np.uint8
    table = np.zeros((longest, m), kind)  # table[j]: symbol j from the right, 0 beyond the start
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(m), sizes)
    table[np.repeat(ends, sizes) - 1 - np.arange(len(raw)), own] = codes + 1
    symbols = len(used) + 1
    with contextlib.ExitStack() as stack:
        folder = stack.enter_context(tempfile.TemporaryDirectory()) if external and not wide else None
        files = stack.enter_context(contextlib.closing(Files(symbols, folder)))
        files.put(0, table[0].copy() if longest else np.zeros(m, kind), np.zeros(m, np.uint8))
        files.counts[0] = np.bincount(files.get(0)[0], minlength=symbols)
        segment, at = np.zeros(m, np.int64), np.arange(m)
        alive = np.flatnonzero(sizes > 0)
        for j in range(longest):
            alive = alive[sizes[alive] > j]
            symbol = table[j, alive].astype(np.int64)
            seen = np.zeros(symbols, np.int64)  # of each symbol in the files read so far
            place = np.empty(len(alive), np.int64)
            before, after = np.zeros(len(alive), np.uint8), np.zeros(len(alive), np.uint8)
            order_of = np.argsort(segment[alive], kind="stable")
            cuts = np.searchsorted(segment[alive][order_of], np.arange(symbols + 1))
            for d in range(symbols):
                counts, mine = files.counts[d], order_of[cuts[d] : cuts[d + 1]]
                if len(mine):
                    transform, common = files.get(d)
                    order = np.argsort(transform, kind="stable")
                    inverse = np.empty(len(order), np.int32)
                    inverse[order] = np.arange(len(order), dtype=np.int32)
                    first = np.concatenate([[0], np.cumsum(counts)])
                    p, c = at[alive[mine]], symbol[mine]
                    rank = inverse[p].astype(np.int64)
                    place[mine] = seen[c] + rank - first[c]
                    has = rank > first[c]  # the same symbol above, among suffixes that begin alike
                    before[mine[has]] = _range_min(common, order[rank[has] - 1] + 1, p[has]) + 1
                    before[mine[~has & (seen[c] > 0)]] = 1
                    has = rank + 1 < first[c + 1]
                    after[mine[has]] = _range_min(common, p[has] + 1, order[rank[has] + 1]) + 1
                    after[mine[~has]] = 1  # if there is one below at all
                seen = seen + counts
            following = table[j + 1, alive] if j + 1 < longest else np.zeros(len(alive), kind)
            order_of = np.lexsort((place, symbol))
            cuts = np.searchsorted(symbol[order_of], np.arange(symbols + 1))
            for c in range(1, symbols):
                mine = order_of[cuts[c] : cuts[c + 1]]
                if not len(mine):
                    continue
                transform, common = files.get(c)
                new_transform, new_common = np.empty(len(transform) + len(mine), transform.dtype if len(transform) else kind), np.empty(len(transform) + len(mine), np.uint8)
                old = np.ones(len(new_common), bool)
                old[place[mine]] = False
                new_transform[old], new_common[old] = transform, common
                new_transform[place[mine]], new_common[place[mine]] = following[mine], before[mine]
                below = place[mine] + 1
                there = below < len(new_common)
                new_common[below[there]] = after[mine[there]]
                files.put(c, new_transform, new_common)
                files.counts[c] += np.bincount(following[mine], minlength=symbols)
            segment[alive], at[alive] = symbol, place
        return _read_out(files, symbols, m, sizes, length, kind)


def _read_out(files: Files, symbols: int, m: int, sizes: np.ndarray, length: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow every string through the finished transform to name its suffixes."""
    both = [files.get(c) for c in range(symbols)]
    transform = np.concatenate([b[0].astype(kind) for b in both])
    common = np.concatenate([b[1] for b in both])
    order = np.argsort(transform, kind="stable")
    down = np.empty(len(order), np.int32)
    down[order] = np.arange(len(order), dtype=np.int32)
    del order
    # ends of strings sort first among suffixes but their symbols stand where strings begin
    down += m - int(np.count_nonzero(transform == 0))
    who, start = np.full(len(transform), -1, np.int32), np.zeros(len(transform), np.uint8)
    at, alive = np.arange(m), np.arange(m)
    for j in range(int(sizes.max(initial=0)) + 1):
        alive = alive[sizes[alive] >= j]
        who[at[alive]], start[at[alive]] = alive, sizes[alive] - j
        alive = alive[sizes[alive] > j]
        at[alive] = down[at[alive]]
    long = common >= length
    member = long.copy()
    member[:-1] |= long[1:]
    return np.cumsum(~long)[member], who[member].astype(np.int64), start[member].astype(np.int64)


def _ranges(doc, salt, start) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Runs of adjacent starts of one document as (doc, salt, first, count)."""
    if not len(doc):
        return doc, salt, start, start
    order = np.lexsort((start, salt, doc))
    doc, salt, start = doc[order], salt[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (salt[1:] != salt[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], salt[first], start[first], start[last] - start[first] + 1


_RANGE = "doc long, salt long, start long, n long"


def _range_batch(doc, salt, start, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(x, np.int64)) for x in (doc, salt, start, n)], ["doc", "salt", "start", "n"])


def duplicate_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, salt, start, n): the starts whose window of `length` bytes has an earlier equal. `docs`: doc, salt, text."""
    spark = docs.sparkSession
    parts, piece, batch_size, hot = int(spark.conf.get("spark.sql.shuffle.partitions")), PIECE, BATCH, HOT

    def counted(batches):
        for _, data, ends, _ in pieces(batches, piece, length):
            _, _, _, h, _ = anchors(data, ends, length)
            found, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    twice = cut(docs.mapInArrow(counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    marks = spark.sparkContext.broadcast(np.packbits(_marks(twice)))

    def contexts(batches):
        known = np.unpackbits(marks.value).view(bool)
        for keys, data, ends, shifts in pieces(batches, piece, length):
            doc, first, n, h, at = anchors(data, ends, length)
            live = known[_bit(h)]
            doc, first, n, h, at = doc[live], first[live], n[live], h[live], at[live]
            raw = data.tobytes()
            names = [xxhash.xxh3_128_digest(raw[a : a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            local, again = set(), np.zeros(len(names), bool)
            for i, key in enumerate(zip(doc.tolist(), names, strict=True)):
                again[i] = key in local
                local.add(key)
            # adjacent repeats within a document are one range
            joins = np.zeros(len(again), bool)
            joins[1:] = again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1] + n[:-1])
            head = np.flatnonzero(~joins)
            n = np.add.reduceat(n, head) if len(head) else n
            doc, first, h, again = doc[head], first[head], h[head], again[head]
            names = [None if a else names[i] for i, a in zip(head.tolist(), again.tolist(), strict=True)]
            cores = [None if a else list(_cores(raw, f, f + k + length - 1, p, length)) for f, k, p, a in zip(first.tolist(), n.tolist(), at[head].tolist(), again.tolist(), strict=True)]
            owner = np.array([k[0] for k in keys], np.int64)[doc] if len(doc) else doc
            salt = np.array([k[1] for k in keys], np.int64)[doc] if len(doc) else doc
            start = first - ends[doc] + shifts[doc] if len(doc) else first
            yield pa.record_batch(
                [pa.array(h.view(np.int64)), pa.array(names, pa.binary()), pa.array(owner), pa.array(salt), pa.array(start), pa.array(n), pa.array(again), pa.array(cores, pa.list_(pa.int64()))],
                ["anchor", "name", "doc", "salt", "start", "n", "again", "cores"],
            )

    every = spill(docs.mapInArrow(contexts, "anchor long, name binary, doc long, salt long, start long, n long, again boolean, cores array<long>"), "contexts")
    free(spark)
    place = F.struct("doc", "salt", "start")
    fresh = every.where(~F.col("again"))
    one = cut(fresh.groupBy("anchor", "name").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("cores").alias("cores")))
    free(spark)
    copies = one.where("copies > 1").select("name", "place")
    removed = fresh.select("name", "doc", "salt", "start", "n").join(copies, "name").where(place != F.col("place")).select("doc", "salt", "start", "n")
    removed = cut(removed.union(every.where("again").select("doc", "salt", "start", "n")))
    drop_spill(every)
    free(spark)

    core = one.select("anchor", "name", F.explode("cores").alias("core"))
    shared = core.groupBy("core").count().where("count > 1").select("core")
    live = core.join(shared, "core").select("anchor", "name").distinct()
    left = cut(one.join(live, ["anchor", "name"], "left_semi").select("anchor", "place.*", "n"))
    groups = left.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    different = cut(left.join(groups, "anchor").select("anchor", "kinds", "doc", "salt", "start", "n"))
    del one, copies, core, shared, live, left, groups
    free(spark)
    by_doc = different.groupBy("doc", "salt").agg(F.collect_list(F.struct("anchor", "start", "n", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    near = marked(docs, different, "doc", DOC_BITS)
    met = near.join(by_doc, ["doc", "salt"]).select("doc", "salt", F.col("text").cast("binary").alias("text"), "wanted")

    def strings(batches):
        for batch in slices(batches, 2):
            rows = []
            for doc, salt, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    a, k = w["start"], w["n"]
                    if w["hot"]:  # its windows, by a hash
                        for b in range(a, a + k):
                            name = xxhash.xxh3_128_digest(text[b : b + length])
                            rows.append((int.from_bytes(name[:8], "little", signed=True), True, doc, salt, b, name))
                    else:
                        rows.append((w["anchor"], False, doc, salt, a, text[a : a + k + length - 1]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], ["anchor", "hot", "doc", "salt", "start", "body"])

    shape = "anchor long, hot boolean, doc long, salt long, start long, body binary"
    # few large constructions: the rounds of one cost the same whatever it holds
    tasks = max(min(parts, 6), -(-different.count() // batch_size))
    has_hot = not different.where(F.col("kinds") > hot).isEmpty()
    fetched = met.mapInArrow(strings, shape)
    if has_hot:
        fetched = cut(fetched)

    def construct(batches):
        held: list[pa.Table] = []
        for group in _groups(batches, 1):
            held.append(group)
            if sum(t.num_rows for t in held) >= batch_size:
                yield solve(pa.concat_tables(held))
                held = []
        if held:
            yield solve(pa.concat_tables(held))

    def solve(table: pa.Table) -> pa.RecordBatch:
        doc, salt, start = (table[c].to_numpy() for c in ("doc", "salt", "start"))
        group, who, at = equal_windows(table["body"].to_pylist(), length)
        order = np.lexsort((start[who] + at, salt[who], doc[who], group))
        later = order[1:][group[order[1:]] == group[order[:-1]]]  # all but the first of each group
        who, at = who[later], at[later]
        return _range_batch(*_ranges(doc[who], salt[who], start[who] + at))

    cold = fetched.where("not hot").select("anchor", "doc", "salt", "start", "body").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    removed = removed.union(cold.mapInArrow(construct, _RANGE))
    if has_hot:
        windows = fetched.where("hot").select("body", "doc", "salt", "start")
        least = windows.groupBy("body").agg(F.min(place).alias("place"), F.count("*").alias("c")).where("c > 1").drop("c")
        late = windows.join(least, "body").where(place != F.col("place"))
        removed = removed.union(late.select("doc", "salt", "start", F.lit(1).cast("long").alias("n")))
    return removed


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(24)) & np.uint64(BITMAP_BITS - 1)


def _cores(raw: bytes, first: int, end: int, at: int, length: int) -> Iterator[int]:
    """Hashes of stretches around the anchor at `at`, one of which every window of raw[first:end] has whole.

    A window leaves `length` - GRAM bytes to both sides of its anchor together; with the
    quarters of that, one of four splits into left and right lies inside it. Equal windows share a core, so
    contexts with no core of another context have no window of another.
    """
    quarter = (length - GRAM) // 4
    for i in range(4):
        left, right = i * quarter, (3 - i) * quarter
        if at - left >= first and at + GRAM + right <= end:
            yield xxhash.xxh3_64_intdigest(raw[at - left : at + GRAM + right], seed=i) - (1 << 63)


def _marks(twice: DataFrame) -> np.ndarray:
    """A bit for each anchor that occurs twice, by bits of its own hash: of fixed size."""
    bit = F.expr(f"shiftrightunsigned(anchor, 24) & {BITMAP_BITS - 1}L")
    words = twice.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("marks"))
    found = words.toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["marks"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _documents(df: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY))
    repeated = not df.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    salt = F.xxhash64(text_or_empty(text)) if repeated else F.lit(0).cast("long")
    return df.select(doc.alias("doc"), salt.alias("salt"), text_or_empty(text).alias("text")), salt


def _by_document(ranges: DataFrame) -> DataFrame:
    """(doc, salt, found) for each document that loses something; one list is bounded by its document."""
    found = cut(ranges.groupBy("doc", "salt").agg(F.collect_list(F.struct("start", "n")).alias("found")))
    free(ranges.sparkSession)
    return found


def _with_ranges(whole: DataFrame, found: DataFrame) -> DataFrame:
    """`whole` with its documents' ranges; documents that surely have none are not shuffled."""
    flagged = may_be_among(whole, found, "doc", DOC_BITS, "_may")
    joined = flagged.where("_may").drop("_may").join(found, ["doc", "salt"], "left")
    alone = flagged.where("not _may").drop("_may").withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    return joined.unionByName(alone)


def cover(texts: list[bytes], ranges: list, length: int = LENGTH) -> Iterator[tuple[bytes, int, int]]:
    """(kept bytes, removed bytes, removed runs) of each text."""
    for text, found in zip(texts, ranges, strict=True):
        if not found:
            yield text, 0, 0
            continue
        steps = np.zeros(len(text) + 1, np.int64)
        np.add.at(steps, [x["start"] for x in found], 1)
        np.add.at(steps, [x["start"] + x["n"] + length - 1 for x in found], -1)
        gone = np.cumsum(steps[:-1]) > 0
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        yield np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary), one row for each row of `df`."""
    docs, salt = _documents(df, key, text)
    found = _by_document(duplicate_ranges(docs, length))
    kind = df.schema[key].dataType
    whole = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("doc"), salt.alias("salt"), text_or_empty(text).cast("binary").alias("text"))
    met = _with_ranges(whole, found).select("key", "text", "found")

    def each(batches):
        for batch in slices(batches, 1):
            out = list(cover(batch.column(1).to_pylist(), batch.column(2).to_pylist(), length))
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.record_batch([batch.column(0), size, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[0] for x in out], pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    shape = T.StructType().add(key, kind).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return met.mapInArrow(each, shape)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`df` with the duplicate bytes cut out of its texts; characters cut in two go whole. Null texts stay null."""
    docs, salt = _documents(df, key, text)
    found = _by_document(duplicate_ranges(docs, length))
    names = df.columns
    plain = [f"_c{i}" for i in range(len(names))]  # the input's names may clash with ours
    whole = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("doc"), salt.alias("salt"), *[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain, strict=True)])
    met = _with_ranges(whole, found).select(*plain, "found")
    at = names.index(text)

    def each(batches):
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            cleaned = cover([(t or "").encode() for t in texts], batch.column(len(names)).to_pylist(), length)
            kept = [None if t is None else k[0].decode("utf-8", "ignore") for t, k in zip(texts, cleaned, strict=True)]
            columns = [pa.array(kept, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.record_batch(columns, names)

    return met.mapInArrow(each, df.schema)
