"""Token ids as directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level j holds chunk j of every id
that has one, and a continuation bitmap that says which ids go on to level j + 1. A rank
directory (ones before each word of 64 bits) turns a position at one level into the
position at the next, so any id is read with one byte and one rank at each level, without
decoding a block.

File: magic, number of documents, number of ids, number of levels; the documents' keys and
starts; then for each level its length, chunks, bitmap and directory. All numbers are
little-endian.

Files are written in ascending key order: rows are dealt by ranges of the key, sorted
inside a task, and cut into files of `file_ids` ids or one document. Executors write under
unique names to the shared folder; only files that the winning attempts report are
read, so lost executors and repeated attempts leave no doubled or half documents. A file's
global start is the sum of the ids of the tasks before, a row for each task, and of its own
task's files before it, which the task has counted: no sum goes over all files or tokens.

Defined results: a null or empty text has the end id alone. Null keys come first. Rows with equal
keys stay apart, in the order of their texts. Columns other than key and text are not
carried. An empty table writes no files and reads as an empty table.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualigraph.llm.bpe import encode_words, take_lists
from qualigraph.llm.common import cut, slices, text_or_empty

MAGIC = b"QGDAC001"
CHUNK_BITS = 8
FILE_IDS = 4_000_000
#: Bytes of text encoded at once; the positions of their ids take some thirty times that.
BATCH_BYTES = 5 << 20
#: Words whose ids a worker remembers between batches.
MEMO_WORDS = 300_000
_NULL = -(1 << 63)


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, ones before each bitmap word) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest >= 1 << CHUNK_BITS
        bits = np.zeros((len(rest) + 63) // 64 * 64, bool)
        bits[: len(rest)] = goes_on
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap), dtype=np.int64)])[:-1]
        out.append(((rest & 0xFF).astype(np.uint8), bitmap, ones.astype("<u4")))
        rest = rest[goes_on] >> CHUNK_BITS
        if not len(rest):
            return out


def to_bytes(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = levels_of(ids)
    parts = [MAGIC, struct.pack("<QQQ", len(keys), len(ids), len(levels))]
    parts.append(np.array([_NULL if k is None else k for k in keys], "<i8").tobytes())
    parts.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    for chunks, bitmap, ones in levels:
        pad = b"\0" * (-len(chunks) % 8)
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), pad, bitmap.tobytes(), ones.tobytes(), b"\0" * (-ones.nbytes % 8)]
    return b"".join(parts)


class Codes:
    """Reads a file's bytes; `ids[i]` touches one byte and one rank a level."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, self.n, depth = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.keys = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 8 * docs + 8 * (docs + 1)
        self.levels = []
        for _ in range(depth):
            (n,) = struct.unpack_from("<Q", data, at)
            words = (n + 63) // 64
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            bitmap = np.frombuffer(data, "<u8", words, at)
            ones = np.frombuffer(data, "<u4", words, at + 8 * words)
            at += 8 * words + 4 * words + -(4 * words) % 8
            self.levels.append((chunks, bitmap, ones))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, ones) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK_BITS * level
            word, bit = divmod(i, 64)
            bits = int(bitmap[word])
            if not bits >> bit & 1:
                break
            i = int(ones[word]) + (bits & ((1 << bit) - 1)).bit_count()
        return value

    def take(self, first: int, end: int) -> np.ndarray:
        """A range, level by level."""
        lo, hi, value, live = first, end, np.zeros(end - first, np.uint32), np.arange(end - first)
        for level, (chunks, bitmap, ones) in enumerate(self.levels):
            value[live] |= chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[lo // 64 : (hi + 63) // 64].view(np.uint8), bitorder="little")
            goes_on = bits[lo % 64 : lo % 64 + hi - lo].astype(bool)
            if lo == hi or not goes_on.any():
                break
            word, bit = divmod(lo, 64)
            lo = int(ones[word]) + (int(bitmap[word]) & ((1 << bit) - 1)).bit_count()
            live = live[goes_on]
            hi = lo + len(live)
        return value

    def document(self, number: int) -> np.ndarray:
        return self.take(int(self.starts[number]), int(self.starts[number + 1]))


class _Memo:
    """Ids of the words a worker has met, as lists end to end."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

        self.lists(["", ".", ","])  # 0, 1 and 2 from now on

    def lists(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, number of each word's list); words are distinct."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.flat, self.starts, at
        # the vocabulary's normal form of lower-case ASCII words is the word
        plain = np.fromiter((words[i].isascii() and words[i] == words[i].lower() for i in missing), bool, len(missing))
        missing = np.concatenate([missing[plain], missing[~plain]])
        new = [words[i] for i in missing]
        halves = [encode_words(self.path, new[: plain.sum()], plain=True), encode_words(self.path, new[plain.sum() :])]
        more, counts = (np.concatenate(x) for x in zip(*halves, strict=True))
        flat, starts = np.concatenate([self.flat, more]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        at[missing] = np.arange(len(self.known), len(self.known) + len(new))
        if room := max(0, MEMO_WORDS - len(self.known)):
            self.known.update(zip(new[:room], range(len(self.known), MEMO_WORDS), strict=False))
            self.flat, self.starts = flat[: starts[len(self.known)]].copy(), starts[: len(self.known) + 1].copy()
        return flat, starts, at


_memo = functools.lru_cache(maxsize=2)(_Memo)

#: A full stop or comma after one of these letters is a word of its own. They are letters in every version of
#: Unicode and have one letter as their lower case; U+0130 has two characters, and the second takes the stop.
LETTER_AND_STOP = "[a-zß-öø-\u012f\u0131-ſ][.,]$"


def _encode_batch(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers: words between white space are encoded apart, once a batch.

    Case is lost in this vocabulary and a stop after a letter is cut off by its own rules, so
    lower-case words without stops stand for all. Words that may hold special tokens are
    left as they are.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    coded = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    words = coded.dictionary
    words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
    stopped = pc.match_substring_regex(words, LETTER_AND_STOP)
    bases = pc.if_else(stopped, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    listed, starts, at = _memo(path).lists(bases.dictionary.to_pylist())
    cut_off = np.where(stopped.to_numpy(zero_copy_only=False), np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), 1, 2), 0)
    two = np.stack([at[bases.indices.to_numpy()], cut_off], 1)
    table, counts = take_lists(listed, starts, two.reshape(-1))
    starts = np.concatenate([[0], np.cumsum(counts.reshape(-1, 2).sum(1))])
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, per_word = take_lists(table, starts, coded.indices.to_numpy().astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(lengths)])]
    return np.insert(ids, upto[1:], end_id), np.diff(upto) + 1


def write(df: DataFrame, path: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode with a vocabulary that drops white space, write files, return their manifest.

    Manifest: part, number, path, n_docs, n_ids, before (ids of the part's files before); (part, number) ascends with the key.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        df.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
        .repartitionByRange(partitions, F.col("key").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    )

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        store, at = fs.FileSystem.from_uri(folder)
        held: list = []

        def out():
            nonlocal number, before, held
            keys = [k for x in held for k in x[0]]
            ids = np.concatenate([x[2] for x in held])
            name = f"{at}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(name) as f:
                f.write(to_bytes(keys, np.concatenate([x[1] for x in held]), ids))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name.rpartition("/")[2]]), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([before], pa.int64())], ["part", "number", "path", "n_docs", "n_ids", "before"])
            number, before, held = number + 1, before + len(ids), []
            return row

        for batch in slices(batches, 1, BATCH_BYTES):
            ids, counts = _encode_batch(path, batch.column(1), end_id)
            keys, ends, first = batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum(counts)]), 0
            while first < len(keys):
                room = file_ids - sum(len(x[2]) for x in held)
                upto = int(np.searchsorted(ends, ends[first] + room, "right")) - 1
                if upto <= first and held:
                    yield out()
                    continue
                upto = max(upto, first + 1)
                held.append((keys[first:upto], counts[first:upto], ids[ends[first] : ends[upto]]))
                first = upto
        if held:
            yield out()

    # the plan is run once, by the checkpoint: the manifest names the files of the attempts that counted
    return cut(dealt.mapInArrow(files, "part int, number int, path string, n_docs long, n_ids long, before long"))


def read(folder: str, manifest: DataFrame, checksums: bool = False) -> DataFrame:
    """Read the manifest's files back: key, start (ids of all documents before), n_tokens, ids.

    With `checksums`, ids_crc32 stands for ids: the unsigned crc32 of a document's ids as
    little-endian unsigned 32-bit integers, taken where they are read.
    """
    last, shape = ("ids_crc32", "long") if checksums else ("ids", "array<long>")
    # a row for each task that wrote files: no more than the partitions of `write`
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = manifest.join(F.broadcast(starts), "part").select("path", (F.col("first") + F.col("before")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{path}", compression=None) as f:
                    codes = Codes(f.read())
                step = 0
                while step < len(codes.keys):
                    upto = max(step + 1, int(np.searchsorted(codes.starts, codes.starts[step] + 200_000, "right")) - 1)
                    first, end = int(codes.starts[step]), int(codes.starts[upto])
                    keys = codes.keys[step:upto]
                    starts = codes.starts[step : upto + 1]
                    ids, ends = codes.take(first, end), (starts - first).tolist()
                    if checksums:
                        values = pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                    else:
                        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                    yield pa.record_batch(
                        [
                            pa.array(keys, mask=keys == _NULL),
                            pa.array(starts[:-1] + base),
                            pa.array(np.diff(starts)),
                            values,
                        ],
                        ["key", "start", "n_tokens", last],
                    )
                    step = upto

    # a task reads the files that one task has written, one after the other
    return placed.mapInArrow(documents, f"key long, start long, n_tokens long, {last} {shape}")
