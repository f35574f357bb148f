"""BPE encoding and decoding through a table of distinct words.

Every text is split into words: a word starts at a blank that follows a character other
than white space, so the tokenizer's own pre-tokenizer also cuts there and words can be
encoded apart. A block is a run of rows of one task: its texts become positions in the block's
own lists of distinct words, and these codes wait in a file of the shared folder. The lists
are dealt by the word's hash, so each distinct word of the whole table is encoded once, in one
task; the answers go back to their blocks, where the ids are joined to the codes by position.
What is shuffled are compressed lists of distinct words and their ids: no text, no code and no
row per word occurrence. A hot word is one entry in each block, whatever its frequency.

Decoding joins ids to pieces: each batch's distinct ids meet the id-to-piece table (a row for
each id of the vocabulary, a file of fixed size) in a hash join, and the pieces are put in the
places of the ids.

Memory: a block holds `BLOCK_WORDS` words at most, or `SLICE_BYTES` of texts, or one text if that is longer; a bucket of
words holds one `buckets`-th of all distinct words; every row that is shuffled is a list of
one bucket of one block.

Lost executors: a block's file is named by its place and its content and moved into place
whole, so a repeated task leaves the same file. The input is cut from its lineage first; only a
frame that comes straight from files, whose rows are the same at each reading, may go without
(`stable`).

Defined results: null or empty texts have no ids; decoding null or no ids gives ''. Rows
are answered one by one, so repeated rows and repeated or null keys are kept. Columns other
than key and text are not carried; join them by key. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.llm.common import cut, lean, scratch, slices, text_or_empty

BLOCK_WORDS = 1_000_000
#: Bytes of text that are split at once.
SLICE_BYTES = 4 << 20
#: Tokens that one batch of results holds, or one row if that has more.
BATCH_IDS = 300_000


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool = False):
    """The library's tokenizer of a file; a plain one doesn't normalize, for words that are normal already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if plain:
        t.normalizer = normalizers.Sequence([])
    return t


def encode_words(path: str, words: list[str], step: int = 5000, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word, end to end, and their numbers."""
    tok, flat, counts = tokenizer(path, plain), [], []
    for i in range(0, len(words), step):
        found = [x.ids for x in tok.encode_batch_fast(words[i : i + step], add_special_tokens=False)]
        counts.extend(map(len, found))
        flat.append(np.array(list(itertools.chain.from_iterable(found)), np.int32))
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), np.array(counts, np.int64)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as four compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: pa.Array) -> bytes:
    """Words as their lengths and their bytes end to end."""
    words = words.cast(pa.large_binary())
    lengths = pack(pc.binary_length(words).to_numpy(zero_copy_only=False))
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(words.to_pylist()))
    return len(lengths).to_bytes(8, "little") + lengths + body


def unpack_words(data: bytes) -> list[str]:
    upto = 8 + int.from_bytes(data[:8], "little")
    ends = np.concatenate([[0], np.cumsum(unpack(data[8:upto]), dtype=np.int64)])
    body = pa.py_buffer(zstandard.ZstdDecompressor().decompress(data[upto:]))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), body).to_pylist()


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word from its text alone, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words.to_pylist()), np.int32, len(words))


def _after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space, by its UTF-8 bytes."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    found = ((one >= 0x09) & (one <= 0x0D)) | (one == 0x20)
    found |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))  # U+0085, U+00A0
    general = ((one >= 0x80) & (one <= 0x8A)) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)  # U+2000 to U+202F
    found |= (three == 0xE2) & (((two == 0x80) & general) | ((two == 0x81) & (one == 0x9F)))
    return found | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and their number in each: a blank after something else than white space starts one."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    blank = np.flatnonzero(data[bounds[0] : bounds[-1]] == 0x20) + bounds[0]
    blank = blank[blank > 0]
    starts = np.union1d(blank[~_after_space(data, blank)], bounds[:-1][np.diff(bounds) > 0])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1]).astype(np.int64)), texts.buffers()[2])
    return words, np.diff(np.searchsorted(starts, bounds))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(keys, words of all texts, their numbers), `limit` words at a time, or one slice of texts."""
    held, n = [], 0
    together = lambda: (pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held]))
    for batch in slices(batches, 1, min(SLICE_BYTES, 8 * limit)):
        words, counts = split_words(batch.column(1))
        if n and n + len(words) > limit:
            yield together()
            held, n = [], 0
        held.append((batch.column(0), words, counts))
        n += len(words)
    if held:
        yield together()


def _whole(a: pa.Array) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, position, ends): words by bucket and then by text, where each word stands, where buckets end."""
    bucket, by_text = bucket_of(words, buckets), pc.sort_indices(words).to_numpy()
    order = by_text[np.argsort(bucket[by_text], kind="stable")]
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    return order, position, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _store(folder: str, name: str, keys: pa.Array, lengths: np.ndarray, codes: np.ndarray) -> None:
    """A block's file: its keys, the numbers of words of its texts, and their codes."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    batch = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([pack(lengths)], pa.binary()), pa.array([pack(codes)], pa.binary())], ["keys", "lengths", "codes"])
    own = f"{at}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as out, pa.ipc.new_stream(out, batch.schema) as f:
        f.write_batch(batch)
    store.move(own, f"{at}/{name}")


def _fetch(folder: str, name: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{at}/{name}", compression=None) as f:
        row = pa.ipc.open_stream(f).read_all().combine_chunks()
    return row["keys"].chunk(0).values, unpack(row["lengths"][0].as_py()).astype(np.int64), unpack(row["codes"][0].as_py()).astype(np.int64)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None, block_words: int = BLOCK_WORDS, stable: bool = False) -> DataFrame:
    """Return (key, ids array<int>), one row for each row of `df`.

    `path` is a vocabulary file of the tokenizers library; special tokens in a text are found
    as the library does by default. `stable` says that `df` reads files without a shuffle, so
    that it need not be cut from its lineage.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    spark, kind = df.sparkSession, df.schema["key"].dataType
    if not stable:
        df = cut(df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, folder, key_type = buckets or max(8, parts), scratch(spark, "codes"), to_arrow_type(kind)

    def lists_of_words(batches):
        for number, (keys, words, lengths) in enumerate(_blocks(batches, block_words)):
            coded = words.dictionary_encode()
            listed, indices = coded.dictionary, coded.indices.to_numpy()
            order, position, ends = _by_bucket(listed, buckets)
            content = hashlib.md5(str(keys.to_pylist()).encode())
            for part in (lengths, indices, *listed.buffers()[1:]):
                content.update(part if part is not None else b"")
            name = f"{TaskContext.get().partitionId():06d}-{number:06d}-{content.hexdigest()}"
            _store(folder, name, keys, lengths, position[indices])
            filled = np.flatnonzero(np.diff(ends))
            # the row of bucket -1 stands for the block itself: how many lists it has
            data = [b"", *(pack_words(listed.take(pa.array(order[ends[b] : ends[b + 1]]))) for b in filled.tolist())]
            yield _rows([name] * len(data), [-1, *filled.tolist()], [len(filled)] * len(data), data)

    def encoded(batches):
        known, ids, now = {}, _Lists(), None  # of one bucket: each distinct word is encoded at its first sight
        for batch in batches:
            block, bucket, n, data = (c.to_pylist() for c in batch.columns)
            out = []
            for b, packed in zip(bucket, data, strict=True):
                if b < 0:
                    out.append(b"")
                    continue
                if b != now:
                    known, ids, now = {}, _Lists(), b
                listed = unpack_words(packed)
                if new := [w for w in listed if w not in known]:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    ids.add(*encode_words(path, new))
                flat, counts = take_lists(ids.flat, ids.starts, np.fromiter(map(known.__getitem__, listed), np.int64, len(listed)))
                counts = pack(counts)
                out.append(len(counts).to_bytes(8, "little") + counts + pack(flat))
            yield _rows(block, bucket, n, out)
        tokenizer.cache_clear()  # the stages after this one don't need the vocabulary

    def block_of(name, expected, answers):
        if len(answers) != expected:
            raise RuntimeError(f"block {name} has {len(answers)} of {expected} lists: its input was not the same at each reading")
        halves = [(unpack(x[8 : 8 + int.from_bytes(x[:8], "little")]), unpack(x[8 + int.from_bytes(x[:8], "little") :])) for x in answers]
        counts = np.concatenate([c for c, _ in halves] or [np.zeros(0, "<u4")]).astype(np.int64)
        ids = np.concatenate([i for _, i in halves] or [np.zeros(0, "<u4")]).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(counts)])
        keys, lengths, codes = _fetch(folder, name)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        longest, step = max(1, int(np.ceil(counts[codes].mean())) if len(codes) else 1), 0
        while step < len(lengths):  # some rows at a time
            upto = max(step + 1, int(np.searchsorted(ends, ends[step] + BATCH_IDS // longest, "right")) - 1)
            got, n = take_lists(ids, starts, codes[ends[step] : ends[upto]])
            offsets = np.concatenate([[0], np.cumsum(n)])[ends[step : upto + 1] - ends[step]]
            yield pa.record_batch([keys.slice(step, upto - step), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))], [key, "ids"])
            step = upto

    def together(batches):
        # sorted by block and bucket: a block's own row comes first, then its answers
        name, expected, answers = None, 0, []
        for batch in batches:
            for block, bucket, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != name:
                    if name is not None:
                        yield from block_of(name, expected, answers)
                    name, expected, answers = block, -1, []
                if bucket < 0:
                    expected = n
                else:
                    answers.append(data)
        if name is not None:
            yield from block_of(name, expected, answers)

    row = "block string, bucket int, n int, data binary"
    dealt = df.mapInArrow(lean(lists_of_words), row).repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(lean(encoded), row).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    return back.mapInArrow(lean(together), T.StructType().add(key, kind).add("ids", T.ArrayType(T.IntegerType())))


def _rows(block: list, bucket: list, n: list, data: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(block, pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "n", "data"])


class _Lists:
    """Lists of ids end to end; room doubles, so adding costs no more than what is added."""

    def __init__(self):
        self.flat, self.starts, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        end, n = int(self.starts[self.n]), len(counts)
        while len(self.flat) < end + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < self.n + n + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[end : end + len(ids)] = ids
        self.starts[self.n + 1 : self.n + n + 1] = end + np.cumsum(counts)
        self.n += n


def take_lists(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered `at`, end to end, and their lengths."""
    counts = starts[at + 1] - starts[at]
    total = int(counts.sum())
    shift = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(at) else at, counts)
    return flat[np.arange(total) + shift], counts


def pieces(path: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary; ids that it doesn't have are empty."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # shown as themselves
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    found = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        found[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return pa.array(found, pa.binary())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out`, the text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Ids that the vocabulary doesn't have, and null ids, stand for nothing.
    """
    columns = df.columns
    if out in columns:
        raise ValueError(f"the input has a column {out}")
    at, found = columns.index(ids), pieces(path)
    table = pa.table({"id": pa.array(np.arange(len(found), dtype=np.int32)), "piece": found})

    def each(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            ends, first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), 0
            while first < batch.num_rows:  # some rows at a time
                upto = max(first + 1, int(np.searchsorted(ends, ends[first] + BATCH_IDS, "right")) - 1)
                rows = batch.slice(first, upto - first)
                coded = pc.fill_null(_whole(rows.column(at).flatten()).cast(pa.int32()), -1).dictionary_encode()
                asked = pa.table({"id": coded.dictionary, "place": pa.array(np.arange(len(coded.dictionary)))})
                met = asked.join(table, "id", join_type="left outer", use_threads=False).sort_by("place")
                flat = pc.fill_null(_whole(met["piece"]), b"").take(coded.indices)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[first : upto + 1] - ends[first], pa.int32()), flat), b"")
                try:
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
                yield pa.record_batch([*rows.columns, texts], [*columns, out])
                first = upto

    return df.mapInArrow(lean(each), T.StructType(list(df.schema.fields)).add(out, "string"))
