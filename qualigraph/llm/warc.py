"""WARC files and their fixity audit with Merkle trees.

Pages become WARC/1.1 resource records, one gzip member each, in files of a bounded size. Each
task writes its own rows in their order, so nothing is shuffled and no key can fill a file. An
audit reads a replica's files back, hashes every record, and hashes ordered offset ranges
bottom-up: a leaf is a range of `RANGE_BYTES` of the uncompressed file and holds the records
that start in it, a node above holds `FANOUT` adjacent ranges, then come the file, the files of
a task, `PARTS` adjacent tasks, and one root for the replica. Two replicas are compared from
their roots; at each level only children of nodes that differ are compared, down to the
records that differ. Intact replicas cost one comparison.

Nodes are keyed by file and range, so a tree of any size is built by grouping: no group is
larger than a range's records, FANOUT nodes or a task's files.

A file's number is its task's number and its own within the task. The names of files are
unique to an attempt, and only those of the attempts that counted are in the manifest, so
lost executors leave no doubled or half files.

Defined results: a null or empty page is a record of no content; a null key's record has an
empty key. Rows with equal keys stay apart. A record that can't be decompressed or parsed gets
status `damaged` and the reader goes on at the next gzip member. Records that one replica alone
has are `missing` or `extra`, and so are all records of a file that one replica alone has.
Empty tables have no files and audits of them no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualigraph.llm.common import cut

FILE_BYTES = 32 << 20
RANGE_BYTES = 64 << 10
FANOUT = 16
DEPTH = 2
#: A file's number is that of its task times FILES plus its own.
FILES = 1 << 20
PARTS = 1 << 10
MAGIC = b"\x1f\x8b\x08"


def record(key: Column, url: Column, html: Column) -> Column:
    """The uncompressed bytes of a page's record."""
    content = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    name = F.md5(F.concat_ws("|", key.cast("string"), url).cast("binary"))
    part = lambda a, n: F.substring(name, a, n)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(F.regexp_replace(url, r"[\r\n]", ""), F.lit("")),
        F.lit("\r\nX-Row-Key: "),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(header.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, record), a row for each page, where it lies."""
    return pages.select(F.col(key).cast("long").alias("key"), record(F.col(key), F.col(url), F.col(html)).alias("record"))


def _packed(data) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


MANIFEST = "file long, path string, n_records long"


class _Writer:
    """Writes members to files of a task; a file ends once it holds `file_bytes` uncompressed."""

    def __init__(self, folder: str, first: int, file_bytes: float):
        from pyarrow import fs

        self.store, self.at = fs.FileSystem.from_uri(folder)
        self.file, self.limit, self.out, self.size, self.n, self.name = first, file_bytes, None, 0, 0, ""

    def add(self, member, size: int) -> None:
        if self.out is None:
            self.name, self.size, self.n = f"{self.file:012d}-{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(f"{self.at}/{self.name}", compression=None)
        self.out.write(member)
        self.size, self.n = self.size + size, self.n + 1

    def full(self) -> bool:
        return self.size >= self.limit

    def row(self) -> Iterator[pa.RecordBatch]:
        """The manifest's row of the file at hand, if any; the next one starts."""
        if self.out is not None:
            self.out.close()
            yield pa.record_batch([pa.array([self.file], pa.int64()), pa.array([self.name]), pa.array([self.n], pa.int64())], ["file", "path", "n_records"])
            self.out, self.file = None, self.file + 1


def write(made: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records to .warc.gz files in `folder`; return the manifest (file, path, n_records)."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Writer(folder, TaskContext.get().partitionId() * FILES, file_bytes)
        for batch in batches:
            for data in batch.column(0):
                out.add(_packed(data.as_buffer()), len(data.as_buffer()))
                if out.full():
                    yield from out.row()
        yield from out.row()

    # the plan is run once, by the checkpoint: the manifest names the files of the attempts that counted
    return cut(made.select("record").mapInArrow(files, MANIFEST))


def _each_file(manifest: DataFrame, folder: str, make: Callable, shape: str) -> DataFrame:
    """`make(file, bytes)` of each file; a task reads the files that one task has written, one after the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{path}", compression=None) as f:
                    data = f.read()
                yield from make(file, data)

    return manifest.select("file", "path").mapInArrow(each, shape)


def replicate(folder: str, manifest: DataFrame, target: str, change: Callable[[str, bytes], bytes]) -> DataFrame:
    """Copy the files to the folder `target`, member by member; `change(key, record)` may return another record. Return the copy's manifest."""

    def copied(file: int, data: bytes) -> Iterator[pa.RecordBatch]:
        out, whole = _Writer(target, file, float("inf")), memoryview(data)
        for at, size, content in members(data):
            fields = parse(content) if content is not None else None
            after = change(fields[0].get("X-Row-Key", ""), content) if fields else content
            out.add(whole[at : at + size] if after == content else _packed(after), 0)
        yield from out.row()

    return cut(_each_file(manifest, folder, copied, MANIFEST))


def members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, compressed length, content) of each gzip member; None where it can't be read."""
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        try:
            content = unpacker.decompress(data[at:] if len(data) - at < 1 << 20 else memoryview(data)[at : at + (1 << 20)])
            taken = min(len(data) - at, 1 << 20)
            parts = [content]
            while not unpacker.eof and at + taken < len(data):
                parts.append(unpacker.decompress(memoryview(data)[at + taken : at + taken + (1 << 20)]))
                taken += min(1 << 20, len(data) - at - taken)
            if not unpacker.eof:
                raise zlib.error("cut off")
            end = at + taken - len(unpacker.unused_data)
            yield at, end - at, b"".join(parts)
        except zlib.error:
            following = data.find(MAGIC, at + 1)
            end = following if following >= 0 else len(data)
            yield at, end - at, None
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and payload, or None if it is no whole record."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != b"WARC/1.1":
        return None
    fields = {k.decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = fields.get("Content-Length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return fields, rest[:-4]


RECORD = "file long, ordinal long, key long, offset long, length long, packed_offset long, packed_length long, readable boolean, digest string"


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files with its place and its sha256 (not its payload)."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.bool_(), pa.string()]

    def each(file: int, data: bytes) -> Iterator[pa.RecordBatch]:
        rows, offset, whole = [], 0, memoryview(data)
        for ordinal, (at, packed, content) in enumerate(members(data)):
            fields = parse(content) if content is not None else None
            key = fields[0].get("X-Row-Key", "") if fields else ""
            digest = hashlib.sha256(b"unreadable" if content is None else content)
            if content is None:
                digest.update(whole[at : at + packed])
            size = packed if content is None else len(content)
            rows.append((file, ordinal, int(key) if key.lstrip("-").isdigit() else None, offset, size, at, packed, fields is not None, digest.hexdigest()))
            offset += size
            if len(rows) == 10_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _each_file(manifest, folder, each, RECORD)


def tree(rows: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """All nodes as (level, file, node, up_file, up_node, hash): its place and that of the node above.

    Level 0 are records, `depth` + 1 files, then the files of a task, `PARTS` tasks, and the
    replica's root alone. The table is cut from its lineage, so an audit's joins read it and don't
    build it again.
    """
    mark = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    below = rows.select(F.lit(0).alias("level"), "file", F.col("offset").alias("node"), F.col("file").alias("up_file"), F.floor(F.col("offset") / range_bytes).alias("up_node"), mark.alias("hash"))
    # a hash covers its children's places too, so the same hashes elsewhere make another node
    children = F.transform(F.sort_array(F.collect_list(F.struct("file", "node", "hash"))), lambda x: F.concat_ws(" ", x["file"].cast("string"), x["node"].cast("string"), x["hash"]))
    found, zero = below, F.lit(0).cast("long")
    for level in range(1, depth + 5):
        grouped = below.groupBy(F.col("up_file").alias("file"), F.col("up_node").alias("node")).agg(F.sha2(F.concat_ws("\n", children).cast("binary"), 256).alias("hash"))
        up_file = F.col("file") if level <= depth else F.floor(F.col("file") / FILES) if level == depth + 1 else F.floor(F.col("file") / PARTS) if level == depth + 2 else zero
        up_node = F.floor(F.col("node") / fanout) if level < depth else zero
        below = cut(grouped.select(F.lit(level).alias("level"), "file", "node", up_file.alias("up_file"), up_node.alias("up_node"), "hash"))
        found = found.unionByName(below)
    return cut(found)


def root(nodes: DataFrame) -> str | None:
    """The replica's root hash; None for a replica without records."""
    top = nodes.groupBy().agg(F.max(F.struct("level", "hash"))["hash"].alias("hash")).first()
    return top["hash"]


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Records that differ between two replicas: file, offset, status (damaged, missing, extra).

    `primary` and `replica` are rows of `read`. From the roots down, nodes are joined with the
    parents that differ, so intact branches are left at their highest equal node.
    """
    ours, theirs = tree(primary, range_bytes, fanout, depth), tree(replica, range_bytes, fanout, depth)
    wrong = None
    for level in range(depth + 4, -1, -1):
        mine, other = (t.where(F.col("level") == level) for t in (ours, theirs))
        if wrong is not None:
            mine, other = mine.join(wrong, ["up_file", "up_node"], "left_semi"), other.join(wrong, ["up_file", "up_node"], "left_semi")
        both = mine.select("file", "node", F.col("hash").alias("mine")).join(other.select("file", "node", F.col("hash").alias("other")), ["file", "node"], "full_outer")
        differing = cut(both.where(~F.col("mine").eqNullSafe(F.col("other"))))
        wrong = differing.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("damaged")
    return differing.select("file", F.col("node").alias("offset"), status.alias("status"))


def report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The rows of `primary` with their `status`, `intact` if the audit finds nothing, and those of `replica` that are extra."""
    wrong = audit(primary, replica)
    extra = F.col("status") == "extra"
    ours = primary.join(wrong.where(~extra), ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    return ours.unionByName(replica.join(wrong.where(extra), ["file", "offset"]))
