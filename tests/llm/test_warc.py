import pytest
from pyspark.sql import functions as F

from qualigraph.llm import warc
from qualigraph.llm.common import new_folder

ROWS = [(i, f"http://x.example/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(300)] + [(None, None, None), (7, "http://twice", "again"), (400, "u", "é" * 200_000)]


def replicas(spark, change):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    out = []
    for made in (warc.records(df), change(warc.records(df))):
        folder = new_folder(spark, "warc")
        manifest = warc.write(made, folder, file_bytes=6_000)
        out.append((folder, warc.read(folder, manifest)))
    return out


def test_records_come_back(spark):
    (folder, rows), _ = replicas(spark, lambda d: d)
    got = rows.collect()
    assert len(got) == len(ROWS) and all(r.readable for r in got)
    assert sorted(r.key for r in got if r.key is not None) == sorted(k for k, _, _ in ROWS if k is not None)
    for f in {r.file for r in got}:
        own = sorted((r for r in got if r.file == f), key=lambda r: r.ordinal)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("range_bytes,fanout,depth", [(500, 2, 6), (65536, 16, 2)])
def test_audit_finds_exactly_what_changed(spark, range_bytes, fanout, depth):
    wear = lambda d: d.withColumn("record", F.when(F.col("key").isin(3, 77, 299), F.expr("concat(substring(record, 1, length(record) - 6), X'7E7E', substring(record, length(record) - 3))")).otherwise(F.col("record")))
    (_, ours), (_, theirs) = replicas(spark, wear)
    found = warc.audit(ours, theirs, range_bytes, fanout, depth).collect()
    at = {(r.file, r.offset): r.key for r in ours.collect()}
    assert sorted(at[r.file, r.offset] for r in found) == [3, 77, 299] and {r.status for r in found} == {"damaged"}
    assert warc.audit(ours, ours, range_bytes, fanout, depth).count() == 0


def test_missing_records(spark):
    (_, ours), (_, theirs) = replicas(spark, lambda d: d.where("key is null or key < 400"))
    found = warc.audit(ours, theirs).collect()
    # the page with key 400 is the last of its task's files, so nothing shifts
    gone = [(r.file, r.offset) for r in ours.collect() if r.key == 400]
    assert [(r.file, r.offset, r.status) for r in found] == [(*gone[0], "missing")]


def test_replicas_without_a_file_and_their_roots(spark):
    (folder, ours), _ = replicas(spark, lambda d: d)
    manifest = ours.select("file").distinct()
    assert warc.root(warc.tree(ours)) == warc.root(warc.tree(ours)) != None  # noqa: E711
    lost = max(r.file for r in manifest.collect())
    rest = ours.where(F.col("file") != lost)
    want = sorted((r.file, r.offset) for r in ours.collect() if r.file == lost)
    for a, b, status in ((ours, rest, "missing"), (rest, ours, "extra")):
        assert sorted((r.file, r.offset, r.status) for r in warc.audit(a, b).collect()) == [(*x, status) for x in want]
    assert warc.root(warc.tree(rest)) != warc.root(warc.tree(ours))


def test_a_copy_with_wear(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4)
    folder, copy = new_folder(spark, "warc"), new_folder(spark, "warc")
    manifest = warc.write(warc.records(df), folder, file_bytes=6_000)
    worn = warc.replicate(folder, manifest, copy, lambda key, record: record[:-5] + b"~" + record[-4:] if key in ("7", "250") else record)
    assert worn.count() == manifest.count() > 4
    got = warc.report(warc.read(folder, manifest), warc.read(copy, worn)).collect()
    assert sorted(r.key for r in got if r.status != "intact") == [7, 7, 250] and {r.status for r in got} == {"intact", "damaged"}
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("swap", [False, True])
def test_report_has_the_records_of_both_replicas(spark, swap):
    """One replica lacks a record of each file, so later offsets shift; swapped, it has one more."""
    (_, ours), (_, theirs) = replicas(spark, lambda d: d.where("key is null or key % 90 != 5"))
    primary, replica = (theirs, ours) if swap else (ours, theirs)
    mine, other = ({(r.file, r.offset): (r.key, r.length, r.digest) for r in d.collect()} for d in (primary, replica))
    want = {(*at, *row, "missing" if at not in other else "intact" if other[at][1:] == row[1:] else "damaged") for at, row in mine.items()}
    want |= {(*at, *row, "extra") for at, row in other.items() if at not in mine}
    got = [(r.file, r.offset, r.key, r.length, r.digest, r.status) for r in warc.report(primary, replica).collect()]
    assert {x[-1] for x in want} >= {"missing", "extra", "intact"}
    assert len(got) == len(want) and set(got) == want


def test_report_of_an_unreadable_member(spark):
    from pathlib import Path

    (_, ours), (folder, theirs) = replicas(spark, lambda d: d)
    path = max(Path(folder.removeprefix("file://")).glob("*.warc.gz"), key=lambda p: p.stat().st_size)
    data = bytearray(path.read_bytes())
    data[12:15] = b"\xff\xff\xff"
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(bytes(data))
    got = warc.report(ours, theirs).collect()
    file = int(path.name.split("-")[0])
    assert sum(r.status != "extra" for r in got) == len(ROWS)
    assert all((r.status == "intact") == (r.file != file) for r in got)
    assert [r.status for r in got if r.file == file and r.offset == 0] == ["damaged"]
    assert any(r.status == "extra" for r in got)


def test_damaged_members_are_skipped():
    import zlib

    def member(x):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    data = member(b"one" * 50) + member(b"two" * 50) + member(b"three" * 500_000)
    at = len(member(b"one" * 50))
    broken = data[: at + 12] + b"\xff\xff\xff" + data[at + 15 :]
    assert [c for _, _, c in warc.members(data)] == [b"one" * 50, b"two" * 50, b"three" * 500_000]
    got = [c for _, _, c in warc.members(broken)]
    assert got[0] == b"one" * 50 and got[-1] == b"three" * 500_000 and None in got
    assert warc.parse(b"nonsense") is None and warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    rows = warc.read(folder, warc.write(warc.records(df), folder))
    assert rows.count() == 0 and warc.audit(rows, rows).count() == 0
