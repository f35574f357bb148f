from collections import Counter

import pytest

from qualigraph.llm import sharding


def slow_table(shards, slots):
    """Every shard's whole permutation first, then turns."""
    order = []
    for s in shards:
        offset, skip = sharding._hash(f"offset:{s}") % slots, sharding._hash(f"skip:{s}") % (slots - 1) + 1
        order.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(order[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for i, preferred in enumerate(order):
            if free := [x for x in preferred if x not in owner]:
                owner[free[0]] = i
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("shards,slots", [(("a",), 7), (("a", "b", "c"), 13), (tuple("abcdefg"), 101)])
def test_table_against_slow_construction(shards, slots):
    table = sharding.lookup_table(shards, slots)
    assert table == slow_table(shards, slots)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    moved = sum(b != a for b, a in zip(before, after, strict=True) if b != 19)
    assert moved < 0.1 * len(before)


def test_wrong_tables_are_refused(spark):
    for shards, slots in (((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)
    with pytest.raises(ValueError):
        sharding.place(spark.range(1).selectExpr("id", "1 shard"), "id")


def test_placement(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "k long, text string")
    rows = sharding.place(df, "k").collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.k == 1}) == 1
    owner = sharding.lookup_table()
    assert all(owner[r.slot] == r.shard for r in rows)
    assert sharding.place(df.limit(0), "k").count() == 0
    plan = sharding.place(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    sharding.write_shards(df, "k", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_even_shares(spark):
    n = Counter(r.shard for r in sharding.place(spark.range(20000), "id").collect())
    assert len(n) == 64 and max(n.values()) < 1.5 * 20000 / 64
