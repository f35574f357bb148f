import itertools
import random
from collections import defaultdict

import pytest

from qualigraph.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(0, 60), 9)
    counts = [rng.randrange(1, 30) for _ in lengths]
    for k in (1, 2, 3, 4, 20):
        got = packing.optimal_boundaries(lengths, counts, k)
        assert got == sorted(set(got)) and len(got) <= k and got[-1] == max(lengths)
        rest = sorted(lengths)[:-1]
        least = min(padding(lengths, counts, (*c, max(lengths))) for m in range(min(k, 9)) for c in itertools.combinations(rest, m))
        assert padding(lengths, counts, got) == least
    assert packing.optimal_boundaries([], [], 3) == []


def test_pack_keeps_every_token_and_the_budget(spark):
    rng = random.Random(1)
    texts = [None, "", "   ", "a", "a b " * 500] + ["w " * rng.randrange(1, 90) for _ in range(200)] + ["same text"] * 300
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(texts)] + [(5, "w w", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int").repartition(5)
    got = packing.pack(df, max_length=64, buckets=4, token_budget=256).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for k, t, _ in rows:
        want[k] += len((t or "").split())
    assert tokens == want
    assert len({r.bucket_length for r in got}) <= 4
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_length <= 64
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = defaultdict(int)
    for b in batches.values():
        assert len({r.bucket_length for r in b}) == 1
        room = 256 // b[0].bucket_length
        assert sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= room
        short[b[0].bucket_length] += len(b) < room
    assert max(short.values()) <= 1


def test_ties_have_an_order_whatever_the_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 2]), "w " * rng.randrange(40) + rng.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shape = lambda d: sorted(map(tuple, packing.pack(d, max_length=64, buckets=4, token_budget=256).collect()), key=str)
    one = shape(df.repartition(7))
    assert one == shape(df.coalesce(1)) == shape(df.orderBy("text"))
    short = defaultdict(list)
    for key, _, _, n, _, batch, slot in one:
        short[key].append((batch, slot, n))
    assert all([n for *_, n in sorted(x)] == sorted(n for *_, n in x) for x in short.values())


def test_empty_table_and_wrong_budget(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, max_length=10, token_budget=9)
