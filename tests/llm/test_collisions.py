import math

import numpy as np
import pytest
from pyspark.sql import types as T

from qualigraph.llm import collisions


def brute(rows, threshold=0.9):
    good = [(k, np.array(v, np.float64)) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = {}, {k: k for k, _ in rows if k is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (k, x) in enumerate(good):
        for m, y in good[:a]:
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[k], links[m] = links.get(k, 0) + 1, links.get(m, 0) + 1
                p, q = root(k), root(m)
                up[max(p, q)] = min(p, q)
    return {k: (links.get(k, 0), root(k)) for k in up}


def corpus(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.5:
            base = np.array(rows[rng.integers(len(rows))])
            rows.append((base + rng.normal(0, rng.choice([0.0, 0.05, 0.1, 0.13]), dim)).astype(np.float32).tolist())
        else:
            rows.append(rng.normal(0, 1, dim).astype(np.float32).tolist())
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, [3e37] * dim]
    ids = rng.permutation(len(rows) * 2)[: len(rows)].tolist()
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed,block", [(0, None), (1, 40), (2, 40)])
def test_against_brute_force(spark, seed, block):
    rows = corpus(seed)
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer").add("rep", "string")
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in [*rows, (None, rows[0][1])]], schema).repartition(4)
    got = {r.vec_id: r for r in collisions.near_duplicates(df, block=block).collect()}
    want = brute(rows)
    none = got.pop(None)
    assert (none.n_links, none.component_id, none.kept) == (0, None, True)
    found = sum(r.n_links for r in got.values())
    real = sum(n for n, _ in want.values())
    assert 0.99 * real <= found <= real
    assert all(got[k].n_links <= want[k][0] and got[k].kept == (got[k].component_id == k) for k in want)
    if found == real:
        assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want


def test_recall_on_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    x = collisions.unit(rng.normal(size=(3000, 64)))
    other = rng.normal(size=(3000, 64))
    other = collisions.unit(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * other
    found = {(i, j) for a, b in collisions.pairs(x, y, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert sum((i, i) in found for i in range(3000)) >= 0.995 * 3000
    assert all((x[i] * y[j]).sum() >= 0.9 for i, j in found)


def test_recall_at_the_threshold_over_several_blocks(spark):
    """End to end, blocks that are left out included: pairs that are only just near."""
    rng = np.random.default_rng(4)
    x = collisions.unit(rng.normal(size=(1200, 64)))
    other = rng.normal(size=(1200, 64))
    other = collisions.unit(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * other
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.DoubleType()))
    got = collisions.near_duplicates(spark.createDataFrame(rows, schema).repartition(4), block=200).collect()
    linked = [r for r in got if r.vec_id >= 1200 and r.component_id == r.vec_id - 1200]
    assert len(linked) >= 0.995 * 1200 and sum(r.n_links for r in got) <= 2 * 1200


def test_earlier_links_follow_their_roots():
    label = np.arange(601)
    for i, j in [([5, 3], [500, 600]), ([500], [600])]:
        label = collisions.roots(601, np.array(i), np.array(j), label)
    assert label[[3, 5, 500, 600]].tolist() == [3] * 4
    rng = np.random.default_rng(7)
    for _ in range(20):
        links = rng.integers(0, 400, (300, 2))
        label, want = np.arange(400), np.arange(400)
        for at in range(0, 300, 25):
            label = collisions.roots(400, links[at : at + 25, 0], links[at : at + 25, 1], label)
        for _ in range(400):
            for a, b in links.tolist():
                want[a] = want[b] = min(want[a], want[b])
        assert label.tolist() == want.tolist()


@pytest.mark.parametrize("block", [None, 200])
def test_chains_over_many_batches_of_queries(spark, block):
    """A long path of near vectors whose ids are shuffled, so its links come in many batches."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        base = np.zeros(64)
        base[k] = 1.0
        turn = np.zeros(64)
        turn[(k + 1) % 64] = 1.0
        # steps of 20 degrees: neighbours link (cosine 0.94), and the last is near the next plane's first
        rows += [(math.cos(math.radians(20 * s)) * base + math.sin(math.radians(20 * s)) * turn).tolist() for s in range(5)]
    for _ in range(700 - len(rows)):
        rows.append(rng.normal(0, 1, 64).tolist())
    rows = list(zip(rng.permutation(len(rows)).tolist(), rows, strict=True))
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.DoubleType()))
    got = {r.vec_id: (r.n_links, r.component_id) for r in collisions.near_duplicates(spark.createDataFrame(rows, schema).repartition(4), block=block).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    schema = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.DoubleType()))
    assert collisions.near_duplicates(spark.createDataFrame([], schema)).count() == 0
