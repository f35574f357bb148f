import random
import re
from collections import defaultdict

import numpy as np
import pytest

from qualigraph.llm import jaccard
from qualigraph.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(k, len(s), None if k is None else root(k)) for k, s in sets]


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:  # an edited copy, from hardly to heavily changed
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words)) if words else 0
                words[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            texts.append(words)
        elif kind < 0.65:
            texts.append([word() for _ in range(rng.randrange(40))] + passage + [word() for _ in range(rng.randrange(20))])
        else:
            texts.append([word() for _ in range(rng.randrange(0, 120))])
    return [(i * 3 % 1000 + i // 1000, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]


EDGES = [(5001, None), (5002, ""), (5003, " \n "), (5004, "one two"), (5005, "ONE\ttwo"), (5006, "É é"), (5007, "é é"), (None, "one two"), (5008, "a b c d e"), (5009, "a b c d e f"), (5010, "a b c d"), (5010, "one two three"), (5011, "w " * 20000)]


@pytest.mark.parametrize("seed,hot_from,region", [(0, 64, 4096), (1, 3, 4096), (2, 3, 7)])
def test_components_against_brute_force(spark, monkeypatch, seed, hot_from, region):
    monkeypatch.setattr(jaccard, "HOT_FROM", hot_from)
    monkeypatch.setattr(jaccard, "REGION", region)
    rows = corpus(seed) + EDGES
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, content string, n int").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=by) == sorted(brute(rows), key=by)


@pytest.mark.parametrize("seed", range(20))
def test_region_join_connects_all_near_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(rng.choice([3, 30, 120])):
        if sets and rng.random() < 0.7:
            base = sorted(rng.choice(sets))
            s = set(base[rng.randrange(4) :]) | {rng.randrange(400) for _ in range(rng.randrange(4))}
        else:
            s = {rng.randrange(400) for _ in range(rng.randrange(5, 40))}
        sets.append(s or {1})
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    links = jaccard.region_join(arrays, list(range(len(sets))), small=4)
    for i, j in links:
        assert 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = jaccard._Forest(list(range(len(sets))))
    got = jaccard._Forest(list(range(len(sets))))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want.join(i, j)
    for i, j in links:
        got.join(i, j)
    assert [want.root(i) for i in range(len(sets))] == [got.root(i) for i in range(len(sets))]


def test_keep_one_and_empty(spark):
    rows = [(2, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (3, "x y z"), (None, "a b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in jaccard.keep_one(df).collect()) == [0, 1, 3, 4]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    reach = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            reach[a].add(b), reach[b].add(a)
    for x in reach:
        seen, todo = {x}, [x]
        while todo:
            for y in reach[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        assert got[x] == min(seen)
    assert set(got) == set(reach)


def test_shingles_of_a_slice():
    import pyarrow as pa

    texts = pa.array([f"ÉA b{i} Cd é d e f {i}" for i in range(20)])
    whole = jaccard.shingle_sets(texts, np.zeros(0, np.uint64))
    part = jaccard.shingle_sets(texts.slice(7, 5), np.zeros(0, np.uint64))
    assert [x.tolist() for x in part] == [x.tolist() for x in whole[7:12]]
