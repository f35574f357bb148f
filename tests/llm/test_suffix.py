import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from qualigraph.llm import suffix


def brute(rows, length=100):
    """The rule itself over all windows; rows are (key, text), keys distinct."""
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = [True] * length
            else:
                seen[window] = 1
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), runs, kept)
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("external", [True, False])
def test_equal_windows(seed, external):
    rng = random.Random(seed)
    length = rng.choice([3, 8])
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(40))
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) + base[rng.randrange(30) :] for _ in range(rng.choice([1, 5, 40]))]
    strings += strings[:3] + [b"", b"a" * 200]
    if seed == 5:
        strings.append(bytes(range(256))[:255])
        strings.append(bytes(range(255, 0, -1)))
    want = defaultdict(set)
    for i, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            want[s[p : p + length]].add((i, p))
    got = defaultdict(set)
    for g, i, p in zip(*(x.tolist() for x in suffix.equal_windows(strings, length, external)), strict=True):
        got[g].add((i, p))
    assert set(map(frozenset, got.values())) == {frozenset(g) for g in want.values() if len(g) > 1}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij éü\n") for _ in range(n))
    passage, line = text(260), text(120)
    out = [None, "", "short", "x" * 99, "x" * 350, "ab" * 200, text(150) * 3, passage, line * 2, "é" * 300, "\x00" * 130]
    for _ in range(40):
        kind = rng.random()
        if kind < 0.3:
            t = list(rng.choice([x for x in out if x]))
            for _ in range(rng.choice([0, 1, 2])):
                t[rng.randrange(len(t))] = "#"
            out.append("".join(t))
        elif kind < 0.6:
            out.append(text(rng.randrange(90)) + passage[rng.randrange(100) :] + text(rng.randrange(60)) + line)
        else:
            out.append(text(rng.randrange(400)))
    keys = rng.sample(range(1000), len(out) - 1) + [None]
    rng.shuffle(keys)
    return list(zip(keys, out, strict=True))


@pytest.mark.parametrize("seed,batch,piece", [(0, 60_000, 128 << 10), (1, 3, 128 << 10), (2, 60_000, 300)])
def test_against_brute_force(spark, monkeypatch, seed, batch, piece):
    monkeypatch.setattr(suffix, "BATCH", batch)
    monkeypatch.setattr(suffix, "HOT", batch)
    monkeypatch.setattr(suffix, "PIECE", piece)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, salt string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.spans(df).collect()}
    assert got == brute(rows)


def test_remove_keeps_columns_and_whole_characters(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, start string")
    got = {r.doc_id: r for r in suffix.remove(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k].start == "x"
        assert got[k].text == (None if t is None else want[k][3].decode("utf-8", "ignore"))


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(1, 90)) + "0123456789" * 12
    df = spark.createDataFrame([(1, text), (1, text), (1, text + "!"), (2, "q" + text)], "doc_id long, text string")
    got = suffix.spans(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_removed").alias("gone")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 3, 2: 1}
    assert all(r.gone for r in got)
    assert suffix.spans(df.limit(0)).count() == 0
