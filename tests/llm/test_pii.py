import random
import re

import numpy as np
import pytest

from qualigraph.llm import pii


def brute(text):
    """The patterns as they are written, with the checks after."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def random_text(rng):
    parts = ["a.b@c.d", "x@y", "@", "@a.b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.002.3.4", "4532015112830366", "4532 0151-1283 0366", "+1 (555) 123-4567", "+1", "+12 ", "é", "😀", " ", "-", ".", "%", "\n", "7", "99999999999999999999"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(14)))


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = random_text(rng)
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 400_000, "+1" + " " * 400_000, "a@" * 200_000):
        pii.base_spans(text)


def test_gradient_against_differences():
    tagger = pii.Tagger(hidden=3, embed=4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    tagger.p["step"] = rng.normal(size=tagger.p["step"].shape)
    x, y = rng.integers(0, 20, (7, 3)), rng.integers(0, pii.LABELS, (7, 3))
    _, grads = tagger.gradient(x, y)
    for k, v in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape) if k != "embed" else (int(x[2, 1]), 1)
        keep = v[at]
        v[at] = keep + 1e-3
        up = tagger.gradient(x, y)[0]
        v[at] = keep - 1e-3
        down = tagger.gradient(x, y)[0]
        v[at] = keep
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3, k


def test_crf_against_enumeration():
    import itertools

    tagger = pii.Tagger(hidden=2, embed=2)
    rng = np.random.default_rng(3)
    tagger.p["step"] = rng.normal(size=tagger.p["step"].shape)
    e = rng.normal(size=(3, 1, pii.LABELS))
    paths = list(itertools.product(range(pii.LABELS), repeat=3))
    score = np.array([sum(e[t, 0, p[t]] for t in range(3)) + tagger.p["step"][p[0], p[1]] + tagger.p["step"][p[1], p[2]] for p in paths])
    weight = np.exp(score - score.max())
    p, _, log_z = tagger.marginals(e)
    assert abs(log_z[0] - np.log(weight.sum()) - score.max()) < 1e-6
    assert tuple(tagger.decode(e)[:, 0]) == paths[int(score.argmax())]
    assert abs(p[1, 0, 2] - sum(w for w, q in zip(weight, paths, strict=True) if q[1] == 2) / weight.sum()) < 1e-6


@pytest.fixture(scope="module")
def tagger():
    return pii.train(())


def test_held_out_accuracy(tagger):
    x, y = pii.training_windows([], 400, seed=99)
    path = tagger.decode(tagger.scores(x)[0])
    assert (path == y).mean() > 0.98


def test_added_spans_and_clean_texts(tagger):
    text = "Call the office at (555) 867-5309 or on 212-555-0187 before noon. " + "no numbers here " * 20
    found = pii.tag(tagger, [text, "In 1999 there were 365 days, 12 months and 2021-03-04.", ""])
    assert [text[a:b] for k, a, b in found[0] if k == "phone"] == ["(555) 867-5309", "212-555-0187"]
    assert found[1:] == [[], []]


def test_reconcile_takes_the_greatest_sum():
    rng = random.Random(5)
    import itertools

    for _ in range(60):
        rows = [(rng.random(), ("ip", a, a + rng.randrange(1, 6))) for a in (rng.randrange(15) for _ in range(6))]
        fixed = [("card", 7, 9)]
        apart = lambda s: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations([*s, *fixed], 2))
        best = {}
        for score, s in rows:
            best[s] = max(score, best.get(s, 0))
        want = max(sum(best[s] for s in c) for n in range(7) for c in itertools.combinations(best, n) if apart(c))
        got = pii.reconcile(rows, fixed)
        assert apart(got) and abs(sum(best[s] for s in got) - want) < 1e-9


def test_frames(spark):
    rows = [(1, "mail a.b@c.de now", "x"), (2, None, "y"), (None, "", "z"), (1, "mail a.b@c.de now", "x"), (3, "+1 (555) 123-4567, 1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.redact(df).collect()
    assert sorted(str(r.text) for r in got) == sorted(["mail [EMAIL] now", "None", "", "mail [EMAIL] now", "[PHONE], [IP]"])
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in found[3]] == [("phone", 0, 17, True), ("ip", 19, 26, True)]
    assert pii.redact(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.find(df, out="kind")


def test_copies_do_not_crowd_out_the_training_texts(spark):
    from pyspark.sql import functions as F

    few = spark.range(20).select(F.concat(F.lit("call 555 010 "), F.col("id").cast("string")).alias("text"))
    df = few.crossJoin(spark.range(60).select(F.lit(1))).repartition(4)
    want = [r.text for r in few.orderBy(F.xxhash64("text")).collect()]
    assert pii.sample_texts(df, rows=10) == tuple(want[:10])
    assert pii.sample_texts(df, rows=30) == tuple(want)
