import random
import re

import pytest

from qualigraph.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


CASES = [None, "", " \t\n", "one two", "a b c d e", "a b c d e a b c d e", "x " * 40, "x\n" * 12, "# * $ <a> 😀é | & %\n\n\nq\nq", "w" * 100_000]


@pytest.mark.parametrize("seed", range(3))
def test_measures_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = CASES + [("".join(rng.choice(["a", "b", "c", "the"]) + rng.choice([" ", "  ", "\n", "\x0b"]) for _ in range(rng.randrange(120)))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, measures string")
    for r in quality.apply_rules(df).collect():
        m = r._quality.measures
        got = (m.n_words, m.word_chars, m.n_symbols, m.lines.dup, m.n_repeat_words, r._quality.base_failed)
        assert got == brute(r.text), r.text
        assert not (r._quality.kept and r._quality.base_failed)


def test_clean_text_is_kept_and_junk_rejected(spark):
    clean = " ".join(f"the word{i} of a plain sentence{i}" for i in range(40))
    junk = " ".join(f"word{i}### the*** of$$$" for i in range(40))
    df = spark.createDataFrame([(1, clean), (2, junk), (3, clean.upper().replace(" ", "!! ")), (4, None)], "doc_id long, text string")
    kept = quality.keep_good(df)
    assert kept.columns == ["doc_id", "text"]
    assert [r.doc_id for r in kept.collect()] == [1]


def test_no_user_function_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", quality.apply_rules(df)._jdf.queryExecution().executedPlan().toString().replace("ArrowEval", "Arrow").replace("ExistingRDD", ""))


def test_empty_table(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
