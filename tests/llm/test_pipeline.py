import random

import corpus_pipeline
from qualigraph.llm import packing, pii
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_quality import brute as quality_counts
from tests.llm.test_suffix import brute as passages


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join("the" if i % 7 == 0 else word() for i in range(n))
    shared = text(60)
    rows = [(i, text(rng.randrange(60, 160))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[i][1] + " " + word()) for i in range(5)]
    rows += [(300 + i, text(40) + " " + shared + " " + text(40)) for i in range(4)]
    rows += [(400, "too short"), (401, None), (402, ""), (403, "### " * 50), (404, text(50) + " mail to a.b@c.example.com or +1 (555) 123-4567 now")]
    rng.shuffle(rows)
    return [(k, t, "en", "s", len(t or "")) for k, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            want = {k: t for k, t in want.items() if not quality_counts(t)[5] and k != 403}
        elif name == "jaccard_near_duplicates":
            want = {k: want[k] for k, _, c in groups(list(want.items())) if k == c}
        elif name == "suffix_array_passages":
            want = {k: v[3].decode("utf-8", "ignore") for k, v in passages(list(want.items())).items()}
        else:
            want = {k: pii.redacted(t, pii.base_spans(t)) for k, t in want.items()}
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert {300, 404} <= set(want) and not {100, 200, 400, 401, 403} & set(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in packed if r.sequence == 0} == {k: len(t.split()) for k, t in want.items()}
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, packed))
    assert packing.TOKEN_BUDGET >= max(r.bucket_length for r in packed)


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
