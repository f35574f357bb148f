import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from qualigraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello  world, it's 12 o'clock\n\n  now",
    "", None, " ", "   \n\t ", "a  <|endoftext|> b<|endoftext|>", "   x 　 y", "héé ñ 世界 😀 ퟿",
    "word " * 3000, "x" * 5000, "Hello  world, it's 12 o'clock\n\n  now", "tab\tand\r\nline ", "̀ é   z",
]


@pytest.mark.parametrize("block_words", [7, 4_000_000])
def test_encode_and_decode_as_the_library(spark, block_words):
    rows = [(i if i != 3 else None, t, "extra") for i, t in enumerate(TEXTS)] + [(1, "again", "extra")]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("words", "string")
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = bpe.decode(bpe.encode(df, PATH, block_words=block_words, buckets=5), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for key, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, tok.decode(ids, skip_special_tokens=False)))
    by = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=by) == sorted(want, key=by)


def test_empty_table_and_bytes_that_are_no_text(spark):
    schema = T.StructType().add("doc_id", "long").add("text", "string")
    assert bpe.encode(spark.createDataFrame([], schema), PATH).count() == 0
    tok = Tokenizer.from_file(PATH)
    ids = [tok.encode("é", add_special_tokens=False).ids[:1], None, [], [188, 10]]
    df = spark.createDataFrame([(x,) for x in ids], "ids array<int>")
    got = [r.decoded for r in bpe.decode(df, PATH).collect()]
    assert got == [tok.decode(x or [], skip_special_tokens=False) for x in ids]


def test_words_start_at_blanks_after_other_characters():
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    others = "a.é中😀\u200b\u2010\u00c2\u180e\ufeff\u1681\u3001\x1c\x1f"
    rng = random.Random(3)
    texts = [None if i % 97 == 0 else "".join(rng.choice(rng.choice([spaces, others, " "])) for _ in range(rng.randrange(12))) for i in range(3000)]
    texts = [t or "" for t in texts]
    for part in (texts, texts[5:5], [""], texts[:40]):
        words, counts = bpe.split_words(pa.array(part, pa.string()))
        want = [[w for w in re.split(f"(?<=[^{spaces}])(?= )", t) if w] for t in part]
        assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [w for x in want for w in x]
    words, counts = bpe.split_words(pa.array(["x y", *texts]).slice(1, 50))
    assert counts.sum() == len(words) and "".join(words.to_pylist()) == "".join(texts[:50])


@given(st.lists(st.text(max_size=12), max_size=8))
@settings(max_examples=200, deadline=None)
def test_encoding_by_words_is_the_library_s(texts):
    words, counts = bpe.split_words(pa.array(texts, pa.string()))
    ids, sizes = bpe.encode_words(PATH, words.to_pylist())
    tok, at = bpe.tokenizer(PATH), 0
    ends = [0, *sizes.cumsum().tolist()]
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[ends[at] : ends[at + n]].tolist() == tok.encode(text, add_special_tokens=False).ids
        at += n
