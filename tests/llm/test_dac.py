import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from qualigraph.llm import dac
from qualigraph.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70000, 7)), [3] * 200])
def test_every_id_is_addressable(ids):
    codes = dac.Codes(dac.to_bytes([5], np.array([len(ids)]), np.array(ids, np.uint32)))
    assert [codes[i] for i in range(len(codes))] == ids
    assert codes.document(0).tolist() == ids
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert codes.take(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_wrong_file():
    with pytest.raises(ValueError):
        dac.Codes(b"something else, long enough")


def test_stops_after_every_character():
    """Each character before and after a stop, with and without letters beside it, as the library has it."""
    tok = Tokenizer.from_file(PATH)
    points = [chr(c) for c in (*range(1, 0x3000), *range(0xA640, 0xD7FF, 3), *range(0xF900, 0x20000, 5)) if not 0xD800 <= c < 0xE000]
    for form in ("{0}. a{0}, {0}a.", "{0},{0}. x.{0}", "{0}\u0307. {0}.. '{0}."):
        texts = [form.format(c) for c in points]
        ids, counts = dac._encode_batch(PATH, pa.array(texts), 2)
        ends = np.concatenate([[0], np.cumsum(counts)])
        wrong = [t for t, x, a, b in zip(texts, tok.encode_batch(texts, add_special_tokens=False), ends[:-1], ends[1:], strict=True) if [*x.ids, 2] != ids[a:b].tolist()]
        assert not wrong


def test_random_texts():
    tok, rng = Tokenizer.from_file(PATH), random.Random(5)
    pool = "aBcİıſßŸÀé ΣςαЖ.,'!3 \t\n\u0301\u0307ﬁŉǅ中-<|"
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 25))) for _ in range(30_000)]
    ids, counts = dac._encode_batch(PATH, pa.array(texts), 2)
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [[*x.ids, 2] for x in tok.encode_batch(texts, add_special_tokens=False)] == [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@pytest.mark.parametrize("file_ids", [5, 4_000_000])
def test_round_trip_against_the_library(spark, file_ids):
    texts = ["Hello  World!", None, "", "  \n", "a <|endoftext|> B<|startoftext|>c <|ENDOFTEXT|> É. ß, a., x.. Ÿ. ª. 3. '. don't.", "héé İ ΑΣ ς", "é x y 　z", "w" * 3000, "The same. " * 500, "a b"]
    rows = [((i * 7) % 11, t, "x") for i, t in enumerate(texts)] + [(None, "null key", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    folder = new_folder(spark, "dac")
    manifest = dac.write(df, PATH, folder, 2, partitions=3, file_ids=file_ids)
    whole = {r.start: r.ids for r in dac.read(folder, manifest).collect()}
    tok = Tokenizer.from_file(PATH)
    start = 0
    found = {r.start: r for r in dac.read(folder, manifest, checksums=True).collect()}
    assert len(found) == len(rows)
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[start]
        assert whole[start] == ids
        assert (r.key, r.n_tokens, r.ids_crc32) == (key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark):
    folder = new_folder(spark, "dac")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dac.read(folder, dac.write(empty, PATH, folder, 2), checksums=True).count() == 0
