"""Each registered query on a small folder, all columns of its contract against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from qualigraph.llm import packing, pii
from qualigraph.llm.queries import QUERIES, ROT

WORDS = "the a river stone light wind über naïve 世界 mother seven 12 x1 don't end. stop, Über".split()
rng = random.Random(11)


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "\n", "  "]) for _ in range(n))


PASSAGE = " ".join(f"{rng.choice(WORDS)}{i}" for i in range(60))
LONG = prose(400)
TEXTS = [None, "", "   ", "one", "one two three four", "One two THREE four", LONG, LONG, LONG.upper(), LONG + " tail", LONG.replace("river", "lake", 1)]
TEXTS += [prose(rng.randrange(5, 120)) for _ in range(25)]
TEXTS += [prose(40) + " " + PASSAGE + " " + prose(40) for _ in range(4)] + [PASSAGE + " " + PASSAGE, "é" * 130 + "x" + "é" * 130, "z" * 250]
TEXTS += ["mail a.b@c.de or +1 (555) 123-4567 now", "10.0.0.1 and 999.1.1.1, card 4532 0151 1283 0366", "İ. ALİ, x. a<|endoftext|> \t b", "1.2.3.4.5.6.7.8 @ a@b", "word " * 300]
DOCS = [(7 * i % 53 if i % 5 else 100 + i, t) for i, t in enumerate(TEXTS)]
rng.shuffle(DOCS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    n = len(DOCS)
    assert len({k for k, _ in DOCS}) == n
    docs = pa.table({"doc_id": pa.array([k for k, _ in DOCS], pa.int64()), "text": [t for _, t in DOCS], "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for _, t in DOCS], pa.int64())})
    pq.write_table(docs, where / "documents.parquet", row_group_size=9)
    pq.write_table(pa.table({"page_id": pa.array(range(300), pa.int64()), "url": [f"http://x/{i}" for i in range(300)], "html": [None if i == 5 else f"<p>{i}</p>" * (i % 40) for i in range(300)]}), where / "pages.parquet")
    g = np.random.default_rng(3)
    base = g.standard_normal((60, 24))
    rows = [*base, *(base[:40] + 0.28 * g.standard_normal((40, 24))), *base[:5], np.zeros(24), np.full(24, np.nan)]
    vectors = pa.array([None, *[list(map(float, r)) for r in rows]], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": vectors, "label": pa.array([1] * len(vectors), pa.int32())}), where / "embeddings.parquet")
    return str(where)


def rows(spark, folder, name, key="doc_id"):
    found = QUERIES[name](spark, folder).collect()
    by = {r[key]: r for r in found}
    assert len(by) == len(found)
    return by


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def smallest(ids, links):
    """The least id reachable from each."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op1(spark, folder):
    got = sorted(QUERIES["op1_packing"](spark, folder).collect(), key=lambda r: (r.doc_id, r.sequence))
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in DOCS}
    assert [(r.doc_id, r.sequence, r.start, r.n_tokens) for r in got] == [(k, 0, 0, size[k]) for k in sorted(size)]
    counts = {n: list(size.values()).count(n) for n in set(size.values())}
    bounds, batch = packing.optimal_boundaries(list(counts), list(counts.values())), 0
    for low, high in zip([-1, *bounds], bounds):
        own, room = [r for r in got if low < r.n_tokens <= high], packing.TOKEN_BUDGET // max(high, 1)
        assert [(r.bucket_length, r.batch, r.slot) for r in own] == [(high, batch + i // room, i % room) for i in range(len(own))]
        batch += -(-len(own) // room)


def test_op2(spark, folder):
    got, seen = rows(spark, folder, "op2_suffix_dedup"), set()
    for key, text in sorted(DOCS):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(data[a : a + 100])
        r, runs = got.pop(key), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), int(gone.sum()), runs)
        assert r.kept_sha256 == sha(bytes(b for b, g in zip(data, gone, strict=False) if not g))
    assert not got


def test_op4(spark, folder):
    got, tok = rows(spark, folder, "op4_bpe"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(got) == len(DOCS)
    for key, text in DOCS:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == want


def test_op5(spark, folder):
    got = rows(spark, folder, "op5_warc", "page_id")
    rots = {i for i in range(300) if hashlib.md5(f"rot:{i}".encode()).hexdigest()[:2] == ROT}
    assert {k: r.status for k, r in got.items()} == {i: "damaged" if i in rots else "intact" for i in range(300)} and rots


def test_op6(spark, folder):
    got = rows(spark, folder, "op6_jaccard")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for key, text in DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = smallest(sets, links)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), least[k]) for k, s in sets.items()} and len(links) > 5


def test_op7(spark, folder):
    got, tok, start = rows(spark, folder, "op7_token_codes"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    assert len(got) == len(DOCS)
    for key, text in sorted(DOCS):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, folder):
    got = rows(spark, folder, "op8_pii")
    assert len(got) == len(DOCS)
    for key, text in DOCS:
        base, r = pii.base_spans(text or ""), got[key]  # held against the patterns themselves in test_pii
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        listed = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(",") if r.spans else [])
        spans = [(int(a), pii.KINDS.index(k)) for k, a, _ in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans)


def test_op9(spark, folder):
    got = rows(spark, folder, "op9_collisions", "vec_id")
    vectors = {i: np.array(v, np.float64) for i, v in enumerate(pq.read_table(f"{folder}/embeddings.parquet")["embedding"].to_pylist()) if v and np.isfinite(v).all() and np.any(v)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in vectors for b in vectors if a < b and cosine(vectors[a], vectors[b]) >= 0.9]
    least = smallest(got, links)
    want = {i: (sum(i in x for x in links), least[i], least[i] == i) for i in got}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == want and len(links) > 20 and len(got) == 108


def test_op10(spark, folder):
    got = rows(spark, folder, "op10_quality")
    for key, text in DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        again = {w for w in windows if windows.count(w) > 1}
        repeated = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        r = got.pop(key)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated))
        assert r.base_failed is failed and not (failed and r.kept)
    assert not got
