"""Byte-level BPE by ranks against the library, and its perfect hash."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rubrica.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
EDGE = ["", " ", "a", " \n\n x", "don't we'll I'Ve ''s", "<|endoftext|>", "é😀\x00\x85 ende", "z" * 200_000, "ab " * 20_000, " " * 5_000, "1234 ٣٤", "'", "naïve—text…"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def check(ranks, library, texts):
    ids, at = ranks.encode(texts)
    data, bounds = ranks.decode(ids, at)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(text)
        assert data[bounds[i] : bounds[i + 1]] == text.encode()


def test_edge_texts(ranks, library):
    check(ranks, library, EDGE)
    check(ranks, library, [])


def test_every_code_point(ranks, library):
    check(ranks, library, ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="abst '’vreldm\n\t 01é中,.!")), max_size=6))
def test_equals_library(ranks, library, texts):
    check(ranks, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_equals_plain_rounds(ranks, word):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    one = np.frombuffer(word, np.uint8)
    assert ranks.merge_words(one, np.array([0]), np.array([len(one)])) == [[ranks.ranks[p] for p in parts]]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=12), max_size=300), st.lists(st.binary(max_size=12), max_size=50))
def test_perfect_hash(keys, others):
    keys = sorted(keys)
    found = byte_bpe.PerfectHash(keys)
    assert sorted(found.slots.tolist()) == list(range(len(keys)))  # minimal: each slot holds one key
    asked = keys + others
    ends = np.cumsum([len(k) for k in asked] or [0])[: len(asked)].astype(np.int64)
    starts = ends - np.array([len(k) for k in asked], np.int64)
    got = found.find(np.frombuffer(b"".join(asked), np.uint8), starts, ends).tolist()
    assert got == [keys.index(k) if k in keys else -1 for k in asked]


def test_whole_words_need_no_merge(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "merge", lambda *_: pytest.fail("merged a vocabulary entry"))
    words = [t for t in ranks.ranks if len(t) > 1][:5000]
    ends = np.cumsum([len(w) for w in words])
    key = ranks.hash.find(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert ranks.of_key[key].tolist() == [ranks.ranks[w] for w in words]
    ranks.encode([" the and of"])


def test_tables(spark, ranks, library):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(i, t, "x", [1]) for i, t in enumerate(EDGE)] + [(None, None, "x", None), (3, "a", "x", None), (3, "a", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, ids array<int>")
    got = sorted(map(tuple, byte_bpe.round_trip(df, path).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df, path), path)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back.where("doc_id IS NOT NULL").collect()) == sorted((i, (t or "").encode()) for i, t, *_ in rows if i is not None)
    assert byte_bpe.round_trip(df.limit(0), path).count() == 0
