"""Encoders against the public libraries, files against a round trip."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamis.llm import elias_fano, matrix_bpe
from tamis.llm.pretokens import PATTERN, PieceCache, TextEncoder, matches, pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'stre 1.\n\t  　é日", max_size=40))
def test_pieces_keep_the_matches(text):
    assert [m for p in pieces(text) for m in PATTERN.findall(p)] == PATTERN.findall(text)
    assert "".join(pieces(text)) == text
    assert all(matches(p) == PATTERN.findall(p) for p in pieces(text) if p)
    shown = lambda part: "".join(f"<{m}>" for m in PATTERN.findall(part))
    coder = TextEncoder(lambda m: f"<{m}>".encode(), lambda words: [shown(" " + w).encode() for w in words])
    for _ in range(2):  # new words, then known ones
        assert coder.encode([text, text + ".", text])[0].decode() == shown(text)
        assert coder.encode([text + "."])[0].decode() == shown(text + ".")


def test_matrix_encoder(library):
    bpe = matrix_bpe.model(RANKS)
    rnd = random.Random(1)
    words = ["", "a", " the", "日本語", "aaaa" * 700, "\n\n", *("".join(rnd.choices("etaoin shrdlu%é'", k=rnd.randint(1, 60))) for _ in range(2000))]
    cache = PieceCache(bpe.encode, lambda ids: ids)
    cut = [pieces(w) for w in words]
    cache.learn(cut)
    got = [[i for p in c if p for i in cache.known[p]] for c in cut]
    assert got == [library.encode_ordinary(w) for w in words]
    assert [bpe.decode(ids) for ids in got] == [w.encode() for w in words]


def test_long_pieces():
    """Cut where no token spans, and equal pairs merged at once: the ids of the library, in few rounds."""
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    bpe = matrix_bpe.model(RANKS)
    rnd = random.Random(3)
    alphabets = ["ab", "aab ", "the and ing", "ABCDEFGHabcdefgh0123+/", "  \n-=", "日本語中文大学生", "etaoinshrdlu"]
    words = ["".join(rnd.choices(a, k=k)) for a in alphabets for k in (30, 40, 255, 257, 1000, 5000)] + ["a" * k for k in (1, 33, 63, 4097)]
    assert bpe.encode(words) == [whole.encode_ordinary(w) for w in words]
    for a in alphabets[3:]:
        text = "".join(rnd.choices(a, k=100_000)).encode()
        parts = bpe.parts(text)
        assert b"".join(parts) == text and max(map(len, parts)) < 1000


def test_merges_that_make_a_lower_pair_wait_for_it():
    """Ranks where a merged pair meets its neighbour below its own rank, so that equal pairs may not go at once."""
    rnd = random.Random(5)
    for _ in range(60):
        made = [bytes([b]) for b in range(256)]
        while len(made) < 290:
            token = rnd.choice(made[97:99] + made[256:]) + rnd.choice(made[97:99] + made[256:])
            if token not in made and len(token) <= 8:
                made.append(token)
        order = made[256:]
        rnd.shuffle(order)
        ranks = {t: i for i, t in enumerate(made[:256] + order)}
        whole = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rnd.choices("ab", k=k)) for k in (10, 33, 40, 90, 300, 400)]
        assert matrix_bpe.MatrixBpe(ranks).encode(words) == [whole.encode_ordinary(w) for w in words]


def test_encode_documents(library, odd, none):
    got = sorted(((r["key"], r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in matrix_bpe.encode_documents(odd, RANKS).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert matrix_bpe.encode_documents(none, RANKS).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=0, max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    made = elias_fano.EliasFano.from_bytes(memoryview(elias_fano.EliasFano.of(np.array(values, np.uint64)).to_bytes()))
    assert made.all().tolist() == values
    assert [made.get(i) for i in range(0, len(values), 7)] == values[::7]


def test_space_of_boundaries():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(elias_fano.EliasFano.of(ends).to_bytes()) < 50_000 * 14 / 8


def test_files(odd, none, small, spark, sf):
    tok = Tokenizer.from_file(JSON)
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        manifest, folder = elias_fano.write_tokens(docs, JSON, end_id=2, file_bytes=20_000)
        rows = sorted(elias_fano.read_tokens(manifest, folder).collect(), key=lambda r: r["start"])
        start, keys = 0, []
        left = {}
        for r in docs.collect():
            left.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2])
        for r in rows:
            assert r["start"] == start and r["ids"] in left[r["key"]]
            left[r["key"]].remove(r["ids"])
            assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            start += r["n_tokens"]
            keys.append(-(2**70) if r["key"] is None else r["key"])
        assert keys == sorted(keys) and not any(left.values())
    assert elias_fano.read_tokens(*elias_fano.write_tokens(none, JSON, end_id=2)).collect() == []


def test_added_tokens_in_texts():
    tok = Tokenizer.from_file(JSON)
    encode = elias_fano._encoder(JSON, 2)
    mark = "<|endoftext|>"
    for text in (f"foo {mark} bar", mark, f"{mark}{mark}", f" {mark}", f"a{mark} b\n\n{mark}", f"{mark[:-1]} {mark[1:]}", "<|endof text|>", "no mark"):
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_one_document_by_select():
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 5)]
    file = elias_fano.TokenFile(elias_fano.pack([None, 4, 9], ids, 2))
    assert file.keys() == [None, 4, 9] and [file.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]


def test_bulk_words_and_line_breaks():
    """Known and new words in one call, breaks inside words, marks, letters of many scripts, very long words."""
    tok = Tokenizer.from_file(JSON)
    encode = elias_fano._encoder(JSON, 2)
    rng = np.random.default_rng(9)
    parts = ["word", "Naïve", "größer", "日本語", "don't", "x1", "end.", "a,", "\n", ".\n", "\n\n", "e\u0301t\u00e9", "\u00a0b", "z" * 90, "ʼn", "…", "ﬁn", "\t", "--"]
    texts = ["".join(str(rng.choice(parts)) + str(rng.choice(["", " ", " ", "\n"])) for _ in range(rng.integers(0, 30))) for _ in range(600)]
    for turn in range(2):
        for text, own in zip(texts, encode(texts)):
            assert np.frombuffer(own, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_reading_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(elias_fano, "FILE_BYTES", 1 << 20)
    docs = spark.createDataFrame([(i, "ab " * (i % 7)) for i in range(3000)], "doc_id bigint, text string")
    got = elias_fano.read_tokens(*elias_fano.write_tokens(docs, JSON, end_id=2)).orderBy("key").collect()
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    assert [r["key"] for r in got] == list(range(3000))
