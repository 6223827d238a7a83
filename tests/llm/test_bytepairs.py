"""Byte-level BPE by tree reduction against the library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from convspan.llm import bytepairs, registry

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
PARTS = ["a", "b", " ", "  ", "the", "ing", "\n", "\t", "é", "😀", "!", "1", "漢", "​", "'", "'s", "'ll", "'re", "l", "e", "　", "\x1c", "zz", "the the", "...", "\r\n"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def merges():
    return bytepairs.Merges(RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("chars,size,heap", [(1, 1, 64), (3, 2, 64), (7, 4, 8), (50, 32, 64), (16_384, 32, 64)])
def test_like_the_library(merges, library, monkeypatch, chars, size, heap):
    monkeypatch.setattr(bytepairs, "LEAF_CHARS", chars)
    monkeypatch.setattr(bytepairs, "LEAF_BYTES", size)
    monkeypatch.setattr(bytepairs, "HEAP_BYTES", heap)
    monkeypatch.setattr(bytepairs, "LEAF_IDS", 3)
    rng = random.Random(chars)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1200)]
    texts += ["".join(rng.choice(letters[: rng.randint(1, 27)]) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    texts += ["", " ", "a" * 700, " " * 700, "ab" * 300, "'" * 99, "1" * 200, "é" * 200, "\n " * 90, "x" + " " * 90 + "y"]
    for text in texts:
        ids = merges.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert merges.decode(ids) == text.encode()


def test_every_character_like_the_library(merges, library):
    """Letters, numbers and white space are those of the library's Unicode tables."""
    for first in range(0, 0x110000, 0x1000):
        text = "".join(f"{chr(c)}a {chr(c)}1 " for c in range(first, first + 0x1000) if not 0xD800 <= c < 0xE000)
        assert merges.encode(text).tolist() == library.encode_ordinary(text), hex(first)


def test_long_texts(merges, library):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    text = " ".join(rng.choice(words) for _ in range(900_000))
    assert len(text) > 5_000_000 and np.array_equal(merges.encode(text), library.encode_ordinary(text))
    one = "".join(rng.choice("abcde") for _ in range(200_000))  # one piece
    ids = merges.encode(one)
    assert b"".join(merges.tokens[t] for t in ids.tolist()) == one.encode() and all(merges.stays(a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()))


def test_table(docs, empty, library):
    odd = docs.withColumn("ids", F.lit(1)).withColumn("packed", F.lit("x"))
    got = bytepairs.encode_documents(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=("ids", "packed", "decoded")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
        assert bytes(r.packed) == np.array(r.ids, "<u4").tobytes()
    assert bytepairs.encode_documents(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_query(spark, real, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    wanted = {}
    for r in real.collect():
        ids = library.encode_ordinary(r.text or "")
        wanted[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))
    got = registry.op11_tree_bytepairs(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(wanted) and all(wanted[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
