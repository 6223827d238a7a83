"""Encoders against the library and against plain merges."""

import json
import random

import pytest

from convspan.operators import encoders, tokens

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FILE = public.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
PARTS = ["a", "b", " ", "  ", "the", "ing", "\n", "\t", "é", "😀", "!", "12", "漢字", "​", "'", "'s", "'ll", "<|endoftext|>", "<|end", "　", "\x1c", "…", "Größe"]


@pytest.fixture(scope="module")
def raw():
    return json.loads(open(FILE, "rb").read())


def agree(raw: dict, texts: list[str]) -> None:
    own, library = encoders.BytePairs(raw), tokenizers.Tokenizer.from_str(json.dumps(raw))
    for text in texts:
        found = library.encode(text, add_special_tokens=False)
        ids, starts, ends = own.encode(text)
        assert ids == found.ids and list(zip(starts, ends)) == found.offsets, text
        assert [own.names[t] for t in ids] == found.tokens


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    return mixed + ["", "x" * 500, "ab" * 300, "é" * 200, "😀" * 90, " " * 99 + "x", "etaoin" * 100]


def test_like_the_library(raw, monkeypatch):
    agree(raw, texts(1))
    monkeypatch.setattr(encoders, "HEAP_SYMBOLS", 3)
    agree(raw, texts(2)[:300])


def test_other_files_like_the_library(raw):
    """An expression of its own before bytes, merges as strings, whole pieces first, two added tokens of which one begins with the other."""
    other = json.loads(json.dumps(raw))
    expression = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    other["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": expression}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    other["model"]["merges"] = [" ".join(m) for m in raw["model"]["merges"]]
    other["model"]["ignore_merges"] = True
    other["added_tokens"].append(other["added_tokens"][0] | {"id": 50257, "content": "<|end"})
    agree(other, texts(3))


def test_what_is_not_read_is_refused(raw):
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": raw["model"] | {"end_of_word_suffix": "</w>"}}, {"model": {"type": "WordPiece"}}, {"added_tokens": [raw["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            encoders.BytePairs(raw | change)
    with pytest.raises(ValueError):
        encoders.FileEncoder(public.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_conversation(spark, name):
    """Both file encoders over all conversations, as tables; a file that only the library reads goes through it."""
    library = tokenizers.Tokenizer.from_file(public.path(name))
    docs = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("concat(conv_id, ':', turn) as sample_id", "text")
    docs = docs.unionByName(spark.createDataFrame([("null", None), ("empty", "")], "sample_id string, text string"))
    want = {r.sample_id: library.encode(r.text or "", add_special_tokens=False) for r in docs.collect()}
    for by_library in (True, False) if name.startswith("byte") else (True,):
        got = {}
        for r in tokens.tokenize(docs, encoders.FileEncoder(public.path(name), by_library)).orderBy("pos").collect():
            got.setdefault(r.sample_id, []).append((r.token_id, r.token, (r.start, r.end)))
        assert {k: v for k, v in got.items()} == {k: list(zip(e.ids, e.tokens, e.offsets)) for k, e in want.items() if e.ids}


def test_any_object_is_an_encoder(spark):
    class Letters:
        identity = "letters"

        def tokens(self, documents):
            return documents.selectExpr("sample_id", "posexplode(split(text, '')) as (pos, token)").selectExpr("sample_id", "pos", "token", "ascii(token) as token_id", "cast(pos as long) as start", "cast(pos + 1 as long) as end")

    docs = spark.createDataFrame([("s", "abc")], "sample_id string, text string")
    assert [r.token_id for r in tokens.tokenize(docs, Letters()).orderBy("pos").collect()] == [97, 98, 99]
    assert encoders.PatternEncoder().identity != encoders.PatternEncoder(tokens.CHARACTERS).identity
