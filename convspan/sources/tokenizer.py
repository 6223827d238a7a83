"""What identifies a tokenizer file: its bytes, its configuration's and its padding token. The file is small and read on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tokens that pad if the configuration names none, in this order.
PADS = ("<|pad|>", "<|endoftext|>")


@dataclass(frozen=True)
class Snapshot:
    identity: str
    pad_token_id: int
    vocabulary: dict[str, int]

    def table(self, spark: SparkSession) -> DataFrame:
        """token, token_id: a small table to join tokens with."""
        return spark.createDataFrame(list(self.vocabulary.items()), "token string, token_id int")


def _vocabulary(raw: dict) -> dict[str, int]:
    vocab = raw.get("model", {}).get("vocab", {})
    found = dict(vocab) if isinstance(vocab, dict) else {entry[0]: k for k, entry in enumerate(vocab)}
    return found | {t["content"]: t["id"] for t in raw.get("added_tokens", ())}


def snapshot(path: str, pad_token_id: int | None = None) -> Snapshot:
    """Of a tokenizer.json, or of a folder that has one, with the tokenizer_config.json beside it if there is one.

    The padding token is the one given, else the configuration's, else the first of PADS that the vocabulary has; one outside the
    vocabulary, or none, is an error.
    """
    file = Path(path) / "tokenizer.json" if Path(path).is_dir() else Path(path)
    beside = file.with_name("tokenizer_config.json")
    config = beside.read_bytes() if beside.is_file() else b""
    vocabulary = _vocabulary(json.loads(file.read_bytes()))
    named = json.loads(config) if config else {}
    if not isinstance(named, dict):
        raise ValueError("the tokenizer's configuration must be an object")
    pad = named.get("pad_token")
    pad = pad.get("content") if isinstance(pad, dict) else pad
    if pad is not None and not isinstance(pad, str):
        raise ValueError("the padding token must be a string or a token")
    candidates = [pad_token_id, vocabulary.get(pad), *map(vocabulary.get, PADS)]
    chosen = next((c for c in candidates if c is not None), None)
    if chosen is None or not 0 <= chosen < len(vocabulary):
        raise ValueError("the tokenizer has no valid padding token")
    parts = (b"convspan-tokenizer", file.read_bytes(), config, str(chosen).encode())
    return Snapshot(hashlib.sha256(b"\0".join(hashlib.sha256(p).digest() for p in parts)).hexdigest(), chosen, vocabulary)
