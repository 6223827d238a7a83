"""Encoders: what turns rendered texts into tokens with ids and character ranges.

An encoder has an identity and a method tokens(documents) that gives (sample_id, pos, token, token_id, start, end) of documents(sample_id,
text). Any object with these two is one. Three kinds are here: a pattern in column functions, byte-level BPE read from a tokenizer.json, and, for
whatever that does not read, the tokenizers library. The last two run in tasks on Arrow batches; the file travels by broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A lossless pattern: runs of words and of white space.
WORDS = r"[^ \t\n\r]+|[ \t\n\r]+"
#: Fixed value: the pattern of a byte-level pre-tokenizer that names none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of one Arrow batch, characters of the texts that are encoded together, and pieces that a worker remembers.
BATCH_ROWS, BATCH_CHARS, KEPT_PIECES = 500, 500_000, 200_000
#: Symbols of a piece from which merges go by a heap.
HEAP_SYMBOLS = 48
NEVER = (1 << 60, -1)


class Encoder(Protocol):
    identity: str

    def tokens(self, documents: DataFrame) -> DataFrame:
        """sample_id, pos, token, token_id, start, end of documents(sample_id, text); ranges in characters, pos from 0."""


class PatternEncoder:
    """The matches of a pattern that covers the text; an id is the number in the first seven hexadecimal digits of the token's hash."""

    def __init__(self, pattern: str = WORDS):
        self.pattern = pattern
        self.identity = hashlib.sha256(b"convspan-pattern\0" + pattern.encode()).hexdigest()

    def tokens(self, documents: DataFrame) -> DataFrame:
        found = documents.select("sample_id", F.posexplode(F.regexp_extract_all("text", F.lit(self.pattern), F.lit(0))).alias("pos", "token"))
        end = F.sum(F.length("token")).over(Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        number = F.conv(F.substring(F.sha2("token", 256), 1, 7), 16, 10).cast("int")
        return found.withColumn("end", end).select("sample_id", "pos", "token", number.alias("token_id"), (F.col("end") - F.length("token")).alias("start"), "end")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from code point 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class BytePairs(dict):
    """The merges of a tokenizer.json: for each piece its ids and the character ranges of its tokens; the pieces seen last are remembered.

    Read are models of type BPE over bytes without unknown tokens, prefixes or suffixes, pre-tokenizers ByteLevel, Split into isolated
    matches and sequences of these, and added tokens; anything else is an error, so no file is read otherwise than it says.
    """

    def __init__(self, raw: dict):
        import regex

        super().__init__()
        model = raw["model"]
        unread = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout") if model.get(k)]
        if model.get("type") != "BPE" or unread or raw.get("normalizer") or (raw.get("post_processor") or {}).get("trim_offsets"):
            raise ValueError(f"only byte-level BPE without {unread or 'normalizer'} is read")
        vocabulary = model["vocab"]
        self.whole = bool(model.get("ignore_merges"))
        self.names = {number: token for token, number in vocabulary.items()}
        self.bytes = [vocabulary[c] for c in byte_alphabet()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        size = {c: b for b, c in enumerate(byte_alphabet())}
        self.sizes = {number: len(token) for token, number in vocabulary.items() if all(c in size for c in token)}
        self.by_bytes = {bytes(size[c] for c in token): number for token, number in vocabulary.items() if all(c in size for c in token)}
        self.finders = [regex.compile(p) for p in self._patterns(raw.get("pre_tokenizer"))]
        added = sorted(raw.get("added_tokens") or (), key=lambda t: -len(t["content"]))
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions on what stands beside them are not read")
        self.added = {t["content"]: t["id"] for t in added}
        self.names |= {t["id"]: t["content"] for t in added}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None

    def _patterns(self, given: dict | None) -> Iterator[str]:
        """Expressions whose matches are kept apart, one after another on the pieces so far."""
        if given is None:
            raise ValueError("a byte-level model needs its pre-tokenizer")
        kind = given["type"]
        if kind == "Sequence":
            for one in given["pretokenizers"]:
                yield from self._patterns(one)
        elif kind == "ByteLevel" and not given.get("add_prefix_space"):
            if given.get("use_regex", True):
                yield BYTE_LEVEL
        elif kind == "Split" and given["behavior"] == "Isolated" and not given.get("invert") and "Regex" in given["pattern"]:
            yield given["pattern"]["Regex"]
        else:
            raise ValueError(f"the pre-tokenizer {kind} is not read with these options")

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges by the least rank, leftmost first."""
        get = self.pairs.get
        if len(symbols) > HEAP_SYMBOLS:
            return self._merged_long(symbols)
        found = [get(pair, NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
        while found and (least := min(found)) != NEVER:
            at = found.index(least)
            symbols[at : at + 2] = [least[1]]
            del found[at]
            if at:
                found[at - 1] = get((symbols[at - 1], symbols[at]), NEVER)
            if at < len(found):
                found[at] = get((symbols[at], symbols[at + 1]), NEVER)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        get, n = self.pairs.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], at, pair) for at, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (found := get(pair))]
        heapq.heapify(heap)
        while heap:
            _, at, pair = heapq.heappop(heap)
            right = after[at] if symbols[at] is not None else n
            if right == n or (symbols[at], symbols[right]) != pair:
                continue
            symbols[at], symbols[right] = self.pairs[pair][1], None
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b < n and (found := get((symbols[a], symbols[b]))):
                    heapq.heappush(heap, (found[0], a, (symbols[a], symbols[b])))
        return [s for s in symbols if s is not None]

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
        data = piece.encode()
        whole = self.by_bytes.get(data) if self.whole else None
        ids = [whole] if whole is not None else self.merged([self.bytes[b] for b in data])
        ends = list(accumulate(self.sizes[t] for t in ids))
        if len(data) == len(piece):
            starts = [0, *ends[:-1]]
        else:  # from bytes back to characters: a token covers every character of which it has a byte
            begins = list(accumulate((len(c.encode()) for c in piece), initial=0))[:-1]
            starts = [bisect_right(begins, e) - 1 for e in (0, *ends[:-1])]
            ends = [bisect_right(begins, e - 1) for e in ends]
        found = tuple(ids), tuple(starts), tuple(ends)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found

    def _pieces(self, text: str) -> Iterator[str]:
        parts = [text]
        for finder in self.finders:
            split = []
            for part in parts:
                at = 0
                for match in finder.finditer(part):
                    if match.start() > at:
                        split.append(part[at : match.start()])
                    if match.end() > match.start():
                        split.append(match[0])
                    at = match.end()
                if at < len(part):
                    split.append(part[at:])
            parts = split
        yield from parts

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, starts and ends of the tokens of a text."""
        ids, starts, ends, at = [], [], [], 0

        def plain(part: str, at: int) -> None:
            for piece in self._pieces(part):
                own, left, right = self[piece]
                ids.extend(own)
                starts.extend([at + x for x in left])
                ends.extend([at + x for x in right])
                at += len(piece)

        for match in self.special.finditer(text) if self.special else ():
            plain(text[at : match.start()], at)
            ids.append(self.added[match[0]])
            starts.append(match.start())
            ends.append(match.end())
            at = match.end()
        plain(text[at:], at)
        return ids, starts, ends


class _Library:
    """The same through the tokenizers library."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.names = {number: token for token, number in self.tokenizer.get_vocab(True).items()}

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, [a for a, _ in found.offsets], [b for _, b in found.offsets]


_loaded: dict[tuple[bool, int], object] = {}


def _load(raw: bytes, library: bool):
    """The worker's encoder, shared by its tasks."""
    key = library, hash(raw)
    if key not in _loaded:
        _loaded[key] = _Library(raw) if library else BytePairs(json.loads(raw))
    return _loaded[key]


class FileEncoder:
    """A tokenizer.json, or a folder with one: byte-level BPE by this engine, or anything through the library where it is installed."""

    def __init__(self, path: str, library: bool = False):
        file = Path(path) / "tokenizer.json" if Path(path).is_dir() else Path(path)
        self.raw, self.library = file.read_bytes(), library
        _load(self.raw, library)  # a file that is not read fails here, not in tasks
        self.identity = hashlib.sha256(b"convspan-encoder\0" + self.raw).hexdigest()

    def encoded(self, documents: DataFrame) -> DataFrame:
        """sample_id, ids, starts, ends, names: arrays of each text's tokens; a null text is empty."""
        spark = documents.sparkSession
        raw, library = spark.sparkContext.broadcast(self.raw), self.library
        kind = documents.schema["sample_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _load(raw.value, library)
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                first = chars = 0
                for i, text in enumerate(texts):
                    chars += len(text)
                    if chars < BATCH_CHARS and i + 1 - first < BATCH_ROWS and i + 1 < len(texts):
                        continue
                    found = [encoder.encode(x) for x in texts[first : i + 1]]
                    at = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32))
                    columns = [pa.ListArray.from_arrays(at, pa.array([v for x in found for v in x[k]], pa.int32())) for k in range(3)]
                    names = pa.ListArray.from_arrays(at, pa.array([encoder.names[v] for x in found for v in x[0]], pa.string()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), *columns, names], ["sample_id", "ids", "starts", "ends", "names"])
                    first, chars = i + 1, 0

        rows = documents.select("sample_id", F.coalesce("text", F.lit("")).alias("text"))
        return rows.mapInArrow(run, f"sample_id {kind}, ids array<int>, starts array<int>, ends array<int>, names array<string>")

    def tokens(self, documents: DataFrame) -> DataFrame:
        zipped = F.arrays_zip("ids", "starts", "ends", "names")
        rows = self.encoded(documents).select("sample_id", F.posexplode(zipped).alias("pos", "t"))
        return rows.select("sample_id", "pos", F.col("t.names").alias("token"), F.col("t.ids").alias("token_id"), F.col("t.starts").cast("long").alias("start"), F.col("t.ends").cast("long").alias("end"))


def as_encoder(given: Encoder | str) -> Encoder:
    """An encoder, or the one of a pattern."""
    return PatternEncoder(given) if isinstance(given, str) else given
