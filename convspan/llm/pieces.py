"""SentencePiece encoding and decoding with byte spans.

A model file is read without any tokenizer library: its vocabulary, its normaliser's flags and the compiled character map (a double
array trie and a block of replacement strings). Normalisation takes the longest prefix that the map knows at every step and records
for each character it writes where the source bytes of that character end; merging then joins neighbouring characters by the best
score, leftmost first, and every piece is projected on the source bytes through that record. Characters outside the vocabulary become
byte pieces. Decoding goes from ids alone.

Merging never joins a character with a word mark (U+2581) after it unless some piece holds both, nor any character that occurs in no
longer piece, so texts are cut there; the different strings of a batch of texts are then merged beside each other, as arrays.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.llm.common import small_arrow_batches

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
NEVER = float("inf")
NO_JOIN = 1 << 40
HASH_STEP, HASH_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Strings from this length on are merged one by one, with a heap.
LONG = 40
#: Characters of text that one output batch holds, longer texts alone.
BATCH_CHARS = 1_000_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix replacement through a compiled map; an empty map replaces nothing."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.strings = compiled[4 + size :] if compiled else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place and its replacement."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            unit = self.units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (end + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class PieceModel:
    def __init__(self, data: bytes):
        self.surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.user: list[str] = []
        self.unknown = 0
        flags, unknown_surface = {3: 1, 4: 1, 5: 1}, " ⁇ ".encode()
        charsmap = b""
        for field, value in message_fields(data):
            if field == 1:
                self._add(dict(message_fields(value)))
            elif field == 2:
                unknown_surface = dict(message_fields(value)).get(44, unknown_surface)
            elif field == 3:
                spec = dict(message_fields(value))
                flags |= {k: v for k, v in spec.items() if k in flags}
                charsmap = spec.get(2, b"")
        if self.surface:
            self.surface[self.unknown] = unknown_surface
        self.dummy_prefix, self.trim, self.escape = (bool(flags[k]) for k in (3, 4, 5))
        self.map = CharacterMap(charsmap)
        self.space = MARK if self.escape else " "
        #: Nothing but spaces changes in normalisation.
        self.plain = not (charsmap or self.user or self.trim)
        self.width = {MARK: 1} if self.escape else {}
        joined = [x for x in self.ids if len(x) > 1]
        #: Whether texts may be cut before word marks.
        self.cuts = not self.user and not any(re.search(f"[^{self.space}]{self.space}", x) for x in joined)
        self.joinable = np.zeros(0x110000, bool)
        self.joinable[[ord(c) for c in set("".join(joined))]] = True
        self.symbols: dict[str, tuple[list[int], list[int]]] = {}
        self.pairs = PairTable(self.ids, self.rank)
        self.widths = np.ones(len(self.surface), np.int64)
        for x, number in self.ids.items():
            self.widths[number] = sum(self.width.get(c, len(c.encode())) for c in x)
        self.surface_at = np.cumsum([0, *map(len, self.surface)])
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)

    def _add(self, fields: dict) -> None:
        piece, kind, number = fields[1].decode(), fields.get(3, NORMAL), len(self.surface)
        self.surface.append(piece.replace(MARK, " ").encode())
        if kind in (NORMAL, USER_DEFINED):
            self.ids[piece] = number
            self.rank[piece] = -struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0
        if kind == USER_DEFINED:
            self.user.append(piece)
            self.user.sort(key=len, reverse=True)
        elif kind == BYTE:
            self.byte_ids[int(piece[3:-1], 16)] = number
            self.surface[-1] = bytes([int(piece[3:-1], 16)])
        elif kind == UNKNOWN:
            self.unknown = number
        elif kind != NORMAL:
            self.surface[-1] = b""

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters the source byte at which its source ends."""
        data, out, ends, at = text.encode(), [], [], 0

        def step(at: int) -> tuple[str, int]:
            if self.user and (own := next((u for u in self.user if data.startswith(u.encode(), at)), None)):
                return own, len(own.encode())
            if found := self.map.longest(data, at):
                return found[1].decode(), found[0]
            size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            return data[at : at + size].decode(), size

        if self.trim:
            while at < len(data):
                got, size = step(at)
                if got.strip(" "):
                    break
                at += size
        if at == len(data):
            return "", []
        if self.dummy_prefix:
            out.append(self.space)
            ends.append(at)
        after_space = self.trim
        while at < len(data):
            got, size = step(at)
            at += size
            if after_space:
                got = got.lstrip(" ")
            if got:
                out.extend(got.replace(" ", self.space))
                ends.extend([at] * len(got))
                after_space = got.endswith(" ")
            after_space = after_space and self.trim
        while self.trim and out and out[-1] == self.space:
            out.pop()
            ends.pop()
        return "".join(out), ends

    def merge(self, text: str) -> list[str]:
        """The text's characters, joined pair by pair: best score first, then leftmost."""
        if self.user:
            parts = [x for x in re.split("(" + "|".join(map(re.escape, self.user)) + ")", text) if x]
            return list(chain.from_iterable([x] if x in self.user else self._join(list(x)) for x in parts))
        return self._join(list(text))

    def _join(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        if n < LONG:
            scores = [rank.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            while scores and (best := min(scores)) < NEVER:
                where = scores.index(best)
                symbols[where] += symbols.pop(where + 1)
                del scores[where]
                if where:
                    scores[where - 1] = rank.get(symbols[where - 1] + symbols[where], NEVER)
                if where < len(scores):
                    scores[where] = rank.get(symbols[where] + symbols[where + 1], NEVER)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(s, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (s := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], after[i] = both, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (s := rank.get(symbols[left] + symbols[right])) is not None:
                    heapq.heappush(heap, (s, left, symbols[left] + symbols[right]))
        return [x for x in symbols if x]

    def _symbol(self, symbol: str) -> tuple[list[int], list[int]]:
        if (number := self.ids.get(symbol)) is not None:
            found = [number], [sum(self.width.get(c, len(c.encode())) for c in symbol)]
            self.symbols[symbol] = found  # as many as the vocabulary has at most
            return found
        data = symbol.encode()
        return ([self.byte_ids[x] for x in data], [1] * len(data)) if self.byte_ids else ([self.unknown], [len(data)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's pieces begin in what follows (and the end); ids; source bytes at which the pieces end."""
        usual = [self.plain and self.cuts and bool(self.byte_ids) and MARK not in x for x in texts]
        counts, ids = self._encode_plain([x for x, y in zip(texts, usual, strict=True) if y])
        ends = np.cumsum(self.widths[ids])
        starts = np.cumsum(counts) - counts
        before = np.append(0, ends)[starts] + (self.dummy_prefix & (counts > 0))
        ends = ends - np.repeat(before, counts)
        if not all(usual):
            ours, own = iter(zip(np.split(ids, starts[1:]), np.split(ends, starts[1:]), strict=True)), []
            for x, y in zip(texts, usual, strict=True):
                own.append(next(ours) if y else self.encode(x))
            counts = np.array([len(x[0]) for x in own])
            ids, ends = (np.concatenate([np.asarray(x[k], np.int64) for x in own]) for k in (0, 1))
        return np.append(0, np.cumsum(counts)), ids, ends

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces and all ids of texts of which normalisation changes only the spaces."""
        prefix = " " if self.dummy_prefix else ""
        chars = np.frombuffer("".join(prefix + x if x else "" for x in texts).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter((len(x) and len(x) + len(prefix) for x in texts), np.int64, len(texts))
        if not len(chars):
            return lengths, np.zeros(0, np.int64)
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        space, alone = chars == 32, ~self.joinable[chars] & (chars != 32)
        begins = space | alone
        begins[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begins[first] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(chars)))
        chars[space] = ord(self.space)
        with np.errstate(over="ignore"):  # a polynomial modulo 2 ** 64, shifted to where the string begins
            powers = np.cumprod(np.full(len(chars), HASH_STEP, np.uint64))
            values = (chars.astype(np.uint64) + np.uint64(1)) * HASH_MIX
            sums = np.append(np.uint64(0), np.cumsum((values ^ (values >> np.uint64(29))) * powers))
            key = (sums[starts + sizes] - sums[starts]) * powers[len(chars) - 1 - starts] ^ sizes.astype(np.uint64) * HASH_MIX
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        if (sizes[where][which] != sizes).any() or (chars[_runs(starts[where][which], sizes)] != chars).any():
            where, which = np.arange(len(starts)), np.arange(len(starts))  # two strings have one key
        found_at, found, pool, filled = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64), [], 0
        symbols, size = self.pairs.char[chars], sizes[where]
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            if length >= LONG or length == 1:
                done = {}
                groups = []
                for row in rows.tolist():
                    part = "".join(map(chr, chars[starts[where[row]] : starts[where[row]] + length]))
                    done[row] = list(chain.from_iterable(self._symbol(x)[0] for x in self.merge(part)))
                groups += [(np.array([k]), np.array([v])) for k, v in done.items()]
            else:
                groups = ((rows[k], v) for k, v in self.pairs.join_all(symbols[starts[where[rows]][:, None] + np.arange(length)]))
            for own, ids in groups:
                found_at[own] = filled + np.arange(len(own)) * ids.shape[1]
                found[own] = ids.shape[1]
                pool.append(ids.ravel())
                filled += ids.size
        counts = found[which]
        ids = np.concatenate(pool)[_runs(found_at[which], counts)]
        per_text = np.zeros(len(texts), np.int64)
        per_text[lengths > 0] = np.add.reduceat(counts, np.searchsorted(starts, first))
        return per_text, ids

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """decode() of each run of ids."""
        sizes = (self.surface_at[1:] - self.surface_at[:-1])[ids]
        data = self.surfaces[_runs(self.surface_at[ids], sizes)]
        at = np.append(0, np.cumsum(sizes))[offsets]
        some = offsets[1:] > offsets[:-1]
        if self.dummy_prefix and len(data):
            heads = at[:-1][some]
            heads = heads[(data[heads] == 32) & ~np.isin(ids[offsets[:-1][some]], list(self.byte_ids.values()))]
            keep = np.ones(len(data), bool)
            keep[heads] = False
            at = at - np.searchsorted(heads, at, "left")
            data = data[keep]
        binary = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        try:
            return binary.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in binary], pa.string())

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and the source byte at which each piece ends; it begins where the one before ends."""
        norm, char_ends = self.normalize(text)
        ids, ends, at = [], [], 0
        for symbol in self.merge(norm):
            own = self._symbol(symbol)[0]
            first = char_ends[at - 1] if at else 0
            at += len(symbol)
            last = char_ends[at - 1]
            ids.extend(own)
            ends.extend(min(first + k, last) for k in range(1, len(own)))
            ends.append(last)
        return ids, np.array(ends, np.int32)

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and data.startswith(b" ") and ids[0] not in self.byte_ids.values():
            data = data[1:]
        return data.decode("utf-8", "replace")


class PairTable:
    """The vocabulary's joins as arrays: (left id, right id) to the joined id and its order, by open addressing."""

    BITS = 21

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        order = {score: k for k, score in enumerate(sorted(set(rank.values())))}
        pairs = [(ids[x[:i]] << 32 | ids[x[i:]], ids[x], order[rank[x]]) for x in ids for i in range(1, len(x)) if x[:i] in ids and x[i:] in ids]
        keys, joined, ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.joined, self.ranks = np.append(joined, -1), np.append(ranks, NO_JOIN)
        self.keys, self.slots = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.slots[at[first]] = keys[left[first]], left[first]
            rest = np.setdiff1d(np.arange(len(left)), first)
            left, at = left[rest], at[rest] + 1 & (1 << self.BITS) - 1
        self.char = np.full(0x110000, -1, np.int64)
        for x, number in ids.items():
            if len(x) == 1:
                self.char[ord(x)] = number

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in joined and ranks; the last one, which joins nothing, for pairs that are in no piece."""
        key = (left << 32 | right).ravel()
        at = self._slot(key)
        found, seen = self.slots[at], self.keys[at]
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.BITS) - 1
            seen = self.keys[at[open_]]
            found[open_] = self.slots[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen != -1)]
        return found.reshape(left.shape)

    def join_all(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For strings of one length, a row of ids of their characters each: (their places, a row of ids), in groups by the number of pieces.

        All take one join a step, as each does alone: the best score, then the leftmost.
        """
        rows = np.arange(len(symbols))
        ranks = self.ranks[self.find(symbols[:, :-1], symbols[:, 1:])]
        while len(rows):
            if symbols.shape[1] == 1:
                yield rows, symbols
                return
            best = ranks.argmin(1)
            more = ranks[np.arange(len(rows)), best] < NO_JOIN
            if not more.all():
                yield rows[~more], symbols[~more]
                rows, symbols, ranks, best = rows[more], symbols[more], ranks[more], best[more]
            each, columns = np.arange(len(rows)), np.arange(symbols.shape[1] - 1)
            new = self.joined[self.find(symbols[each, best], symbols[each, best + 1])]
            symbols = np.take_along_axis(symbols, columns + (columns > best[:, None]), 1)
            symbols[each, best] = new
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
            for at in (best - 1, best):
                own = np.flatnonzero((at >= 0) & (at < len(columns)))
                ranks[own, at[own]] = self.ranks[self.find(symbols[own, at[own]], symbols[own, at[own] + 1])]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_models: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """The worker's model; tasks of one worker share it."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(data)
    return _models[key]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with the columns ids (array<int>), ends (array<int>) and, if asked for, decoded (string) of each row's whole text.

    Piece i covers the UTF-8 bytes from ends[i - 1] (0 for the first) to ends[i] of the text; a word mark that only the normaliser
    added covers none. A null or empty text has no pieces and decodes to the empty string. Repeated rows are encoded alike, an empty
    table gives an empty one, and columns of docs that have one of the new names are replaced. The model file (a few hundred KB to a
    few MB) is read by the driver and travels with the tasks.
    """
    small_arrow_batches(docs)
    model_bytes = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    new = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("ends", T.ArrayType(T.IntegerType(), False))]
    new += [T.StructField("decoded", T.StringType())] * decoded
    names = [f.name for f in new]
    docs = docs.drop(*[c for c in docs.columns if c in names and c != text])
    source = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_bytes.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            first = chars = 0
            for i, length in enumerate(pc.utf8_length(texts).to_pylist()):
                chars += length
                if chars < BATCH_CHARS and i < len(texts) - 1:
                    continue
                offsets, ids, ends = model.encode_all(texts.slice(first, i + 1 - first).to_pylist())
                at = pa.array(offsets.astype(np.int32))
                columns = [batch.column(batch.schema.get_field_index(c)).slice(first, i + 1 - first) for c in keep]
                columns += [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, ends)]
                columns += [model.decode_all(offsets, ids)] * decoded
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
                first, chars = i + 1, 0

    schema = T.StructType([f for f in docs.schema if f.name in keep] + new)
    return source.select(*[F.col(f"`{c}`") for c in keep], "__text").mapInArrow(run, schema)
