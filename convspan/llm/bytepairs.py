"""Byte-level BPE encoding and decoding by reduction of a binary tree.

Encodings form a monoid under concatenation of what they encode: the two halves of a text are encoded on their own, recursively, and two
neighbours are joined by encoding a window over their boundary anew. The window grows until what lies outside it provably stays.

* Merging: bytes of one piece join by the least rank, leftmost first. Tokens t1 ... tn are the encoding of their bytes if each is that of
  its own and each two neighbours that of theirs: the first merge over a boundary would be the first over it in the encoding of these two
  alone, as all before it fall within tokens and there is no other order for them. So a window is done as soon as its first token and
  the one before it, and its last and the one after it, are such neighbours. Halves of a piece below LEAF_BYTES are merged directly.
* Pieces: a text is cut by the pattern of the tokenizer, each match is merged separately. A match is decided by its own characters and the
  one after them, one that begins with an apostrophe by three, so all but the last matches of a left half that begin LOOK or more characters
  before its end stay. From the first of the others the boundary is cut anew, and where a new match begins at a match of the right half, all
  after it stays, as matching never looks back.

Decoding concatenates the tokens' bytes up the same tree. Texts are rows, so a lost task is run again on its own rows.
"""

from __future__ import annotations

import heapq
from base64 import b64decode
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.llm.common import small_arrow_batches

#: Bytes of a piece, characters of a text and ids up to which a leaf of the tree is done at once.
LEAF_BYTES, LEAF_CHARS, LEAF_IDS = 32, 16_384, 65_536
#: Characters that decide a match, from its beginning or else from its last one.
LOOK = 3
#: Bytes from which merges go by a heap.
HEAP_BYTES = 64
#: Characters of the pieces that a worker remembers, and how many of them before it forgets all.
KEPT_CHARS, KEPT_PIECES = 64, 300_000
#: Characters of text that one output batch holds, longer texts alone.
BATCH_CHARS = 1_000_000
NEVER = 1 << 60


class Merges(dict):
    """Ids of each piece, as a tuple; the pieces seen last are remembered. Ranks are those of a file of base64 bytes and numbers."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        super().__init__()
        self.ranks = {b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
        self.tokens = {number: token for token, number in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.agreed: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merges by the least rank, leftmost first, from single bytes."""
        if len(data) > HEAP_BYTES:
            return self._merge_long(data)
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < NEVER:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        rank, n = self.ranks.get, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here; where the one before it begins
        heap = [(r, i) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            least, at = heapq.heappop(heap)
            if gone[at] or ends[at] == n or rank(data[at : (end := ends[ends[at]])]) != least:
                continue
            gone[ends[at]] = 1
            ends[at] = end
            if end < n:
                before[end] = at
                if (r := rank(data[at : ends[end]])) is not None:
                    heapq.heappush(heap, (r, at))
            if at and (r := rank(data[before[at] : end])) is not None:
                heapq.heappush(heap, (r, before[at]))
        found, at = [], 0
        while at < n:
            found.append(self.ranks[data[at : ends[at]]])
            at = ends[at]
        return found

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        known = self.agreed.get((left, right))
        if known is None:
            if len(self.agreed) >= KEPT_PIECES:
                self.agreed.clear()
            known = self.agreed[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of what two encodings stand for."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.tokens[t] for t in chain(left[-a:], right[:b])))
            left_stays = a == len(left) or self.stays(left[-a - 1], window[0])
            right_stays = b == len(right) or self.stays(window[-1], right[b])
            if left_stays and right_stays:
                return left[:-a] + window + right[b:]
            a, b = a if left_stays else 2 * a, b if right_stays else 2 * b

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.reduce(data[:middle]), self.reduce(data[middle:]))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        found = tuple(self.reduce(data)) if whole is None else (whole,)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found

    def text(self, pieces: list[tuple[int, ...]]) -> str:
        return b"".join(self.tokens[t] for t in chain.from_iterable(pieces)).decode()

    def join_pieces(self, left: list[tuple], right: list[tuple]) -> list[tuple]:
        """The pieces of a text from those of its two halves."""
        a, tail = 1, self.text(left[-1:])
        while a < len(left) and len(more := self.text(left[-a - 1 : -a]) + tail) < LOOK:
            a, tail = a + 1, more
        b = 4
        while True:
            heads = [self.text([piece]) for piece in right[:b]]
            window = tail + "".join(heads)
            new = self.find(window)
            starts = list(accumulate(map(len, new), initial=0))[:-1]
            if b < len(right):  # the last matches may depend on what follows the window
                while starts and (len(starts) == len(new) or starts[-1] > len(window) - LOOK):
                    starts.pop()
            old = {at: k for k, at in enumerate(accumulate(map(len, heads), initial=len(tail)))}
            met = next((k for k, at in enumerate(starts) if at in old), None)
            if met is not None or b >= len(right):
                kept = new if met is None else new[:met]
                return left[:-a] + list(map(self.__getitem__, kept)) + (right[old[starts[met]] :] if met is not None else [])
            b *= 2

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each piece of the text."""
        if len(text) <= LEAF_CHARS:
            return list(map(self.__getitem__, self.find(text)))
        middle = len(text) // 2
        return self.join_pieces(self.pieces(text[:middle]), self.pieces(text[middle:]))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.pieces(text)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_merges: dict[int, Merges] = {}


def _of(ranks: bytes, pattern: str) -> Merges:
    """The worker's merges; its tasks share them."""
    key = hash((ranks, pattern))
    if key not in _merges:
        _merges.clear()
        _merges[key] = Merges(ranks, pattern)
    return _merges[key]


def _list(values: list, kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, kind))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """docs with the named columns of each row's whole text: ids (array<int>), packed (binary: ids as little-endian unsigned 32-bit
    integers), decoded (binary: the bytes that the ids decode to).

    A null or empty text has no ids and decodes to nothing. Repeated rows are encoded alike, an empty table gives an empty one, and
    columns of docs that have one of the new names are replaced. The ranks (a few MB) are read by the driver and travel with the tasks; they
    hold every single byte. The pattern is that of the ranks; its matches cover the text and are decided by LOOK characters (see above).
    """
    small_arrow_batches(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    kinds = {"ids": T.ArrayType(T.IntegerType(), False), "packed": T.BinaryType(), "decoded": T.BinaryType()}
    keep = [c for c in docs.columns if c not in columns]
    source = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _of(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            first = chars = 0
            for i, length in enumerate(pc.utf8_length(texts).to_pylist()):
                chars += length
                if chars < BATCH_CHARS and i < len(texts) - 1:
                    continue
                found = [merges.encode(x) for x in texts.slice(first, i + 1 - first).to_pylist()]
                new = {
                    "ids": lambda: _list(found, pa.int32()),
                    "packed": lambda: pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                    "decoded": lambda: pa.array([merges.decode(x) for x in found], pa.binary()),
                }
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, i + 1 - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(new[c]() for c in columns)], [*keep, *columns])
                first, chars = i + 1, 0

    schema = T.StructType([f for f in docs.schema if f.name in keep] + [T.StructField(c, kinds[c]) for c in columns])
    return source.select(*[F.col(f"`{c}`") for c in keep], "__text").mapInArrow(run, schema)
