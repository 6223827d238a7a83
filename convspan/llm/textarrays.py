"""Texts as arrays: words, windows and hashes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, longer texts alone.
CHUNK_BYTES = 1_000_000
STEP = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20_240_501)
#: A random number for each byte value.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word up to which it is hashed 8 at a time.
MIXED_BYTES = 64
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """STEP ** i modulo 2 ** 64 for i < n, or the inverses."""
    name = "inverse" if inverse else "forward"
    if len(_powers.get(name, ())) < n:
        step = pow(STEP, -1, 1 << 64) if inverse else STEP
        row = np.full(max(n, CHUNK_BYTES + 1024), step, np.uint64)
        row[0] = 1
        _powers[name] = np.multiply.accumulate(row)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Hashes of any slices of a sequence of 64-bit numbers, from running sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=self.sums[1:])
        self.back = powers(len(values) + 1, inverse=True)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(STEP))

    def windows(self, size: int, mixed: bool = True) -> np.ndarray:
        """Of every slice of this size; empty if there is none. Only the high bits of unmixed ones are good."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = self.sums[size:] - self.sums[:n]
        raw *= self.back[:n]
        return mix(raw) if mixed else raw


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins (and the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_BYTES together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = utf8(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within each text: begins, ends, and for each text the number of its first run (and the end)."""
    edge = np.zeros(len(inside) + 1, np.int8)
    edge[:-1] = inside
    change = np.diff(edge, prepend=0)
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(inside))])
    cut = inner[inside[inner - 1] & inside[inner]] if len(inner) else inner  # a run must not cross from one text to the next
    if len(cut):
        begins, ends = np.sort(np.append(begins, cut)), np.sort(np.append(ends, cut))
    return begins, ends, np.searchsorted(begins, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not white space."""
    return spans(~IS_SPACE[data], offsets)


def digests(contents: list[bytes]) -> np.ndarray:
    """64 bits of a cryptographic hash of each content."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in contents]), np.uint64)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the slice between its begin and end: mixed after every 8 bytes, of words over MIXED_BYTES cryptographic.

    Words of one length up to 8 bytes never share one.
    """
    sizes = ends - begins
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    out = mix(sizes.astype(np.uint64))
    at = np.arange(len(sizes))
    for done in range(0, MIXED_BYTES, 8):
        at = at[sizes[at] > done] if done else at
        if not len(at):
            break
        left = np.minimum(sizes[at] - done, 8).astype(np.uint64)
        lane = eights[begins[at] + done] & (ALL_BITS >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mix(out[at] * np.uint64(STEP) ^ lane)
    long = np.flatnonzero(sizes > MIXED_BYTES)
    if len(long):
        out[long] = digests([data[x:y].tobytes() for x, y in zip(begins[long].tolist(), ends[long].tolist(), strict=True)])
    return out


def windows(values: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash for every `size` consecutive values, from hashes of halves, mixed at each step; no sum that unlike windows can share."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, out, done = mix(values ^ np.uint64(salt)), 1, None, 0
    while True:
        if size & width:
            here = part[done : done + n]
            out, done = here if out is None else mix(out * np.uint64(STEP) + here), done + width
        if done == size:
            return out
        part = mix(part[: len(part) - width] * np.uint64(STEP) + part[width:])
        width *= 2


def groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers: one place of each different pair, which of these each pair is, and how often it occurs."""
    order = np.argsort(first, kind="stable")
    same = first[order][1:] == first[order][:-1]
    if (same & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    new = np.append(True, ~same)[: len(order)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], which, np.diff(np.append(starts, len(order)))


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(BYTE_VALUES[data])


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
