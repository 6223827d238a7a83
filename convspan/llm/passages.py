"""Removal of repeated passages of words, by difference-cover anchors.

Positions of words are covered where they are, modulo 13, in the difference cover {0, 1, 3, 9}: whatever the positions of two equal
windows of 20 words, some shift below 13 takes both to covered positions. So it is enough to hash the 8 words from each covered
position on: two equal windows share one such anchor at the same place in them. Blocks of documents announce their anchors; those
that occur once in the corpus are done with. Where an anchor is shared, it is extended by the words on its sides to all windows that
hold it; these are compared, and all but a window's first occurrence (least doc_id, then earliest start) mark their words for removal.

Words are told apart by 64-bit hashes (of short words never alike, of long ones cryptographic), and windows by two hashes of their
words, made apart from each other by mixing at each step (128 bits), so no repetitive text makes unlike windows agree, and chance does
so once in 10 ** 12 corpora of 10 ** 13 windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convspan.llm import blocks
from convspan.llm.textarrays import chunks, groups, runs, utf8, windows, word_hashes, words

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - (PERIOD - 1)


@dataclass
class Words:
    """The words of a block's rows: hashes, and for each row the number of its first one (and the end)."""

    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        hashes, counts = [], []
        for a, b in chunks(texts):
            data, offsets = utf8(texts.slice(a, b - a))
            begins, ends, own = words(data, offsets)
            hashes.append(word_hashes(data, begins, ends))
            counts.append(np.diff(own))
        return cls(np.concatenate([np.zeros(0, np.uint64), *hashes]), np.cumsum(np.concatenate([[0], *counts])).astype(np.int64))

    @property
    def place(self) -> np.ndarray:
        """Each word's number within its row."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))

    def starts(self, size: int) -> np.ndarray:
        """Of the windows of this size that lie within a row."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        return np.flatnonzero(room >= size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        starts = self.starts(ANCHOR)
        starts = starts[np.isin(self.place[starts] % PERIOD, COVER)]
        return starts, windows(self.hashes, ANCHOR)[starts]

    def extended(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of the windows with these starts."""
        return windows(self.hashes, WINDOW)[starts], windows(self.hashes, WINDOW, salt=1)[starts]


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    _, found = Words.of(_column(table, "text")).anchors()
    found, held = np.unique(found, return_counts=True)
    return found, held > 1


def _windows(block: int, rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Of a block's windows with a shared anchor: their different hashes, the least doc of each, and whether it occurs again here."""
    if not len(rows) or not len(answers):
        return blocks.messages(block, [])
    text = Words.of(_column(rows, "text"))
    starts, anchors = text.anchors()
    different, which = np.unique(anchors, return_inverse=True)
    shared = blocks.marks(answers, different, buckets)[0][which]
    marked = np.zeros(len(text.hashes) + PERIOD + 1, np.int32)
    marked[1 + starts[shared]] = 1
    total = np.cumsum(marked)
    starts = text.starts(WINDOW)
    starts = starts[total[starts + PERIOD] > total[starts]]  # an anchor within the first PERIOD words of the window
    doc = np.repeat(rows.column("doc").to_numpy(), np.diff(text.first))[starts]
    one, two = text.extended(starts)
    at, which, held = groups(one, two)
    least, place = _least(which, len(at), doc, text.place[starts])
    one, two = one[at], two[at]
    return blocks.messages(block, [(b, [one[k].tobytes(), least[k].tobytes() + place[k].astype(np.int32).tobytes(), np.packbits(held[k] > 1).tobytes(), two[k].tobytes()]) for b, k in blocks.by_bucket(one, buckets)])


def _least(which: np.ndarray, n: int, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least doc of each of n groups, and the least place that the group has in it."""
    least, first = np.full(n, blocks.LAST), np.full(n, (1 << 31) - 1, np.int32)
    np.minimum.at(least, which, doc)
    own = np.flatnonzero(doc == least[which])
    np.minimum.at(first, which[own], place[own].astype(np.int32))
    return least, first


def _firsts(key: tuple, table: pa.Table) -> pa.Table:
    """Answers each block its windows that occur elsewhere too, or again in the block, and whether it holds the first one."""
    hashes, firsts = blocks.received(table, "a", np.uint64), blocks.received(table, "b", np.int32)
    sizes = list(map(len, hashes))
    again = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(blocks.received(table, "c", np.uint8), sizes, strict=True)]).astype(bool)
    others = blocks.received(table, "d", np.uint64)
    doc, place = np.concatenate([x[: 2 * n].view(np.int64) for x, n in zip(firsts, sizes, strict=True)]), np.concatenate([x[2 * n :] for x, n in zip(firsts, sizes, strict=True)])
    _, which, held = groups(np.concatenate(hashes), np.concatenate(others))
    least, least_place = _least(which, len(held), doc, place)
    tell, first = (held > 1)[which] | again, (doc == least[which]) & (place == least_place[which])
    cuts = np.cumsum(sizes)[:-1]
    out = [(h[t].tobytes(), np.packbits(f[t]).tobytes(), o[t].tobytes()) for h, o, t, f in zip(hashes, others, np.split(tell, cuts), np.split(first, cuts), strict=True)]
    columns = [table.column("block").combine_chunks(), pa.array([key[0].as_py()] * len(out), pa.int64())]
    columns += [pa.array([x[k] for x in out], pa.binary()) for k in range(3)] + [pa.nulls(len(out), pa.binary())]
    return pa.table(columns, ["block", "bucket", *blocks.PARTS])


def _remove(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Each row's words without those of windows that occurred before, joined by one space."""
    texts = _column(rows, "text")
    text = Words.of(texts)
    gone = np.zeros(len(text.hashes) + 1, np.int32)
    told = np.concatenate([np.zeros(0, np.uint64), *blocks.received(answers, "a", np.uint64)])
    if len(told):
        own = np.concatenate([np.unpackbits(x, count=len(h)) for x, h in zip(blocks.received(answers, "b", np.uint8), blocks.received(answers, "a", np.uint64), strict=True)]).astype(bool)
        other = np.concatenate(blocks.received(answers, "c", np.uint64))
        order = np.argsort(told, kind="stable")
        told, other, own = told[order], other[order], own[order]
        starts = text.starts(WINDOW)
        one, two = text.extended(starts)
        at = np.searchsorted(told, one)
        last = len(told) - 1
        while (on := (at <= last) & (told[np.minimum(at, last)] == one) & (other[np.minimum(at, last)] != two)).any():  # alike by one hash alone
            at = at + on
        at = np.minimum(at, last)
        hit = (told[at] == one) & (other[at] == two)
        starts, at = starts[hit], at[hit]
        doc = np.repeat(rows.column("doc").to_numpy(), np.diff(text.first))[starts]
        place = text.place[starts]
        order = np.lexsort((place, doc, at))
        new = np.append(True, np.diff(at[order]) > 0) if len(at) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        head = order[new][group] if len(at) else order
        first = np.zeros(len(at), bool)
        first[order] = (doc[order] == doc[head]) & (place[order] == place[head])
        again = starts[~(first & own[at])]
        np.add.at(gone, again, 1)
        np.add.at(gone, again + WINDOW, -1)
    keep = np.cumsum(gone[:-1]) == 0
    kept, removed = [], np.zeros(len(rows), np.int64)
    if len(keep):
        before = np.append(0, np.cumsum(~keep))
        removed = before[text.first[1:]] - before[text.first[:-1]]
    for a, b in chunks(texts):
        data, offsets = utf8(texts.slice(a, b - a))
        begins, ends, own = words(data, offsets)
        use = keep[text.first[a] : text.first[b]]
        sizes = (ends - begins)[use] + 1
        out = np.append(data, np.uint8(32))[runs(begins[use], sizes)]
        out[np.cumsum(sizes) - 1] = 32
        counted = np.append(0, np.cumsum(use))[own]
        at = np.append(0, np.cumsum(sizes))[counted]
        kept += [out[x : max(x, y - 1)].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = [rows.column("doc_id"), pa.array(np.diff(text.first)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row of docs(doc_id, text).

    kept is the row's words, joined by one space, without those covered by a window of 20 words that also starts earlier: in a row of
    smaller doc_id, or in a row of the same doc_id at an earlier word. Windows are judged on the input. A null or empty text has no
    words; rows with a null doc_id come after all others, in the order of a hash of their texts; repeated rows have the same result;
    other columns are ignored; an empty table gives an empty one.
    """
    dealt, buckets = blocks.deal(docs)
    anchors = blocks.shared_hashes(dealt, buckets, _anchors)
    windows = blocks.answered(dealt, anchors, lambda block, rows, told: _windows(block, rows, told, buckets), blocks.MESSAGE)
    firsts = windows.groupBy("bucket").applyInArrow(_firsts, blocks.MESSAGE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.answered(dealt, firsts, _remove, f"doc_id {kind}, n_words long, n_removed long, kept string")
