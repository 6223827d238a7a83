"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period p, at least twice as long as p, that no neighbouring word extends. The words of a
batch of texts, a mark of its own between any two texts, become the lowest level of a run-length grammar: block compression names every
maximal block of equal symbols, pair compression halves the symbols into left and right ones and names every left one with a right one
after it, and so on in turns. Equal stretches get equal names but at their edges, and each level is a constant factor shorter.

A run with period p holds a point i of the grid 0, p, 2p, ... whose whole period up to i + p and the one after lie in it, so it is found by
extending the pair (i, i + p) to both sides. The grids of all p are harmonic: n * ln(n) pairs for n words, most of which end at unequal
words. Extensions are answered exactly by the grammar: two places go up while both begin a parent of the same name, on over equal
symbols (over the shorter rest of two blocks at once), and down where symbols differ, until words do. All pairs of a batch walk
beside each other, as arrays. A stretch found with several periods keeps the least, of which the others are multiples.

Texts are rows and nothing is shuffled; a lost task is run again on its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.llm.common import small_arrow_batches
from convspan.llm.textarrays import mix, runs

#: Words in a run, at least, and periods in it.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Bytes of text whose grammar is built at once, longer texts alone; pairs of the grids that are looked at together.
BATCH_BYTES, PAIRS = 2_000_000, 1_000_000
#: Levels of a grammar; more would only shorten walks.
LEVELS = 120


class Ids(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Grammar:
    """The levels of a sequence one after another; a symbol is a place in them.

    name: equal for equal symbols; up: the parent; child: the first child (-1 for words); first: whether it is its parent's first child;
    block: whether its level is joined by blocks. Numbers below 0 are marks: all differ, and no symbol holds one.
    """

    def __init__(self, words: np.ndarray):
        level, names = words, int(words.max(initial=0)) + 1
        all_names, all_up, all_child, all_first, all_block = [level], [], [np.full(len(level), -1, np.int32)], [], []
        base, marks, salt = 0, int((words < 0).sum()), 0
        while len(level) > 2 * marks and len(all_names) < LEVELS:
            begins = np.empty(len(level), bool)
            begins[0] = True
            same = level[1:] == level[:-1]
            block = bool(same.any())
            if block:
                np.logical_not(same, out=begins[1:])
                starts = np.flatnonzero(begins)
                sizes = np.diff(starts, append=len(level))
                above = level[starts]
                long = np.flatnonzero(sizes > 1)
                keys = above[long] * np.int64(len(level) + 1) + sizes[long]
            else:
                salt += 1
                side = (mix(level.astype(np.uint64) + np.uint64(salt << 40)) >> np.uint64(17)) & np.uint64(1) == 0
                inner = level >= 0
                joins = side[:-1] & ~side[1:] & inner[:-1] & inner[1:]
                np.logical_not(joins, out=begins[1:])
                starts = np.flatnonzero(begins)
                above = level[starts]
                long = np.flatnonzero(np.append(joins, False)[starts])
                keys = above[long] * np.int64(names) + level[starts[long] + 1]
            if len(long):
                kinds, which = np.unique(keys, return_inverse=True)
                above[long] = names + which
                names += len(kinds)
            elif salt > LEVELS:
                break
            else:
                continue
            all_up.append((np.cumsum(begins) - 1 + base + len(level)).astype(np.int32))
            all_first.append(begins)
            all_block.append(np.full(len(level), block))
            all_child.append((starts + base).astype(np.int32))
            base += len(level)
            level = above
            all_names.append(level)
        all_up.append(np.zeros(len(level), np.int32))
        all_first.append(np.zeros(len(level) + 1, bool))  # nothing is above the last level
        all_block.append(np.zeros(len(level), bool))
        self.name, self.up, self.child = np.concatenate(all_names), np.concatenate(all_up), np.concatenate(all_child)
        self.first, self.block = np.concatenate(all_first), np.concatenate(all_block)

    def extend(self, left: np.ndarray, right: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from each left[k] and right[k] on, these included, forward or back."""
        found = np.zeros(len(left), np.int64)
        query, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        rising = np.ones(len(left), bool)
        edge = self.first[1:] if back else self.first
        while len(query):
            equal = self.name[a] == self.name[b]
            up_a, up_b = self.up[a], self.up[b]
            up = equal & rising & edge[a] & edge[b]
            up &= self.name[up_a] == self.name[up_b]
            on = np.flatnonzero(equal & ~up)
            if len(on):
                steps = np.ones(len(on), np.int64)
                inside = np.flatnonzero(self.block[a[on]])
                if len(inside):
                    at = on[inside]
                    rest = [x[at] - self.child[p[at]] + 1 if back else self.child[p[at] + 1] - x[at] for x, p in ((a, up_a), (b, up_b))]
                    steps[inside] = np.minimum(*rest)
                steps = -steps if back else steps
                a[on] += steps
                b[on] += steps
            a, b = np.where(up, up_a, a), np.where(up, up_b, b)
            down = ~equal
            rising &= equal
            below_a, below_b = self.child[a], self.child[b]
            done = down & (below_a < 0)  # both are on one level
            if back:  # the last child
                below_a, below_b = self.child[np.minimum(a + 1, len(self.child) - 1)] - 1, self.child[np.minimum(b + 1, len(self.child) - 1)] - 1
            if done.any():
                ended = np.flatnonzero(done)
                found[query[ended]] = np.abs(a[ended] - left[query[ended]])
                more = ~done
                query, a, b, rising, down, below_a, below_b = query[more], a[more], b[more], rising[more], down[more], below_a[more], below_b[more]
            a, b = np.where(down, below_a, a), np.where(down, below_b, b)
        return found


def _pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p) of all grids of all texts whose words i and i + p are equal."""
    text, period = np.repeat(np.arange(len(sizes)), sizes // LEAST_PERIODS), runs(np.ones(len(sizes), np.int64), sizes // LEAST_PERIODS)
    counts = (sizes[text] - 1) // period
    sums = np.append(0, np.cumsum(counts))
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + PAIRS, "right")) - 1)
        here = counts[a:b]
        periods = np.repeat(period[a:b], here)
        at = np.arange(sums[b] - sums[a]) - np.repeat(sums[a:b] - sums[a], here)
        at *= periods
        at += np.repeat(starts[text[a:b]], here)
        same = np.flatnonzero(words[at] == words[at + periods])
        yield at[same], periods[same]
        a = b


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as arrays of word numbers: text, start, length, period of every run, by text, then start, then period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.full(sizes.sum() + len(texts) + 1, -1, np.int64)
    words[np.append(0, starts + sizes)] = -1 - np.arange(len(texts) + 1)
    for start, text in zip(starts, texts, strict=True):
        words[start : start + len(text)] = text
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    found, grammar = [np.zeros((3, 0), np.int64)], None
    for at, period in _pairs(words, starts[long], sizes[long]):
        if not len(at):
            continue
        grammar = grammar or Grammar(words)
        after = grammar.extend(at, at + period)
        before = grammar.extend(at - 1, at + period - 1, back=True)
        whole = before + after + period
        kept = (before < period) & (whole >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))  # the first point of its grid in the run
        found.append(np.stack([at - before, whole, period])[:, kept])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(starts, start, "right") - 1
    return text, start - starts[text], length, period


def _run_batch(texts: list[str]) -> tuple[list[int], np.ndarray, pa.Array, list[bytes]]:
    """Words of each text; runs and their counts; the texts with what repeats taken out."""
    ids = Ids()
    split = [x.encode().split() for x in texts]
    text, start, length, period = find_runs([np.fromiter(map(ids.__getitem__, x), np.int64, len(x)) for x in split])
    collapsed = [None] * len(texts)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    for k, words in enumerate(split):
        a, b = edges[k], edges[k + 1]
        if a < b:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + length[a:b], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        collapsed[k] = b" ".join(words)
    structs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
    return [len(x) for x in split], edges, structs, collapsed


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns n_words (long), runs (array of start, length, period, longs, by start, then period) and collapsed (string):
    the words in no run, or among the first period of every run that they are in, joined by one space.

    Words are maximal stretches without ASCII white space, numbered from 0. A null, empty or blank text has no words and no runs and
    collapses to nothing; repeated rows are alike; an empty table gives an empty one; columns of docs that have one of the new names are replaced.
    """
    small_arrow_batches(docs)
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())]
    names = [f.name for f in new]
    keep = [c for c in docs.columns if c not in names]
    source = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            first = size = 0
            for i, more in enumerate(pc.binary_length(texts).to_pylist()):
                size += more
                if size < BATCH_BYTES and i < len(texts) - 1:
                    continue
                n_words, edges, structs, collapsed = _run_batch(texts.slice(first, i + 1 - first).to_pylist())
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, i + 1 - first) for c in keep]
                told = [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), structs), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *told], [*keep, *names])
                first, size = i + 1, 0

    schema = T.StructType([f for f in docs.schema if f.name in keep] + new)
    return source.select(*[F.col(f"`{c}`") for c in keep], "__text").mapInArrow(run, schema)
