"""Removal of repeated byte strings by suffix arrays.

Two equal strings of LENGTH bytes have the same least hash among their runs of GRAM bytes. Consecutive strings of a document that share
this least hash form one stretch, and stretches with the same least hash meet in one bucket; there the suffixes of their different
contents are sorted, equal strings become neighbours in suffix order, and the least document of each run of neighbours is found.
Before that, documents' least hashes are announced, so that only stretches go on whose hash another document has too; equal contents
travel once per block. As all strings of a stretch hold the run with the least hash, it travels and is sorted as one symbol, unless it
occurs twice. Contents with a common string then agree around that symbol in one of a few ways, by how the string's other bytes lie on
its sides; those that agree with no other content in any of them are not sorted.

Contents are told apart by their least hash and by a cryptographic hash of their bytes (128 bits together); what is equal by these is
one content with several owners, and most of what exact copies share is settled so, before any sorting. Within a bucket the bytes of
equal contents are compared as well.

Suffixes are sorted by grouping, on arrays: they start in groups by as many first symbols as a number holds; then every group of several
is split by the groups of the suffixes as far behind as is known to agree, which doubles what is known. Suffixes alone in their group stay
where they are, and as strings of one length are looked for, groups that agree so far are split no more. It is done over many contents at
once: their number is a matter of array sizes, not of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convspan.llm import blocks
from convspan.llm.textarrays import byte_sums, chunks, digests, groups, mix, runs, utf8

LENGTH = 50
GRAM = 26
#: Symbols of the strings whose suffixes are sorted together, a longer string alone.
SORTED_TOGETHER = 50_000
SPAN = LENGTH - GRAM + 1
#: Bytes before and after the run that two contents with a common string share, for every split of its LENGTH - GRAM other bytes one of these.
SIDES = ((24, 0), (18, 1), (12, 7), (6, 13), (1, 19), (0, 24))
#: The symbol of the run of the first least hash that is sorted together; those of others follow it.
RUN = 300


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in ascending order by their first depth symbols, or more; those that agree in all these by their starts."""
    n = len(symbols)
    values, symbol = np.unique(symbols, return_inverse=True)
    bits = max(1, len(values).bit_length())
    known = max(1, min(62 // bits, depth))
    padded = np.zeros(n + known, np.int64)  # 0: behind the end
    padded[:n] = symbol + 1
    key = padded[:n]
    for k in range(1, known):
        key = key << bits | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    group = np.zeros(n, np.int64)  # of each suffix: the place of its group's first
    places, key = np.arange(n), key[order]
    while len(places):
        new = np.append(True, key[1:] != key[:-1])
        group[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        if known >= depth:
            break
        places = places[~(new & np.append(new[1:], True))]
        starts = order[places]
        behind = starts + known
        key = group[starts] << 32 | np.where(behind < n, group[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[places], key = starts[by], key[by]
        known *= 2
    return order


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order."""
    return sorted_suffixes(np.array(symbols, np.int64), len(symbols)).tolist()


def least_owner(strings: list[np.ndarray], owners: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each array of positive symbols and each of its substrings of this length: the least owner of a string that holds it."""
    sizes = np.array(list(map(len, strings))) + 1
    starts = np.cumsum(sizes) - sizes
    symbols = np.zeros(sizes.sum() + length, np.int64)
    symbols[runs(starts, sizes - 1)] = np.concatenate(strings)
    room = np.zeros(len(symbols), bool)
    room[runs(starts, np.maximum(sizes - length, 0))] = True
    order = sorted_suffixes(symbols[: sizes.sum()], length)
    order = order[room[order]]
    found = np.full(len(symbols), blocks.LAST)
    if len(order):
        windows = np.lib.stride_tricks.sliding_window_view(symbols, length)
        new = np.append(True, (windows[order[1:]] != windows[order[:-1]]).any(1))
        owner = np.repeat(np.array(owners, np.int64), sizes)
        found[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return [found[at : at + max(n - length, 0)] for at, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


@dataclass
class Stretches:
    """Of a range of a block's texts: least hash, first and last start, row of each stretch; of used ones also where the run is and a hash of the content."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    #: Where the run with the least hash begins, from the first start on; -1 if it occurs twice.
    run: np.ndarray | None = None
    name: np.ndarray | None = None

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Stretches:
        none = np.zeros(0, np.int64)
        grams = byte_sums(data).windows(GRAM, mixed=False)
        if len(grams) < SPAN:
            return cls(np.zeros(0, np.uint64), none, none, none)
        least, size = grams, 1
        while size < SPAN:  # least of size, then of twice as many, up to SPAN
            step = min(size, SPAN - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        change = np.zeros(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[offsets[:-1][offsets[:-1] < len(least)]] = True
        first = np.flatnonzero(change)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(first, offsets)))
        room = offsets[row + 1] - LENGTH
        last = np.minimum(np.append(first[1:], len(least)) - 1, room)
        fits = first <= room
        return cls(mix(least[first[fits]]), first[fits], last[fits], row[fits])

    def used(self, shared: np.ndarray, hot: np.ndarray, data: np.ndarray, with_run: bool = False) -> Stretches:
        """The shared ones, hot ones start by start and keyed by their content."""
        first, last, row, key = (x[shared] for x in (self.first, self.last, self.row, self.key))
        many = hot[shared]
        run = np.full(len(key), -1)
        if with_run:
            grams = byte_sums(data).windows(GRAM, mixed=False)
            times = np.where(many | (last - first >= SPAN), 2, 0)
            at = np.flatnonzero(times < 2)
            for k in range(2 * SPAN - 1):
                at = at[first[at] + k <= last[at] + SPAN - 1]
                hit = at[mix(grams[first[at] + k]) == key[at]]
                times[hit] += 1
                run[hit] = k
            run[times != 1] = -1
        if many.any():
            sizes = np.where(many, last - first + 1, 1)
            each = np.repeat(np.arange(len(many)), sizes)
            single, starts = many[each], runs(first, sizes)
            last, row, run = np.where(single, starts, last[each]), row[each], run[each]
            first, key = starts, key[each]
        raw = data.tobytes()
        name = digests([raw[x:y] for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
        if many.any():
            key = np.where(single, name, key)
        return Stretches(key, first, last, row, run, name.view(np.int64))


def _block(texts: pa.Array) -> list[tuple[int, Stretches]]:
    return [(a, Stretches.of(*utf8(texts.slice(a, b - a)))) for a, b in chunks(texts)]


def _texts(table: pa.Table) -> pa.Array:
    found = table.column("text").combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _different(stretches: list[tuple[int, Stretches]]) -> tuple[np.ndarray, np.ndarray]:
    """A block's different least hashes, and which of them each stretch has."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.key for _, x in stretches)]), return_inverse=True)


def _announced(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's different least hashes, and whether several of its documents have them."""
    docs, stretches = table.column("doc").to_numpy(), _block(_texts(table))
    key = np.concatenate([np.zeros(0, np.uint64), *(x.key for _, x in stretches)])
    doc = np.concatenate([np.zeros(0, np.int64), *(docs[a + x.row] for a, x in stretches)])
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)


def _used(texts: pa.Array, answers: pa.Table, buckets: int, with_run: bool = False) -> Iterator[tuple[int, np.ndarray, Stretches]]:
    """(first row, bytes, shared stretches) of ranges of a block's texts."""
    stretches = _block(texts)
    different, which = _different(stretches)
    shared, hot = blocks.marks(answers, different, buckets)
    done = 0
    for (a, b), (_, every) in zip(chunks(texts), stretches, strict=True):
        at = which[done : done + len(every.key)]
        done += len(at)
        if len(at):
            data, _ = utf8(texts.slice(a, b - a))
            yield a, data, every.used(shared[at], hot[at], data, with_run)


def _send(block: int, rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """A block's shared stretches, equal contents once: meeting hash, content hash, least doc, size; and the contents."""
    if not len(rows) or not len(answers):
        return blocks.messages(block, [])
    texts, docs = _texts(rows), rows.column("doc").to_numpy()
    known: dict[tuple[int, int], int] = {}
    keys, names, least, sizes, contents = [], [], [], [], []
    for a, data, found in _used(texts, answers, buckets, with_run=True):
        _, which, held = groups(found.key, found.name)
        order = np.lexsort((docs[a + found.row], which))
        at = order[np.cumsum(held) - held]
        raw = data.tobytes()
        for k, x, y, z, r, d in zip(*(v[at].tolist() for v in (found.key, found.name, found.first, found.last, found.run)), docs[a + found.row[at]].tolist(), strict=True):
            if (seen := known.get((k, x))) is None:
                known[k, x] = len(keys)
                keys.append(k)
                names.append(x)
                least.append(d)
                sizes.append((z - y + LENGTH) << 8 | r + 1)  # a run that is left out begins within 2 * SPAN
                contents.append(raw[y : z + LENGTH] if r < 0 else raw[y : y + r] + raw[y + r + GRAM : z + LENGTH])
            elif d < least[seen]:
                least[seen] = d
    key, meta = np.array(keys, np.uint64), np.array([names, least, sizes], np.int64)
    return blocks.messages(block, [(b, [key[at].tobytes(), np.ascontiguousarray(meta[:, at]).tobytes(), b"".join(map(contents.__getitem__, at.tolist()))]) for b, at in blocks.by_bucket(key, buckets)])


def _alike(key: np.ndarray, data: np.ndarray, starts: np.ndarray, size: int, whole: np.ndarray) -> np.ndarray:
    """Whether the bytes from a start on are all there (whole) and are those of another one with the same key."""
    some = np.flatnonzero(whole)
    pair = mix(key[some])
    for part in range(0, size, 4):
        part = min(part, size - 4)
        pair = mix(pair ^ data[starts[some][:, None] + np.arange(part, part + 4)].view(np.uint32)[:, 0])
    _, which, held = np.unique(pair, return_inverse=True, return_counts=True)
    out = np.zeros(len(key), bool)
    out[some] = held[which] > 1
    return out


def _owners(key: tuple, table: pa.Table) -> pa.Table:
    """Answers each block with the least doc of every string in the stretches it sent, where another document may have it."""
    keys = blocks.received(table, "a", np.uint64)
    meta = [x.reshape(3, -1) for x in blocks.received(table, "b", np.int64)]
    counts = list(map(len, keys))
    every, (name, doc, packed) = np.concatenate(keys), np.concatenate(meta, axis=1)
    size, run = packed >> 8, (packed & 255) - 1
    sent = np.where(run < 0, size, size - GRAM)
    data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("c")])
    at = np.cumsum(sent) - sent
    first, same, held = groups(every, name)  # one entry stands for all with its content
    raw = data.tobytes()
    for k in np.flatnonzero(first[same] != np.arange(len(same))).tolist():
        x, y, n = int(at[k]), int(at[first[same[k]]]), int(sent[k])
        if sent[first[same[k]]] != n or raw[x : x + n] != raw[y : y + n]:
            raise RuntimeError("two contents share both hashes")
    least = np.full(len(held), blocks.LAST)
    np.minimum.at(least, same, doc)
    # Of each content where its runs of starts with one owner begin in the lists, and how many; a content not sorted is one run, behind all of these.
    lengths, owners, begin, count, done = [], [], np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), 0
    grams: dict[np.uint64, np.ndarray] = {}

    def sort(entries: np.ndarray, cut: bool) -> None:
        nonlocal done
        at_, stop, run_ = at[entries].tolist(), (at + sent)[entries].tolist(), run[entries].tolist()
        strings = [data[x:y].astype(np.int64) + 1 for x, y in zip(at_, stop, strict=True)]
        middles = [[RUN + k] for k in np.unique(every[entries], return_inverse=True)[1].tolist()] if cut else [grams.get(k) for k in every[entries]]
        strings = [x if r < 0 else np.concatenate([x[:r], m, x[r:]]) for x, r, m in zip(strings, run_, middles, strict=True)]
        found = least_owner(strings, least[same[entries]].tolist(), SPAN if cut else LENGTH)
        ends = np.cumsum(list(map(len, found)))
        flat = np.concatenate(found)
        new = np.append(True, flat[1:] != flat[:-1])
        new[ends[:-1]] = True
        edge = np.flatnonzero(new)
        lengths.append(np.diff(np.append(edge, len(flat))))
        owners.append(flat[edge])
        stop = np.searchsorted(edge, ends)
        count[same[entries]] = np.diff(np.append(0, stop))
        begin[same[entries]] = done + np.append(0, stop[:-1])
        done += len(edge)

    # Contents whose run was left out are sorted with it as one symbol, if all that meet are such.
    _, met, several = np.unique(every[first], return_inverse=True, return_counts=True)
    full = np.zeros(len(several), bool)
    full[met[run[first] < 0]] = True
    mixed = several[met] > 1
    contracted = first[mixed & ~full[met]]
    if len(contracted):
        keys_, middle = every[contracted], at[contracted] + run[contracted]
        use = np.zeros(len(contracted), bool)
        for before, after in SIDES:
            whole = (run[contracted] >= before) & (middle + after <= (at + sent)[contracted])
            use |= _alike(keys_, data, middle - before, before + after, whole)
        contracted = contracted[use]
    others = first[mixed & full[met]]
    for entries, cut in ((contracted, True), (others, False)):
        entries = entries[np.argsort(every[entries], kind="stable")]
        if not cut:
            grams = {}
            for k in entries[run[entries] < 0].tolist():  # such a content holds the run that the others go without
                if every[k] not in grams:
                    own = data[at[k] : at[k] + sent[k]]
                    grams |= {every[k]: own[p : p + GRAM].astype(np.int64) + 1 for p in np.flatnonzero(byte_sums(own).windows(GRAM) == every[k])[:1].tolist()}
        edges = np.flatnonzero(every[entries][1:] != every[entries][:-1]) + 1
        weight = np.add.reduceat(sent[entries], np.append(0, edges)) if len(entries) else np.zeros(0, np.int64)
        cuts = edges[np.flatnonzero(np.diff(np.cumsum(weight) // SORTED_TOGETHER) > 0)] if len(edges) else edges
        for part in np.split(entries, cuts):
            if len(part):
                sort(part, cut)
    tell = np.flatnonzero((held[same] > 1) | (count[same] > 0))
    begin = np.where(count > 0, begin, done + np.arange(len(held)))
    count = np.maximum(count, 1)
    length, owner = np.concatenate([*lengths, size[first] - LENGTH + 1]).astype(np.int32), np.concatenate([*owners, least])
    edges = np.searchsorted(tell, np.append(0, np.cumsum(counts)))
    parts = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = tell[a:b]
        steps = count[same[own]]
        at_ = runs(begin[same[own]], steps)
        parts.append((name[own].tobytes(), steps.astype(np.int32).tobytes(), length[at_].tobytes(), owner[at_].tobytes()))
    columns = [table.column("block").combine_chunks(), pa.array([key[0].as_py()] * len(parts), pa.int64())]
    columns += [pa.array([x[k] for x in parts], pa.binary()) for k in range(4)]
    return pa.table(columns, ["block", "bucket", *blocks.PARTS])


def _told(answers: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the contents a block was told about, by content hash: hash; where their runs of starts begin; and of all runs the offset in the content, the length and the owner."""
    names, counts, lengths, owners = (np.concatenate([np.zeros(0, k), *blocks.received(answers, p, k)]) for p, k in zip("abcd", (np.int64, np.int32, np.int32, np.int64), strict=True))
    counts, lengths = counts.astype(np.int64), lengths.astype(np.int64)
    order = np.argsort(names)
    flat = runs((np.cumsum(counts) - counts)[order], counts[order])
    names, counts, lengths, owners = names[order], counts[order], lengths[flat], owners[flat]
    at = np.append(0, np.cumsum(counts))
    before = np.append(0, np.cumsum(lengths))
    return names, at, before[:-1] - np.repeat(before[at[:-1]], counts), lengths, owners


def _cut(block: int, rows: pa.Table, answers: pa.Table, marks: pa.Table, buckets: int) -> pa.Table:
    """Each row's bytes without those of strings that a document of smaller doc has."""
    texts, docs = _texts(rows), rows.column("doc").to_numpy()
    found = {}
    if len(marks):
        for a, _, x in _used(texts, marks, buckets):
            found[a] = x.first, x.last - x.first + 1, docs[a + x.row], x.name, x.key
    every = np.concatenate([np.zeros(0, np.int64), *(x[3] for x in found.values())])
    doc = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in found.values())])
    different, which, _ = groups(np.concatenate([np.zeros(0, np.uint64), *(x[4] for x in found.values())]), every)
    least = np.full(len(different), blocks.LAST)
    np.minimum.at(least, which, doc)
    at_ = 0
    names, at, offset, length, owner = _told(answers)
    kept, removed, spans = [], [], []
    for a, b in chunks(texts):
        data, offsets = utf8(texts.slice(a, b - a))
        gone = np.zeros(len(data) + 1, np.int32)
        if a in found:
            first, count, doc, name, _ = found[a]
            least_here = least[which[at_ : at_ + len(first)]]
            at_ += len(first)
            k = np.minimum(np.searchsorted(names, name), max(len(names) - 1, 0))
            hit = names[k] == name if len(names) else np.zeros(len(name), bool)
            local = ~hit & (least_here < doc)
            begins, ends = [first[local]], [first[local] + count[local]]
            sizes = (at[k + 1] - at[k])[hit] if len(names) else np.zeros(0, np.int64)
            if len(sizes):
                flat, each = runs(at[k][hit], sizes), np.repeat(np.flatnonzero(hit), sizes)
                later = owner[flat] < doc[each]
                begin = (first[each] + offset[flat])[later]
                begins.append(begin)
                ends.append(begin + length[flat][later])
            begins, ends = np.concatenate(begins), np.concatenate(ends)
            np.add.at(gone, begins, 1)
            np.add.at(gone, ends + LENGTH - 1, -1)
        drop = np.cumsum(gone[:-1]) > 0
        before = np.append(0, np.cumsum(drop))
        starts = np.append(0, np.cumsum(drop & ~np.append(False, drop[:-1])))
        removed.append(before[offsets[1:]] - before[offsets[:-1]])
        inside = np.append(np.append(False, drop), False)
        # a run that goes on from the row before begins anew in this one
        joined = drop[np.minimum(offsets[:-1], max(len(data) - 1, 0))] & inside[offsets[:-1]] & (offsets[1:] > offsets[:-1]) if len(data) else np.zeros(b - a, bool)
        spans.append(starts[offsets[1:]] - starts[offsets[:-1]] + joined)
        left = data[~drop].tobytes()
        cut = offsets - before[offsets]
        kept += [left[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    lengths = [np.diff(utf8(texts)[1])] if len(texts) else []
    columns = [rows.column("doc_id"), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (lengths, removed, spans)), pa.array(kept, pa.binary())]
    return pa.table(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs(doc_id, text).

    kept is the text's UTF-8 bytes without each byte that is covered by a string of 50 bytes which also starts in a row of smaller
    doc_id; n_spans counts the maximal removed runs. Strings never cross rows and are judged on the input. A null text is empty; rows
    with a null doc_id come after all others, in the order of a hash of their texts; rows of one doc_id remove nothing from each other;
    repeated rows have the same result; other columns are ignored; an empty table gives an empty one.
    """
    dealt, buckets = blocks.deal(docs)
    shared = blocks.shared_hashes(dealt, buckets, _announced)
    sent = blocks.answered(dealt, shared, lambda block, rows, told: _send(block, rows, told, buckets), blocks.MESSAGE)
    owners = sent.groupBy("bucket").applyInArrow(_owners, blocks.MESSAGE)
    both = shared.withColumn("bucket", -1 - shared.bucket).unionByName(owners)

    def act(block: int, rows: pa.Table, told: pa.Table) -> pa.Table:
        names = told.column("bucket").to_numpy()
        marks, answers = told.filter(pa.array(names < 0)), told.filter(pa.array(names >= 0))
        marks = marks.set_column(1, "bucket", pa.array(-1 - marks.column("bucket").to_numpy()))
        return _cut(block, rows, answers, marks, buckets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.answered(dealt, both, act, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
