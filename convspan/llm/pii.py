"""Personal data: base patterns, and a skip-chain conditional random field that makes labels agree across a document.

The base patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. The field then labels the words of a
document that hold a digit or an @ (the others are other words by definition). Its potentials are a softmax of features of a word and
its neighbours, transitions between such words close to each other, and skip potentials between words, however distant, that are
alike: the same letters and digits, or the same last digits of longer numbers. Each word is joined with the next one like it, so a word
that occurs n times has n - 1 skip edges. Loopy message passing over a whole batch of documents runs until messages stand still; what a
base pattern found is given. Words outside base spans that reach the threshold become further spans: "key" for secrets, "similar" for
personal data in a form that the patterns miss, mostly one that occurs elsewhere in the document.

All three tables of potentials are fitted together, by pseudo-likelihood: every word given its features and its neighbours' labels. The
labels are the base patterns' own, on a bounded sample of documents; as patterns label nothing that they miss, some finds are mentioned
again at another place of their document, written in a way that no pattern finds, next to as many numbers of the same look that are no
personal data. What such a word looks like says little; what it repeats decides. Finding runs over all rows, whole texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.llm.common import hash_sample, small_arrow_batches, text_or_empty

#: Kinds in the order of the contract, and their patterns (an @ with its domain; the local part is read backwards).
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KEY = re.compile(r"[\"']?([0-9a-fA-F]{32,}|[A-Za-z0-9_+/-]{24,}={0,2})[\"']?")
#: Words with a digit or an @; only where a word begins is one looked for.
MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: Labels of the field; 0 is any other word.
OTHER, LABELS = 0, ("other", *KINDS, "key")
#: Documents with marked words that the field is fitted on, at most: those whose doc_id has the least hashes; and nodes of each, those
#: whose names have the least hashes, so that words that are alike stay together.
FITTED_ROWS, FITTED_NODES = 2_000, 1_000
#: Finds of a document that are mentioned again for the fit, at most.
MENTIONS = 20
#: Marginal from which a word outside base spans becomes a span; words between marked words that are still neighbours.
THRESHOLD, NEAR = 0.6, 3
#: Messages stand still when none changes by more; rounds after which they are taken as they are.
STILL, ROUNDS = 1e-3, 100
#: Last digits by which numbers are alike.
LAST_DIGITS = 7
#: Characters by which words are alike, at least.
LEAST_NAME = 6
NO_DIGIT = re.compile("[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind: the patterns' leftmost matches that pass their tests."""
    found = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, last, 0))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _features(word: str, before: str, after: str, digits: str) -> bytes:
    n = len(digits)
    core = word.strip("\"'.,;:!?()[]{}<>*#$%&")
    return bytes([
        True, "@" in word, core.count(".") == 3, n >= 12, 12 <= n <= 19 and not _luhn(digits), 7 <= n < 12, n < 4, n > 0 and n == len(core),
        "-" in core, word.startswith("+") or before.startswith("+"), "(" in word or "(" in before, before[-1:] in ("=", ":"), word[:1] in "\"'", len(core) >= 24,
        bool(re.search("[A-Za-z]", core)) and n > 0, after[:1].isdigit() or before[-1:].isdigit(), re.fullmatch(r"\+?[0-9]{1,3}", core) is not None,
    ])


N_FEATURES = len(_features("", "", "", ""))


@dataclass
class Graph:
    """The marked words of some texts: row, start and end in it, label by a base pattern (0 without); features; edges of both kinds."""

    row: list[int]
    start: list[int]
    end: list[int]
    given: list[int]
    features: list[bytes]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    def matrix(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.features), np.uint8).reshape(-1, N_FEATURES)


def _names(word: str, digits: str) -> set[str]:
    """What a word has in common with words that are alike."""
    names = {re.sub(r"[^0-9a-z]", "", word.lower().replace("@", "at"))}
    if len(digits) >= LAST_DIGITS:
        names.add("#" + digits[-LAST_DIGITS:])
    return {x for x in names if len(x) >= LEAST_NAME}


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    g = Graph([], [], [], [], [], [], [])
    for row, (text, base) in enumerate(zip(texts, bases, strict=True)):
        alike: dict[str, int] = {}
        last_end, last = -1, -1
        at, reach = 0, [(-1, -1)] * len(KINDS)  # of each kind the last span that has begun: its start and the greatest end
        for m in MARKED.finditer(text):
            word, a, b = m[0], *m.span()
            digits = NO_DIGIT.sub("", word)
            before, after = text[max(0, a - 40) : a].split(), text[b : b + 40].split()
            while at < len(base) and base[at][0] < b:
                reach[base[at][2]] = base[at][0], max(base[at][1], reach[base[at][2]][1])
                at += 1
            label = max(((start, kind + 1) for kind, (start, end) in enumerate(reach) if end > a), default=(0, OTHER))[1]
            if label == OTHER and before and before[-1][-1:] in ("=", ":") and KEY.fullmatch(core := word.strip(".,;!*#$%&")) and len(digits) >= 4 and re.search("[A-Za-z]", core):
                label = LABELS.index("key")
            node = len(g.row)
            g.row.append(row)
            g.start.append(a)
            g.end.append(b)
            g.given.append(label)
            g.features.append(_features(word, before[-1] if before else "", after[0] if after else "", digits))
            if last >= 0 and a - last_end < 200 and len(text[last_end:a].split()) <= NEAR:
                g.chain.append((last, node))
            last_end, last = b, node
            for name in _names(word, digits):
                if alike.get(name, node) != node:
                    g.skip.append((alike[name], node))
                alike[name] = node
    g.skip = list(dict.fromkeys(g.skip))
    return g


def _again(digits: str, kind: int, word: str, form: int) -> str:
    """A find, or a number of its look, written in a way that no pattern finds."""
    if kind == 0:
        return word.replace("@", "(at)" if form else "[at]")
    if kind == 1:
        return word.replace(".", "-" if form else "[.]")
    if kind == 2:
        return "._/"[form % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        local = digits[-10:]
        return local if form else f"{local[:3]}.{local[3:6]}.{local[6:]}"
    return word.strip("\"'")


def mentioned_again(text: str) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The text with some of its finds inserted once more; the finds, as base spans, with the new ones; and places of what is none.

    Which finds, where and in which form follows from hashes, so reruns agree. Keys count as a kind after KINDS.
    """
    found = [(a, b, k) for a, b, k in base_spans(text)]
    for m in MARKED.finditer(text):
        core = m[0].strip(".,;!*#$%&")
        if text[max(0, m.start() - 40) : m.start()].rstrip()[-1:] in ("=", ":") and KEY.fullmatch(core) and re.search("[A-Za-z]", core):
            found.append((m.start(), m.start() + len(core), len(KINDS)))
    gaps = [m.start() for m in re.finditer(r" (?=[^\x20\x09-\x0D])", text)]
    found.sort()
    starts, ends = [a for a, _, _ in found], list(accumulate((b for _, b, _ in found), max))
    gaps = [x for x in gaps if not (k := bisect_right(starts, x + 2)) or x > ends[k - 1] + 2]
    inserts: dict[int, tuple[str, int]] = {}
    for a, b, kind in sorted(found, key=lambda x: crc32(text[x[0] : x[1]].encode()))[:MENTIONS]:
        word, seed = text[a:b], crc32(text[a:b].encode())
        if not gaps or b - a > 100 or seed % 4 == 0:
            continue
        digits = NO_DIGIT.sub("", word)
        other = "".join(c if not c.isalnum() or c in "at" and kind == 0 else "0123456789"[(ord(c) * 7 + seed + k) % 10] if c.isdigit() else "abcdef"[(ord(c) + seed + k) % 6] for k, c in enumerate(word))
        for k, (text_, mark) in enumerate(((_again(digits, kind, word, seed >> 3 & 1), kind), (_again(NO_DIGIT.sub("", other), kind, other, seed >> 3 & 1), -1))):
            inserts.setdefault(gaps[(seed // 7 + k * 7919) % len(gaps)], (text_, mark))
    out, at, size, moved, wrong, right = [], 0, 0, [], [], []
    for gap in sorted(inserts):
        piece, kind = inserts[gap]
        out += [text[at:gap], " ", piece]
        size += gap - at + 1
        (right if kind >= 0 else wrong).append((size, size + len(piece), kind))
        size += len(piece)
        moved.append((gap, len(piece) + 1))
        at = gap
    out.append(text[at:])
    return "".join(out), right, [(a, b) for a, b, _ in wrong]


def _training(text: str) -> Graph:
    """The graph of a text with finds that are mentioned again, its labels those of all mentions."""
    longer, right, wrong = mentioned_again(text)
    g = graph([longer], [base_spans(longer)])
    marks = {**{(a, b): k + 1 for a, b, k in right}, **dict.fromkeys(wrong, OTHER)}
    g.given = [marks.get((a, b), y) for a, b, y in zip(g.start, g.end, g.given, strict=True)]
    if len(g.row) <= FITTED_NODES:
        return g
    order = lambda k: crc32(min(_names(w := longer[g.start[k] : g.end[k]], NO_DIGIT.sub("", w)), default="").encode())
    kept = sorted(sorted(range(len(g.row)), key=lambda k: (order(k), k))[:FITTED_NODES])
    place = {k: n for n, k in enumerate(kept)}
    edges = lambda e: [(place[a], place[b]) for a, b in e if a in place and b in place]
    return Graph(*([v[k] for k in kept] for v in (g.row, g.start, g.end, g.given, g.features)), edges(g.chain), edges(g.skip))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, logarithms
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Of every marked word, by sum-product messages along all edges at once, damped, which stop for each row when its own stand still."""
        n, k = len(g.row), len(LABELS)
        if not n:
            return np.zeros((0, k))
        local = g.matrix().astype(np.float64) @ self.unary
        given = np.array(g.given)
        clamped = np.flatnonzero(given)
        local[clamped] = -20.0
        local[clamped, given[clamped]] = 0.0
        chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in (g.chain, g.skip))
        if not len(chain) + len(skip):
            return _softmax(local)
        # Messages along the chain's edges, against them, and along skip edges both ways.
        ends = [chain, chain[:, ::-1], skip, skip[:, ::-1]]
        tables = [np.exp(t) for t in (self.chain, self.chain.T, self.skip, self.skip.T)]
        cuts = np.cumsum([0, *map(len, ends)])
        source, target = np.concatenate(ends).T
        back = np.concatenate([np.arange(cuts[j], cuts[j + 1]) for j in (1, 0, 3, 2)])
        messages, row = np.zeros((len(source), k)), np.array(g.row)[source]
        moving = np.ones(int(max(g.row)) + 1, bool)
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            tell = _softmax(belief[source] - messages[back])
            out = np.concatenate([tell[x:y] @ t for x, y, t in zip(cuts, cuts[1:], tables, strict=False)])
            out = np.log(out + 1e-12)
            step = 0.5 * (out - out.max(1, keepdims=True) - messages) * moving[row, None]
            messages += step
            most = np.zeros(len(moving))
            np.maximum.at(most, row, np.abs(step).max(1))
            moving &= most >= STILL
            if not moving.any():
                break
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _fitted(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 500) -> Field:
    """All potentials by gradient steps with momentum on the pseudo-likelihood, a little ridge on them."""
    k = len(LABELS)
    unary, to, alike = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
    unary[0, OTHER] = 2.0
    if not len(y):
        return Field(unary, to, alike)
    x, label = x.astype(np.float32), np.eye(k)[y]
    before, after, like = np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros((len(y), k))
    np.add.at(before, chain[:, 1], label[chain[:, 0]])
    np.add.at(after, chain[:, 0], label[chain[:, 1]])
    np.add.at(like, skip[:, 1], label[skip[:, 0]])
    np.add.at(like, skip[:, 0], label[skip[:, 1]])
    moves = [np.zeros_like(v) for v in (unary, to, alike)]
    for _ in range(rounds):
        off = (_softmax(x @ unary + before @ to + after @ to.T + like @ alike) - label) / len(y)
        both = like.T @ off
        for value, move, slope in zip((unary, to, alike), moves, (x.T @ off, before.T @ off + off.T @ after, both + both.T), strict=True):
            move *= 0.9
            move += 0.5 * (slope + 1e-4 * value)
            value -= move
    return Field(unary, to, alike)


def fit(docs: DataFrame, rows: int = FITTED_ROWS) -> Field:
    """The field, from at most `rows` texts with a digit or an @ and FITTED_NODES marked words of each; the driver gets these words' features."""
    small_arrow_batches(docs)
    marked = docs.select("doc_id", text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]"))
    sample = hash_sample(marked, rows, "doc_id").select(F.xxhash64("doc_id").alias("order"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _training(text)
                parts = [b"".join(g.features), *(np.array(x, np.int32).tobytes() for x in (g.given, g.chain, g.skip))]
                yield pa.RecordBatch.from_arrays([pa.array([order]), *(pa.array([x], pa.binary()) for x in parts)], ["order", "x", "y", "chain", "skip"])

    found = sample.mapInArrow(run, "order long, x binary, y binary, chain binary, skip binary").orderBy("order", "x").collect()
    xs, ys, chains, skips, n = [np.zeros((0, N_FEATURES), np.uint8)], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int32)], [np.zeros((0, 2), np.int32)], 0
    for r in found:
        xs.append(np.frombuffer(bytes(r.x), np.uint8).reshape(-1, N_FEATURES))
        ys.append(np.frombuffer(bytes(r.y), np.int32))
        chains.append(np.frombuffer(bytes(r.chain), np.int32).reshape(-1, 2) + n)
        skips.append(np.frombuffer(bytes(r.skip), np.int32).reshape(-1, 2) + n)
        n += len(ys[-1])
    return _fitted(*map(np.concatenate, (xs, ys, chains, skips)))


def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, further spans as (start, end, name)) of each text; neighbours with the same label are one span."""
    bases = [base_spans(x) for x in texts]
    g = graph(texts, bases)
    best = field.marginals(g)
    further: list[list] = [[] for _ in texts]
    label = best[:, 1:].argmax(1) + 1 if len(best) else np.zeros(0, np.int64)
    key, last = LABELS.index("key"), -2
    for k in np.flatnonzero((best[:, 1:].sum(1) if len(best) else label) >= THRESHOLD).tolist():
        if 0 < g.given[k] < key:
            continue  # inside a base span
        row, a, b = g.row[k], g.start[k], g.end[k]
        core = re.search(r"[0-9A-Za-z](?s:.*)[0-9A-Za-z]|[0-9A-Za-z]", texts[row][a:b])
        if core:
            start, end = a + core.start(), a + core.end()
            if last == k - 1 and row == g.row[last] and label[k] == label[last] != key and further[row] and a == g.end[last] + 1:
                start = further[row].pop()[0]
            further[row].append((start, end, "key" if label[k] == key else "similar"))
            last = k
    return list(zip(bases, further, strict=True))


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_personal_data(docs: DataFrame, field: Field, text: str = "text", names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """docs with base and spans, under these names, arrays of (kind, start, end): the base patterns' spans, and these with the field's
    further ones.

    Positions are characters of the whole text, ends exclusive; spans are in the order of start, then kind (email, ip, card, phone,
    key, similar). A null or empty text has none; repeated rows have the same; an empty table gives an empty one; columns that have
    one of the new names are replaced.
    """
    small_arrow_batches(docs)
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("__text"))
    order = {k: n for n, k in enumerate((*KINDS, "key", "similar"))}

    def arrays(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
        flat = [x for r in rows for x in r]
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([x[2] for x in flat], pa.string()), *(pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1))], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.slice(first, 500)
                texts = part.column(part.num_columns - 1)
                some = np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False))
                base, spans = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
                for k, (own, further) in zip(some.tolist(), find_all([texts[k].as_py() for k in some.tolist()], field), strict=True):
                    base[k] = [(a, b, KINDS[kind]) for a, b, kind in own]
                    spans[k] = sorted(base[k] + further, key=lambda x: (x[0], order[x[2]]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], arrays(base), arrays(spans)], [*keep, *names])

    return source.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, SPAN) for name in names]))


def mask(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    step = lambda done, s: F.when(
        s["start"] >= done["at"],
        F.struct(F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")),
    ).otherwise(done)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text))))).otherwise(F.col(text))
