"""Periodic runs by recompression against comparing all pairs of words."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspan.llm import periods, registry

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """start, length, period of every run."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, found):
    return " ".join(w for k, w in enumerate(words) if not any(s + p <= k < s + length for s, length, p in found))


def odd_texts(rng):
    for _ in range(150):
        few = [chr(97 + k) for k in range(rng.randint(1, 4))]
        yield [rng.choice(few) for _ in range(rng.randint(0, 70))]
    for _ in range(60):  # repeats of repeats, with breaks
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        unit = (unit * rng.randint(1, 4) + [rng.choice("abcd")]) * rng.randint(1, 6)
        text = [rng.choice("abx") for _ in range(rng.randint(0, 20))] + unit + [rng.choice("abx") for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = "z"
        yield text
    yield from (["a"] * 500, ["a", "b"] * 200, (["a"] * 30 + ["b"]) * 9, ["a"] * 11, ["a"] * 12, ["a", "b", "c", "d", "e", "f"] * 2, ["a", "b", "c", "d", "e", "f"] * 2 + ["a"])
    a, b = ["a"], ["a", "b"]
    for _ in range(11):  # many nested runs
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("together,pairs,levels", [(1, 1_000_000, 120), (20, 1_000_000, 120), (20, 50, 120), (20, 1_000_000, 3)])
def test_like_plain_runs(monkeypatch, together, pairs, levels):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    monkeypatch.setattr(periods, "LEVELS", levels)
    texts = list(odd_texts(random.Random(together)))
    for at in range(0, len(texts), together):
        some = texts[at : at + together]
        text, *run = periods.find_runs([np.array([ord(w) for w in x], np.int64) for x in some])
        for k, words in enumerate(some):
            assert [tuple(map(int, r)) for r in zip(*(x[text == k] for x in run))] == plain_runs(words), words


def test_extensions():
    rng = random.Random(3)
    words = np.array([-1] + [rng.choice([1, 1, 1, 2]) for _ in range(400)] + [-2], np.int64)
    grammar = periods.Grammar(words)
    a, b = np.array([(i, j) for i in range(1, 400) for j in range(i + 1, 401, 7)]).T
    for back in (False, True):
        got = grammar.extend(a, b, back)
        step = -1 if back else 1
        for i, j, n in zip(a, b, got):
            wanted = 0
            while words[i + step * wanted] == words[j + step * wanted]:
                wanted += 1
            assert n == wanted


def test_long_text():
    """Texts of millions of words: one word over and over, and a long period that comes three times."""
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 1000, 100_000)
    _, start, length, period = periods.find_runs([np.concatenate([[5000], unit, unit, unit[:50_000], [6000]])])
    assert (1, 250_000, 100_000) in set(zip(start.tolist(), length.tolist(), period.tolist()))
    _, start, length, period = periods.find_runs([np.zeros(300_000, np.int64)])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1])


def test_table(docs, empty):
    odd = docs.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = periods.collapse_runs(odd).collect()
    assert len(got) == docs.count() and any(r.runs for r in got)
    for r in got:
        words = (r.text or "").encode().split()
        found = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == found
        assert r.collapsed == collapsed([w.decode() for w in words], found)
    assert periods.collapse_runs(empty).count() == 0


def test_query(spark, real):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: r for r in registry.op12_recompressed_runs(spark, SF).collect()}
    rows = real.collect()
    assert len(got) == len(rows)
    planted = 0
    for row in rows:
        words, h = [w.decode() for w in (row.text or "").encode().split()], zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found, r = plain_runs(words), got[row.doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        wanted = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *wanted)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{p}\n" for s, length, p in found)) and r.collapsed_sha256 == sha(collapsed(words, found))
    assert planted
