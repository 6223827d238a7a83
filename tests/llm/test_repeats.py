"""Repeated strings and passages, near-duplicates and components against brute force."""

import itertools
import random
import re
import string
import time

import numpy as np
import pytest

from convspan.llm import blocks, components, neardup, passages, suffixes, textarrays

LAST = blocks.LAST
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(frame):
    """[(place in the order of doc_id, doc_id, text)]; null ids come last, by a hash of the text."""
    return [(r.doc, r.doc_id, r.text) for r in blocks.deal(frame)[0].collect()]


def plain_strings(rows):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] by looking every string up."""
    starts: dict[bytes, int] = {}
    for at, _, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            key = data[k : k + 50]
            starts[key] = min(starts.get(key, LAST), at)
    out = []
    for at, doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if starts[data[k : k + 50]] < at:
                gone[k : k + 50] = b"\1" * 50
        out.append((doc, len(data), sum(gone), sum(1 for z, _ in itertools.groupby(gone) if z), bytes(b for b, z in zip(data, gone) if not z)))
    return sorted(out, key=repr)


def plain_passages(rows):
    firsts: dict[tuple, tuple] = {}
    split = [(at, d, WORD.findall(t or "")) for at, d, t in rows]
    for at, _, words in split:
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            firsts[key] = min(firsts.get(key, (LAST, LAST)), (at, k))
    out = []
    for at, doc, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if firsts[tuple(words[k : k + 20])] < (at, k):
                gone[k : k + 20] = [True] * 20
        out.append((doc, len(words), sum(gone), " ".join(w for w, z in zip(words, gone) if not z)))
    return sorted(out, key=repr)


def plain_components(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for doc, text in rows:
        words = WORD.findall((text or "").translate(lower))
        sets.append((doc, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    best = {d: d for d, _ in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
            if 100 * len(x & y) >= 75 * len(x | y) and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    return sorted(((d, len(s), None if d is None else best[d], d is None or best[d] == d) for d, s in sets), key=repr)


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def found(frame):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("hot", [256, 0])
def test_strings(docs, hot, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_BLOCKS", hot)
    assert found(suffixes.remove_repeated_strings(docs)) == plain_strings(ordered(docs))


def test_strings_of_real_rows(real):
    assert found(suffixes.remove_repeated_strings(real)) == plain_strings(ordered(real))


def test_hot_strings(monkeypatch):
    """The answers for hot hashes, start by start, inside one block."""
    data = np.frombuffer(("x" * 30 + "".join(map(chr, range(33, 123)))).encode(), np.uint8)
    every = suffixes.Stretches.of(data, np.array([0, len(data)]))
    yes = np.ones(len(every.key), bool)
    hot = every.used(yes, yes, data, with_run=True)
    assert (hot.first == np.arange(len(data) - 49)).all() and (hot.first == hot.last).all() and (hot.run == -1).all()


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 60))]
        assert suffixes.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_passages(docs, real):
    for frame in (docs, real):
        assert found(passages.remove_repeated_passages(frame)) == plain_passages(ordered(frame))


@pytest.mark.parametrize("small,block", [(24, 1024), (1, 4)])
def test_components(docs, real, small, block, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    for frame in (docs, real):
        assert found(neardup.find_components(frame)) == plain_components(pairs(frame))


def test_second_pass_closes_open_buckets(spark, monkeypatch):
    """Links that neither centre of a bucket sees: with confirmation by centres switched off the second pass finds them all."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        own = list(words)
        for j in range(5):
            own[(k * 5 + j) * 3 % 200] = f"edit{k}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_components(rows)
    original, calls = neardup._confirmed, []

    def none_at_first(docs, classes, pairs):
        calls.append(1)
        out = original(docs, classes, pairs)
        return out.limit(0) if len(calls) == 1 else out

    monkeypatch.setattr(neardup, "_confirmed", none_at_first)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    assert found(neardup.find_components(frame)) == wanted and len(calls) == 2


def test_star_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    best = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == best
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [components.EDGES_PER_PART, 40])
def test_components_of_few_edges_need_no_shuffle(spark, monkeypatch, most):
    # Each round had as many tasks as the session has partitions, a dozen times over, and the driver kept account of them all.
    monkeypatch.setattr(components, "EDGES_PER_PART", most)
    edges = [(k, k + 1) for k in range(0, 60) if k % 20] + [(100, k) for k in range(101, 160)] + [(k * 7 % 50 + 300, k * 11 % 50 + 300) for k in range(30)]
    links = spark.createDataFrame(edges, "u long, v long").where("u <> v")
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.component for r in components.connected_components(links).collect()} == least
    rows = links.count()
    for star in (components._large_star, components._small_star):
        plan = star(links.coalesce(components.parts_for(rows)), rows)._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (most == 40), plan


def test_empty_tables(empty):
    for f in (suffixes.remove_repeated_strings, passages.remove_repeated_passages, neardup.find_components):
        assert f(empty).count() == 0


def test_extra_columns_with_the_same_names(docs):
    from pyspark.sql import functions as F

    odd = docs.withColumns({c: F.lit("x") for c in ("block", "bucket", "kept", "n_words", "component_id", "n", "rep", "u", "doc", "row")})
    assert found(suffixes.remove_repeated_strings(odd)) == found(suffixes.remove_repeated_strings(docs))
    assert found(passages.remove_repeated_passages(odd)) == found(passages.remove_repeated_passages(docs))
    assert found(neardup.find_components(odd)) == found(neardup.find_components(docs))


def thue_morse(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_that_sums_of_powers_take_for_equal(spark, n):
    """A sum over powers of an odd number modulo 2 ** 64 has one value for these two words; no operator may take them for one."""
    one, two = thue_morse(n)
    sums = [textarrays.byte_sums(np.frombuffer(x.encode(), np.uint8)).slices(np.array([0]), np.array([n])) for x in (one, two)]
    assert sums[0] == sums[1]
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(words[:10] + [x] + words[10:10])) for k, x in enumerate((one, two))]
    rows += [(2, " ".join([*["same"] * 3, one, "end"])), (3, " ".join([*["same"] * 3, two, "end"])), (4, " ".join(words[:15] + [one] + words[15:])), (5, " ".join(words[:15] + [two] + words[15:])), (6, one), (7, two)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(passages.remove_repeated_passages(frame)) == plain_passages(ordered(frame))
    assert found(suffixes.remove_repeated_strings(frame)) == plain_strings(ordered(frame))
    assert found(neardup.find_components(frame)) == plain_components(rows)


def test_word_hashes():
    rng = random.Random(9)
    parts = ["a", "b", "ab", "ba", "é", "aaaaaaaa", "bbbbbbbbbbbbbbbb", "x" * 64]
    every = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000)] + [x for n in (64, 128, 1024) for x in thue_morse(n)]
    data = np.frombuffer(" ".join(every).encode(), np.uint8)
    begins, ends, _ = textarrays.words(data, np.array([0, len(data)]))
    by_word = {}
    for word, h in zip(every, textarrays.word_hashes(data, begins, ends).tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert len(textarrays.word_hashes(data[:0], begins[:0], ends[:0])) == 0


def test_groups_and_windows():
    rng = np.random.default_rng(1)
    for top in (2, 50):
        one, two = rng.integers(0, top, 300).astype(np.uint64), rng.integers(0, top, 300)
        at, which, held = textarrays.groups(one, two)
        pairs_ = list(zip(one.tolist(), two.tolist()))
        assert sorted(pairs_[k] for k in at) == sorted(set(pairs_)) and [pairs_[at[k]] for k in which] == pairs_
        assert [pairs_.count(pairs_[k]) for k in at] == held.tolist()
    values = rng.integers(0, 3, 400).astype(np.uint64)
    for size in (1, 5, 8, 20):
        every = textarrays.windows(values, size)
        by_hash, by_content = {}, {}
        for k, h in enumerate(every.tolist()):
            by_hash.setdefault(h, set()).add(tuple(values[k : k + size]))
            by_content.setdefault(tuple(values[k : k + size]), set()).add(h)
        assert len(every) == 401 - size and all(len(x) == 1 for x in [*by_hash.values(), *by_content.values()])
    assert len(textarrays.windows(values[:4], 5)) == 0


def test_many_rows_without_an_id_are_spread(spark):
    frame = spark.createDataFrame([(None, f"text {k} " + "common words of all these rows that go on for more than fifty bytes " * 2) for k in range(64)], "doc_id long, text string")
    assert blocks.deal(frame)[0].select("block").distinct().count() > 8
    assert found(suffixes.remove_repeated_strings(frame)) == plain_strings(ordered(frame))
    assert found(passages.remove_repeated_passages(frame)) == plain_passages(ordered(frame))


def test_hubs(spark, monkeypatch):
    """A centre with many partners, dealt into parts, and joins of its rows, give what they give without."""
    from convspan.llm import common

    rng = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(w if rng.random() > 0.004 else f"x{rng.random()}" for w in words)) for k in range(90)] + [(200 + k, f"alone {k} " * 6) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "HUB_ROWS", 3)
    monkeypatch.setattr(neardup, "GROUP_BYTES", 5_000)
    assert found(neardup.find_components(frame)) == plain_components(rows)
    left = spark.createDataFrame([(k % 7 if k % 2 else 1, k) for k in range(60)], "u long, x long")
    right = spark.createDataFrame([(k, k * k) for k in range(5)], "u long, y long")
    assert sorted(map(tuple, common.join_hubs(left, right, "u", 60).collect())) == sorted(map(tuple, left.join(right, "u").collect()))


def test_sizes_of_blocks(real, monkeypatch):
    """More text, more blocks, never more than messages are worth; results do not depend on it."""
    assert blocks.counts(0, 8) == (16, 8)
    for size in (10**9, 10**12, 10**14):
        n, buckets = blocks.counts(size, 8)
        assert size / n <= max(8.1e6, (size * 1.1e3) ** 0.5) and n * buckets <= max(size / 1e3, 128)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 5_000)
    assert found(passages.remove_repeated_passages(real)) == plain_passages(ordered(real))
    assert found(suffixes.remove_repeated_strings(real)) == plain_strings(ordered(real))


def test_rows_of_one_id_are_spread(spark):
    """A third of all rows has one id and texts of its own: they fall into many blocks, with the same results."""
    rng = random.Random(6)
    shared = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(5)]
    text = lambda k: " ".join(rng.choice([rng.choice(shared), *(f"t{k}x{rng.randint(0, 99)}" for _ in range(3))]) for _ in range(6))
    rows = [(7 if k % 3 == 0 else k, text(k)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, _ = blocks.deal(docs)
    held = {r.block: r["count"] for r in dealt.where("doc_id = 7").groupBy("block").count().collect()}
    assert len(held) > 8 and max(held.values()) < 20
    windows = {}
    split = [(d, t.split()) for d, t in rows]
    for d, words in split:
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            windows[key] = min(windows.get(key, (d, j)), (d, j))
    want = []
    for d, words in split:
        gone = {x for j in range(len(words) - 19) if windows[tuple(words[j : j + 20])] < (d, j) for x in range(j, j + 20)}
        want.append((d, len(words), len(gone), " ".join(w for x, w in enumerate(words) if x not in gone)))
    assert sorted(tuple(r) for r in passages.remove_repeated_passages(docs).collect()) == sorted(want)
    starts = {}
    for d, t in rows:
        data = t.encode()
        for j in range(len(data) - 49):
            starts[data[j : j + 50]] = min(starts.get(data[j : j + 50], d), d)
    want = []
    for d, t in rows:
        data = t.encode()
        gone = {x for j in range(len(data) - 49) if starts[data[j : j + 50]] < d for x in range(j, j + 50)}
        want.append((d, len(data), len(gone), bytes(b for x, b in enumerate(data) if x not in gone)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeated_strings(docs).collect()) == sorted(want)


def test_suffixes_by_arrays():
    """Orders to a depth are those by so many symbols; and many contents are sorted at once, in a fraction of the time of a loop over symbols."""
    rng = random.Random(5)
    for n, letters, depth in ((1, 1, 1), (40, 1, 7), (300, 2, 5), (300, 2, 25), (200, 500, 3)):
        s = np.array([rng.randrange(letters) for _ in range(n)])
        got = suffixes.sorted_suffixes(s, depth)
        assert sorted(got.tolist()) == list(range(n))
        heads = [s[i : i + depth].tolist() for i in got]
        assert heads == sorted(heads)
    strings = [np.array([rng.randrange(1, 4) for _ in range(rng.randrange(6, 30))]) for _ in range(60)]
    owners = [rng.randrange(9) for _ in strings]
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 5):
            least[tuple(s[i : i + 6])] = min(o, least.get(tuple(s[i : i + 6]), o))
    assert [x.tolist() for x in suffixes.least_owner(strings, owners, 6)] == [[least[tuple(s[i : i + 6])] for i in range(len(s) - 5)] for s in strings]
    began = time.process_time()
    suffixes.least_owner([np.array(rng.choices(range(1, 256), k=75)) for _ in range(8_000)], list(range(8_000)))
    assert time.process_time() - began < 1.5
