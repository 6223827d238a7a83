"""Truncation against hand-computed windows and brute force."""

import random

from convspan.operators import truncate


def frame(spark, samples):
    data = [(name, pos, float(w), m) for name, tokens in samples.items() for pos, (w, m) in enumerate(tokens)]
    return spark.createDataFrame(data, "sample_id string, pos int, weight double, message_index int")


def spans(*parts):
    return [(w, m) for n, w, m in parts for _ in range(n)]


def test_fixture_windows(spark):
    tie = frame(spark, {"tie": spans((10, 0, 0), (4, 1, 1), (10, 0, 2), (4, 1, 3))})
    r = truncate.loss_aware(tie, 10).first()
    assert (r.start, r.stop, r.selected) == (18, 28, 4)
    context = frame(spark, {"c": spans((10, 0, 0), (18, 1, 1))})
    r = truncate.loss_aware(context, 10, 4).first()
    assert (r.start, r.stop, r.selected, r.context, r.relaxed) == (6, 16, 6, 4, False)


def test_semantic_fixture(spark):
    four = frame(spark, {"s": spans((4, 0, 0), (4, 1, 1), (4, 0, 2), (4, 1, 3)), "wide": spans((10, 1, 0))})
    found = {r.sample_id: r for r in truncate.semantic_loss_aware(four, 8).collect()}
    assert (found["s"].start, found["s"].stop, found["s"].first_block, found["s"].last_block) == (8, 16, 2, 3)
    assert found["wide"].start is None


def test_blocks_of_a_long_sample(spark):
    """Leading tokens go to the first message, and no frame from each row to the end is read, which costs the square of the tokens."""
    found = truncate.message_blocks(frame(spark, {"a": spans((2, 0, None), (3, 1, 4), (1, 0, None), (2, 1, 7)), "none": spans((2, 0, None))}))
    assert sorted((r.sample_id, r.block, r.start, r.stop, r.selected) for r in found.collect()) == [("a", 4, 0, 6, 3), ("a", 7, 6, 8, 2), ("none", None, 0, 2, 0)]
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString()


def brute(tokens, length, context):
    n = len(tokens)
    best = None
    for start in range(max(1, n - length + 1)):
        stop = min(start + length, n)
        weighted = [p for p in range(start + 1, stop) if tokens[p][0] > 0]
        score = sum(tokens[p][0] for p in weighted)
        before = weighted[0] - start if weighted else 0
        key = (bool(weighted) and before >= context, score, weighted[-1] if weighted else -1, -start)
        if best is None or key > best[0]:
            best = (key, start, stop, len(weighted), before)
    return best[1:]


def test_random_windows(spark):
    rng = random.Random(5)
    samples = {f"r{k}": [(rng.choice([0, 0, 0.5, 1]), 0) for _ in range(rng.randint(1, 40))] for k in range(150)}
    tokens = frame(spark, samples)
    for length, context in ((8, 0), (8, 3), (1, 0), (50, 2)):
        for r in truncate.loss_aware(tokens, length, context).collect():
            assert (r.start, r.stop, r.selected, r.context) == brute(samples[r.sample_id], length, context), (length, context, samples[r.sample_id])


def test_plain(spark):
    tokens = frame(spark, {"a": spans((10, 1, 0)), "b": spans((3, 1, 0))})
    got = {(side, r.sample_id): (r.start, r.stop) for side in ("right", "left", "reject") for r in truncate.plain(tokens, 4, side).collect()}
    assert got == {("right", "a"): (0, 4), ("right", "b"): (0, 3), ("left", "a"): (6, 10), ("left", "b"): (0, 3), ("reject", "a"): (0, 0), ("reject", "b"): (0, 3)}
