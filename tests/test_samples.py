"""Owners of tokens, finished samples and their explanations against plain walks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convspan.operators import batch, samples, tokens

SPANS = "sample_id int, span_index int, left long, right long, boundary_owner string"
TEXTS = "sample_id string, span_index int, message_index int, span_class string, role string, text string, default_weight double"


def plain_owner(token, spans):
    start, end = token
    if start < 0 or end < start:
        return None, "a token has no valid range"
    if start == end:
        return None, "a token has no characters"
    if any(b[0] < a[0] or b[1] < a[1] for a, b in zip(spans, spans[1:])):
        return None, "spans are out of order"
    met = [k for k, (left, right, _) in enumerate(spans) if start < right and end > left]
    owners = {spans[k][2] for k in met}
    if not met:
        return None, "a token lies outside the spans"
    if len(met) == 1 or owners == {"left"}:
        return met[0], None
    return (met[-1], None) if owners == {"right"} else (None, "a token crosses spans without one owner")


def test_owners_like_a_walk(spark):
    """Random spans that touch, overlap, leave gaps, are empty or out of order, and tokens of all kinds."""
    rng = random.Random(5)
    made, want, span_rows, token_rows = {}, {}, [], []
    for s in range(60):
        spans, at, end = [], 0, 0
        owners = rng.choice((["right"], ["left"], ["right", "left"], ["right", "left", "reject"]))
        for _ in range(rng.randint(1, 8)):
            at += rng.randint(0, 3)
            end = max(end, at + rng.choice((0, 1, 2, 4)))
            spans.append((at, end, rng.choice(owners)))
            at = rng.choice((end, at))
        if s % 10 == 9:
            spans.reverse()
        made[s] = spans
        span_rows += [(s, k, *x) for k, x in enumerate(spans)]
        for pos in range(12):
            start = rng.randint(-1, 12)
            token = (start, start + rng.choice((-1, 0, 1, 1, 2, 5)))
            token_rows.append((s, pos, *token))
            want[s, pos] = plain_owner(token, spans)
    got = tokens.owned(spark.createDataFrame(token_rows, "sample_id int, pos int, start long, end long"), spark.createDataFrame(span_rows, SPANS)).collect()
    assert {(r.sample_id, r.pos): (r.span_index, r.fault) for r in got} == want
    assert len({f for _, f in want.values()}) == 6


def rows(spark, *spans):
    return spark.createDataFrame([(s, k, m, c, r, t, w) for s, k, m, c, r, t, w in spans], TEXTS)


def test_policies_are_checked():
    for bad in ({"length": 1}, {"length": 8, "truncation": "middle"}, {"length": 8, "min_context": 2}, {"length": 8, "truncation": "loss_aware", "min_context": 8}):
        with pytest.raises(ValueError):
            samples.Policy(**bad)


def test_samples_and_classes(spark):
    spans = rows(
        spark, ("long", 0, 0, "content", "user", "a b ", 0.0), ("long", 1, 1, "content", "assistant", "c d e f g", 1.0), ("short", 0, 0, "content", "user", "x ", 0.0), ("short", 1, 1, "content", "assistant", "y", 1.0), ("none", 0, 0, "content", "user", "u v", 0.0),
    )
    policy = samples.Policy(6, "loss_aware", 1, ())
    got = {r.sample_id: r for r in samples.tokenized_samples(spans, policy).collect()}
    assert {k: r["class"] for k, r in got.items()} == {"long": "emitted", "short": "emitted", "none": "zero_objective"}
    assert (got["long"].n_tokens, got["long"].start, got["long"].stop, got["long"].loss_weights) == (13, 7, 13, [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]) and got["none"].input_ids is None
    assert got["short"].loss_weights == [0.0, 0.0, 1.0] and got["short"].starts == [0, 1, 2] and got["short"].span_indices == [0, 0, 1]
    cut = {r.sample_id: r["class"] for r in samples.tokenized_samples(spans, samples.Policy(6, "reject", 0, ())).collect()}
    assert cut == {"long": "length_rejection", "short": "emitted", "none": "zero_objective"}
    whole = {r.sample_id: (r["class"], r.start, r.stop) for r in samples.tokenized_samples(spans, samples.Policy(3, "semantic_loss_aware", 0, ())).collect()}
    assert whole["long"] == ("semantic_rejection", None, None) and whole["short"] == ("emitted", 0, 3)


def test_fatal_causes(spark):
    spans = rows(spark, *[(s, 0, 0, "content", "user", "ab", 0.0) for s in ("ok", "cross", "both", "refused")], *[(s, 1, 1, "content", "assistant", t, 1.0) for s, t in (("ok", " c"), ("cross", "c"), ("both", " c"), ("refused", " c"))])
    spans = spans.withColumn("boundary_owner", F.when((F.col("sample_id") == "cross") & (F.col("span_index") == 0), "left").otherwise("right")).withColumn("role", F.when((F.col("sample_id") == "both") & (F.col("span_index") == 0), "system").otherwise(F.col("role")))
    rules = (tokens.Rule(1.0, {"role": ["assistant", "system"]}), tokens.Rule(0.5, {"role": "system"}))
    refusals = spark.createDataFrame([("refused", "no"), ("no spans", "none")], "sample_id string, error string")
    policy = samples.Policy(8, "right", 0, rules, "error")
    got = {r.sample_id: (r["class"], r.fatal_reason) for r in samples.tokenized_samples(spans, policy, refusals=refusals).collect()}
    assert got == {"ok": ("emitted", None), "cross": ("fatal", "alignment: a token crosses spans without one owner"), "both": ("fatal", "several rules match a token"), "refused": ("fatal", "render: no"), "no spans": ("fatal", "render: none")}
    with pytest.raises(Exception, match="several rules|crosses spans"):
        samples.tokenized_samples(spans, policy, strict=True).collect()
    needed = samples.Policy(8, "right", 0, (tokens.Rule(1.0, {"role": "tool"}, require_match=True),))
    assert {r.fatal_reason for r in samples.tokenized_samples(spans.drop("boundary_owner"), needed).collect()} == {"a required rule matches no token"}


def test_explanations(spark):
    spans = rows(spark, ("s", 0, 0, "content", "user", "a b ", 0.0), ("s", 1, 1, "content", "assistant", "c d", 1.0))
    w = samples.weighed_tokens(spans, policy := samples.Policy(4, "left"))
    told = json.loads(samples.explain(samples.explained(w, samples.windows(w, policy))).first().value)
    assert told["truncation"] == {"original_length": 7, "start": 3, "stop": 7} and [t["token"] for t in told["tokens"]] == [" ", "c", " ", "d"]
    assert [t["weight"] for t in told["tokens"]] == [0.0, 1.0, 1.0, 1.0] and {t["role"] for t in told["tokens"][1:]} == {"assistant"}
    whole = json.loads(samples.explain(samples.explained(w, samples.windows(w, samples.Policy(9)))).first().value)
    assert whole["truncation"] is None and len(whole["tokens"]) == 7


def test_numbers_of_emitted_rows(spark):
    rng = random.Random(9)
    data = [(rank, epoch, p, f"{epoch}-{p}", rng.random() < 0.6) for rank in range(2) for epoch in range(3) for p in range(rank, 40, 2)]
    want = {}
    for rank in range(2):
        for k, row in enumerate(r for r in sorted(data) if r[0] == rank and r[4]):
            want[row[:3]] = k
    table = spark.createDataFrame(data, "rank int, epoch int, position int, sample_id string, emitted boolean")
    table = table.withColumns({"input_ids": F.array("position"), "attention_mask": F.array(F.lit(True)), "loss_weights": F.array(F.lit(1.0))})
    numbered = batch.number_emitted(table, F.col("emitted"), width=7)
    assert {(r.rank, r.epoch, r.position): r.emitted_index for r in numbered.where("emitted_index is not null").collect()} == want
    by_number = {(k[0], n): f"{k[1]}-{k[2]}" for k, n in want.items()}
    stacked = batch.stack(numbered, 3, 2, 2).collect()
    assert {(r.rank, r.batch) for r in stacked} == {(rank, b) for rank in range(2) for b in range(sum(k[0] == rank for k in want) // 12)}
    for r in stacked:
        for d in range(2):
            for a in range(3):
                assert r.sample_ids[d][a] == [by_number[r.rank, r.batch * 12 + a * 4 + d * 2 + e] for e in range(2)]


def test_owners_without_joins(spark):
    """Tokens reach their owners in the tasks they are dealt to: nothing is broadcast by the driver, no token is shuffled."""
    spans = spark.createDataFrame([(k, i, i, c, "user", t, 0.0, "right") for k in range(9) for i, (c, t) in enumerate((("role_header", "<u>"), ("content", "a b")))], "sample_id long, span_index int, message_index int, span_class string, role string, text string, default_weight double, boundary_owner string")
    found = samples.weighed_tokens(spans.repartition(5, "sample_id"), samples.Policy(8, "right"))
    assert [(r.pos, r.span_index, r.span_class, r.token) for r in found.where("sample_id = 3").orderBy("pos").collect()] == [(0, 1, "content", "<u>a"), (1, 1, "content", " "), (2, 1, "content", "b")]
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan
