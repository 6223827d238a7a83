"""Adapters, renderers, rules, tape, cursor, recipe, statistics, parameters and streaming on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from convspan.operators import adapters, batch, params, render, stats, tokens, tool_units, truncate, typed_blocks
from convspan.sources import tables, training_recipe
from convspan.streaming import cursor


def test_tool_call_adapter(spark, tmp_path):
    call = {"id": "c1", "type": "function", "function": {"name": "weather", "arguments": '{"city": "Oslo"}'}}
    good = {"id": "a", "messages": [{"role": "user", "content": "?"}, {"role": "assistant", "reasoning_content": "think", "tool_calls": [call]}, {"role": "tool", "content": "12", "tool_call_id": "c1"}]}
    bad = {"id": "b", "messages": [{"role": "assistant", "tool_calls": [call | {"id": ""}]}]}
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(map(json.dumps, (good, bad, {"id": "c", "messages": []}, {"id": "d", "messages": [{"role": "robot", "content": "x"}]}))))
    found = {r.id: r for r in adapters.messages_adapter(tables.rows(spark, str(path), "messages")).collect()}
    assert found["a"].reason is None
    assert [[p.kind for p in m.parts] for m in found["a"].messages] == [["text"], ["reasoning", "tool_call"], ["tool_result"]]
    assert found["a"].messages[2].parts[0].call_id == "c1"
    assert "non-empty string" in found["b"].reason and "non-empty list" in found["c"].reason and "role" in found["d"].reason
    with pytest.raises(KeyError):
        adapters.get_adapter("guess")


def adapted(spark, tmp_path, name, *rows):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return {r.id: r for r in adapters.get_adapter(name)(tables.rows(spark, str(path), name)).collect()}


def test_registered_adapters(spark, tmp_path):
    """Each dialect by its registered name: what is optional may be missing, what belongs to an assistant stays with it."""
    user, plain = {"role": "user", "content": "?"}, {"role": "assistant", "tool_calls": [{"id": "c", "function": {"name": "now"}}]}
    thinker = {"role": "user", "content": "?", "reasoning_content": "hm"}
    blocks = {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "d", "name": "f", "input": {}}]}
    ordered = {"role": "assistant", "tool_calls": [{"id": "e", "function": {"name": "f", "arguments": {"z": 1.50, "a": " x  y "}}}]}
    found = adapted(spark, tmp_path, "messages", {"id": "no arguments", "messages": [user, plain]}, {"id": "thinking user", "messages": [thinker]}, {"id": "blocks", "messages": [user, blocks]}, {"id": "order", "messages": [user, ordered]}, {"id": "name", "messages": [user | {"name": ""}]})
    assert found["no arguments"].reason is None and [(p.kind, p.value, p.tool_name) for p in found["no arguments"].messages[1].parts] == [("tool_call", "{}", "now")]
    assert found["thinking user"].reason == "reasoning belongs to an assistant and is a string" and "identifier" in found["name"].reason
    assert [(p.kind, p.value) for p in found["blocks"].messages[1].parts] == [("text", "a"), ("tool_call", "{}")]
    assert found["order"].messages[1].parts[0].value == '{"z":1.5,"a":" x  y "}'
    found = adapted(spark, tmp_path, "sharegpt", {"id": "s", "conversations": [{"from": "human", "value": "?"}, {"from": "gpt", "value": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "!"}]}]}, {"id": "t", "conversations": [{"from": "cat", "value": "x"}]})
    assert [[(p.kind, p.value) for p in m.parts] for m in found["s"].messages] == [[("text", "?")], [("reasoning", "t"), ("text", "!")]] and found["t"].reason == "unknown message role"
    rows = [{"prompt": "?", "prompt_id": "u", "messages": [user, {"role": "assistant", "content": "!"}]}, {"prompt": "other", "prompt_id": "v", "messages": [user]}, {"prompt": "?", "prompt_id": "w", "messages": [user, {"role": "system", "content": "x"}]}, {"prompt": "?", "prompt_id": "x", "messages": [{"role": "robot"}]}, {"prompt": "?", "messages": [user]}]
    (tmp_path / "u.jsonl").write_text("\n".join(map(json.dumps, rows)))
    reasons = {r.prompt_id: r.reason for r in adapters.get_adapter("ultrachat_200k")(tables.rows(spark, str(tmp_path / "u.jsonl"), "ultrachat_200k")).collect()}
    assert reasons == {"u": None, "v": "prompt must equal the first user message", "w": "only user and assistant roles are supported", "x": "unknown message role", None: "prompt_id must be a string"}


def test_plain_chat_refusals(spark):
    rows = [("none", 0, "assistant", "x", 1), ("reply", 0, "user", " <tool_response>1</tool_response> ", 1), ("late", 0, "user", "x", 2), ("late", 1, "system", "y", 2), ("ok", 0, "system", "s", 2), ("ok", 1, "user", "x", 2)]
    m = spark.createDataFrame(rows, "sample_id string, message_index int, role string, text string, n_messages long")
    assert {r.sample_id: r.error for r in render.plain_refusals(m).collect()} == {"none": "at least one user query is required", "reply": "at least one user query is required", "late": "system message must be first"}
    assert {r.sample_id for r in render.qwen3_5(m).select("sample_id").collect()} == {"ok"}


def test_sample_ids(spark):
    row = spark.range(1)
    place = "\0".join(("a/b", "r", "c", "train", "7"))
    import hashlib

    got = row.select(adapters.sample_id("a/b", "r", "c", "train", F.lit(7)).alias("x"), adapters.sample_id("a/b", "r", "c", "train", F.lit(7), F.lit(""), F.lit("id")).alias("y")).first()
    assert got.x == "a/b:train:" + hashlib.sha256(place.encode()).hexdigest() and got.y == "a/b:train:id"


def test_render_strip_and_boundary(spark):
    m = spark.createDataFrame([("s", 0, "user", "　 hi\n", 2), ("s", 1, "assistant", "yo", 2)], "sample_id string, message_index int, role string, text string, n_messages long")
    assert render.documents(render.qwen3_5(m)).first().text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nyo<|im_end|>\n"
    assert render.documents(render.olmo2_instruct(m)).first().text == "<|endoftext|><|user|>\n　 hi\n\n<|assistant|>\nyo<|endoftext|>"


def test_straddling_token_owner(spark):
    span = spark.createDataFrame([("s", 0, 0, "content", "user", "a", 0.0), ("s", 1, 1, "content", "assistant", "b", 1.5)], "sample_id string, span_index int, message_index int, span_class string, role string, text string, default_weight double")
    one = tokens.tokenize(render.documents(span))
    assert tokens.align(one, span, "right").first().span_index == 1
    assert tokens.align(one, span, "left").first().span_index == 0
    assert tokens.weigh(tokens.align(one, span), ()).first().weight == 0.0


def test_rules_are_strict():
    with pytest.raises(ValueError):
        tokens.Rule(-1.0)
    with pytest.raises(ValueError):
        tokens.Rule(1.0, {"colour": "red"})


MESSAGES = "sample_id string, message_index int, role string, call_ids array<string>, result_ids array<string>"


def plain_units(messages):
    """Units of one sample's (role, calls, results) by walking it; None if a rule is broken."""
    seen, answered, pending, units, unit_open = set(), set(), set(), [], False
    for role, calls, results in messages:
        if calls and (role != "assistant" or "" in calls or len(set(calls)) < len(calls) or seen & set(calls)):
            return None
        if role == "tool":
            if len(results) != 1 or not unit_open or results[0] not in pending | answered or results[0] in answered or results[0] not in pending:
                return None
            pending.discard(results[0])
            answered.add(results[0])
        elif unit_open and (pending or role != "assistant"):
            return None
        if unit_open:
            units[-1] += 1
        else:
            units.append(1)
        seen |= set(calls)
        pending |= set(calls)
        unit_open = bool(calls) or role == "tool"
    return None if unit_open else units


def test_tool_units_like_a_walk(spark):
    cases = [
        (["user", "assistant", "tool", "assistant"], [[], ["c"], [], []], [[], [], ["c"], []]), (["tool"], [[]], [["c"]]), (["tool"], [[]], [[]]), (["assistant", "tool"], [["c"], []], [[], ["c"]]), (["assistant", "assistant"], [["c"], []], [[], []]),
        (["assistant"], [["c", "c"]], [[]]), (["assistant"], [[""]], [[]]), (["user"], [["c"]], [[]]), (["assistant", "tool", "tool"], [["c"], [], []], [[], ["c"], ["c"]]),
    ]
    samples = {f"case{k}": list(zip(*c)) for k, c in enumerate(cases)}
    rng = random.Random(3)
    for k in range(1500):
        out, number = [], 0
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.6:
                ids = [f"i{number + j}" for j in range(rng.randint(1, 2))]
                number += rng.choice([2, 2, 2, 0])
                out += [("assistant", ids, [])] + [("tool", [], [x]) for x in rng.sample(ids, len(ids))] + [("assistant", [], [])]
            else:
                out.append((rng.choice(["user", "assistant"]), [], []))
        if rng.random() < 0.5:
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[], [out[at]] * 2, [("tool", [], ["i0"])], [("user", [], [])], [("assistant", ["i0", ""], [])]])
        if out:
            samples[f"r{k}"] = out
    rows = [(name, i, *m) for name, messages in samples.items() for i, m in enumerate(messages)]
    frame = spark.createDataFrame(rows, MESSAGES)
    got = {}
    for r in tool_units.tool_units(frame).orderBy("sample_id", "unit").collect():
        got.setdefault(r.sample_id, []).append(None if r.reason else r.last_message - r.first_message + 1)
    want = {name: plain_units(m) or [None] for name, m in samples.items()}
    assert got == want and sum(v == [None] for v in want.values()) > 300


def test_records_and_ownership(spark):
    weighed = spark.createDataFrame([("a", p, 1.0 if p % 3 else 0.0, p // 4) for p in range(20)] + [("b", p, 1.0, [0, 1, 0][p]) for p in range(3)] + [("c", 0, 1.0, None)], "sample_id string, pos int, weight double, message_index int")
    assert {(r.sample_id, r.fault) for r in truncate.ownership_faults(weighed).collect()} == {("b", "a message does not own one run of tokens in order"), ("c", "no message owns a token")}
    one = weighed.where("sample_id = 'a'")
    found = truncate.records(one, truncate.semantic_loss_aware(one, 8), "semantic_loss_aware", 8)
    r = found.first()
    assert (r.original_length, r.start, r.stop, r.retained_messages, r.dropped_messages) == (20, 12, 20, [3, 4], [0, 1, 2]) and truncate.record_faults(found).isEmpty()
    assert truncate.records(one, truncate.plain(one, 8, "right"), "right", 8).first().retained_messages == []
    for column, value in (("stop", 30), ("retained_selected", 99), ("retained_weight", 99.0), ("retained_context", -1), ("dropped_messages", []), ("retained_units", 99), ("policy", "right")):
        broken = found.withColumn(column, F.lit(value) if value != [] else F.array().cast("array<int>"))
        assert truncate.record_faults(broken).count() == 1, column


def test_renderer_identity():
    one = render.renderer_identity("olmo2", generation_prompt=True, thinking=False)
    assert one == render.renderer_identity("olmo2_instruct", thinking=False, generation_prompt=True) != render.renderer_identity("olmo2_instruct", generation_prompt=False, thinking=False)
    with pytest.raises(KeyError):
        render.renderer_identity("x")


def test_rules_from_configuration():
    rules, conflict = tokens.rules_of({"conflict_mode": "multiply", "rules": [{"select": {"tags": ["a", "b"]}, "weight": 2, "require_match": True}]})
    assert conflict == "multiply" and rules[0].weight == 2.0 and rules[0].require_match and rules[0].name == "rule_0"
    for bad in ({"rule": []}, {"conflict_mode": "none"}, {"rules": [{"select": {}}]}, {"rules": [{"weight": 1, "colour": 2}]}, {"rules": [{"weight": -1}]}, {"rules": [{"weight": 1, "select": {"colour": 1}}]}):
        with pytest.raises(ValueError):
            tokens.rules_of(bad)


def test_typed_blocks(spark):
    good = '{"messages":[{"role":"user","content":"[1]"},{"role":"assistant","content":[{"type":"tool_use","id":"a","name":"f","input":{"b":1,"a":[]}}],"tool_calls":[{"id":"b","name":"g","arguments":"{\\"x\\": 2}"}]},{"role":"tool","call_id":"a","content":[{"type":"tool_result","content":"r"},{"type":"image","url":"u"}]},{"role":"gpt","content":null,"reasoning_content":"h"}],"tools":[{"name":"f","parameters":{}}]}'
    bad = {
        '{"messages":[]}': "messages must be a non-empty list", '{"messages":[{"role":"user","content":5}]}': "content must be a string, null or a list of blocks", '{"messages":[{"role":"user","content":["x"]}]}': "a block must be a mapping",
        '{"messages":[{"role":"user","content":[{"type":"text","text":3}]}]}': "a text block needs a string", '{"messages":[{"role":"assistant","content":[{"type":"tool_use","id":7,"name":"f"}]}]}': "an identifier must be a non-empty string",
        '{"messages":[{"role":"assistant","content":"x","tool_calls":[{"name":"f","arguments":"{"}]}]}': "arguments are invalid JSON", '{"messages":[{"role":"tool","tool_call_id":"a","content":[{"type":"tool_result","tool_use_id":"b","content":"r"}]}]}': "conflicting call ids of a result",
        '{"messages":[{"role":"user","content":"x"}],"tools":[{"name":"f","parameters":3}]}': "a tool's parameters must be a mapping", '{"messages":[{"role":"user","content":"x"}],"tools":[{"description":"d"}]}': "a tool needs a name",
    }
    rows = spark.createDataFrame([(x,) for x in (good, *bad)], "row string").select("row", F.from_json("row", typed_blocks.ROW).alias("r")).select("row", "r.*")
    got = {r.row: r for r in typed_blocks.typed_messages_adapter(rows).collect()}
    assert {k: got[k].reason for k in bad} == bad and got[good].reason is None
    parts = [[(p.kind, p.value, p.call_id, p.tool_name) for p in m.parts] for m in got[good].messages]
    assert parts[0] == [("text", "[1]", None, None)] and parts[1] == [("tool_call", '{"a":[],"b":1}', "a", "f"), ("tool_call", '{"x":2}', "b", "g")]
    assert parts[2][0] == ("tool_result", "r", "a", None) and parts[2][1][0] == "media" and parts[3] == [("reasoning", "h", None, None)] and got[good].tools[0].function.name == "f"


def test_tape_round_trip_and_tampering(spark, tmp_path):
    schema = tables.batches_schema()
    tape = spark.createDataFrame([(s, i, [s, i, 0], [True, True, False], [0.0, 1.0, 0.0]) for s in range(3) for i in range(4)], schema)
    path = str(tmp_path / "tape")
    batch.write_tape(tape, path)
    assert batch.read_tape(spark, path).count() == 12
    assert batch.tape_faults(tape, 3).count() == 0
    with pytest.raises(Exception, match="exist"):
        batch.write_tape(tape, path)
    changed = str(tmp_path / "changed")
    spark.read.parquet(path).withColumn("input_ids", F.array(F.lit(9), F.lit(9), F.lit(9))).write.partitionBy("step").parquet(changed)
    with pytest.raises(Exception, match="digest"):
        batch.read_tape(spark, changed).collect()
    broken = spark.createDataFrame([(0, 0, [1], [True], [0.0]), (0, 1, [1, 2, 3], [True, False, True], [0.0, 0.0, 1.0]), (0, 2, [1, 2, 3], [True, True, False], [0.0, 0.0, 1.0]), (0, 3, [1, 2, 3], [True, True, True], [1.0, 0.0, 1.0])], schema)
    assert batch.tape_faults(broken, 3).count() == 4


@pytest.mark.parametrize("p,d,a", [(2, 2, 1), (2, 1, 2), (4, 1, 1)])
def test_every_row_on_one_process(spark, p, d, a):
    e = 16 // (p * d * a)
    rows = spark.range(16).select("id", *[c.alias(n) for n, c in batch.index_columns(F.col("id"), a, p, d, e).items()]).collect()
    assert len({(r.accumulation, r.process, r.device, r.example) for r in rows}) == 16 and {r.step for r in rows} == {0}
    assert all(r.id == ((r.accumulation * p + r.process) * d + r.device) * e + r.example for r in rows)


def test_cursor_resumes(spark):
    samples = spark.range(10).select(F.col("id").alias("sample_id"))
    start = cursor.Cursor(0, 0, 1, 4, 7, "words")
    every = cursor.take(samples, start, 8, 10).orderBy("epoch", "position").collect()
    later = cursor.Cursor.load(cursor.Cursor(0, 3, 1, 4, 7, "words").state(), start)
    rest = cursor.take(samples, later, 5, 10).orderBy("epoch", "position").collect()
    assert [(r.epoch, r.sample_id) for r in every[3:]] == [(r.epoch, r.sample_id) for r in rest]
    everyone = [r.sample_id for k in range(4) for r in cursor.take(samples, cursor.Cursor(0, 0, k, 4, 7, "words"), 3 if k < 2 else 2, 10).collect()]
    assert sorted(everyone) == list(range(10))
    with pytest.raises(ValueError):
        cursor.Cursor.load(start.state() | {"world_size": 2}, start)


def test_recipe_is_strict(spark):
    sections = '"model": {"architecture": "olmo2", "repo_id": "a", "revision": "b"}, "training": {"max_length": 8, "steps": 2, "peak_learning_rate": 1}, "run": {"output_dir": "o"}'
    data = '"repo_id": "a", "revision": "b", "split": "c", "adapter": "d"'
    texts = [f'{{"schema_version": {v}, "data": {{{data}{more}}}, {sections}{last}}}' for v, more, last in ((1, "", ""), (1, ', "split": "y"', ""), (1, ', "speed": 1', ""), (1, "", ', "more": 1'), (2, "", ""))]
    assert len(training_recipe.identity(training_recipe.resolve(json.loads(texts[0])))) == 64
    found = [r.r for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(training_recipe.resolved(F.col("text")).alias("r")).collect()]
    assert found[0].identity and all(r.error and not r.identity for r in found[1:])


def test_loss_closed_forms(spark):
    rows = spark.createDataFrame([([8.0, 0.0, 0.0], 0, 1.0)], "logits array<double>, target int, weight double")
    r = stats.loss_statistics(rows).first()
    assert math.isclose(r.numerator, math.log(math.exp(8) + 2) - 8) and r.denominator == 1
    zero = spark.createDataFrame([([0.0] * 4, 1, 0.5), ([0.0] * 4, 2, 1.5)], "logits array<double>, target int, weight double")
    r = stats.loss_statistics(zero).first()
    assert math.isclose(r.numerator, 2 * math.log(4)) and r.denominator == 2


def test_adamw_and_lora(spark):
    state = spark.createDataFrame([("m", 2, i, j, 1.0, 0.0, 0.0, 0.0) for i in range(2) for j in range(2)] + [("v", 1, i, 0, 1.0, 0.0, 0.0, 0.0) for i in range(2)], "path string, ndim int, i int, j int, value double, grad double, m double, v double")
    got = {r.path: r.value for r in params.adamw_step(state, 1, 0.1, params.AdamW(weight_decay=0.2)).collect()}
    assert math.isclose(got["m"], 0.98) and got["v"] == 1.0
    long = "path string, i int, j int, value double"
    w, a, b = (spark.createDataFrame(x, long) for x in ([("p", 0, 0, 1.0), ("q", 0, 0, 1.0)], [("p", 0, 0, 2.0)], [("p", 0, 0, 3.0)]))
    assert {r.path: r.value for r in params.merge_lora(w, a, b, 2.0, 1).collect()} == {"p": 13.0, "q": 1.0}
    faults = params.audit_targets(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "path string"), spark.createDataFrame([("a", 2), ("c", 1)], "path string, ndim int"))
    assert faults.count() == 3


def test_trajectory_stability(spark):
    flat = spark.createDataFrame([(k, 0.01) for k in range(5)], "step int, rel_error double")
    r = stats.stability(flat).first()
    assert r.steps == 5 and abs(r.slope) < 1e-12 and r.early_mean == r.late_mean


def test_event_log(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text('{"event": "step", "x": 1}\nnot json\n{"x": 2}\n{"event": 3}\n{"event": {"a": 1}}\n{"event": null}\n[1]\n')
    assert [r.event for r in tables.events(spark, str(path)).collect()] == ["step"]


def test_files_of_one_object(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text('{\n "id": "a",\n "prompt": "p",\n "completion": "c"\n}\n')
    assert tables.rows(spark, str(path), "prompt_completion", one_row=True).first().completion == "c"
    assert tables.manifest(spark, str(path), "id string").first().id == "a"


def test_streaming_counts(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    query = cursor.role_counts(cursor.read_messages(spark, folder)).writeStream.format("memory").queryName("roles").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("roles").collect()} == {tuple(r) for r in cursor.role_counts(source).collect()}


def test_more_text_more_tasks(spark, monkeypatch):
    """Tokens, many times as large as their messages, stay dealt by the size of the text and are not shuffled again."""
    monkeypatch.setattr(tables, "TASK_BYTES", 100)
    text = "one two three " * 10
    m = tables.message_table(spark.createDataFrame([(k, t, r, text) for k in range(20) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn int, role string, text string"))
    spans = render.qwen2_5_math(m)
    weighed = tokens.weigh(tokens.align(tokens.tokenize(render.documents(spans)), spans))
    assert weighed.rdd.getNumPartitions() == 40 * len(text) // 100
    found = truncate.loss_aware(weighed, 8)
    assert found.count() == 20
    assert "ENSURE_REQUIREMENTS" not in found._jdf.queryExecution().executedPlan().toString()
