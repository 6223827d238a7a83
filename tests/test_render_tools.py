"""The template with tools against a hand-written text."""

import json

from convspan.operators import adapters, render, render_tools
from convspan.sources import tables

TOOL = {"type": "function", "function": {"name": "weather", "description": "Look up", "parameters": '{"type": "object", "properties": {"city": {"type": "string"}}}'}}


def call(number, arguments):
    return {"id": f"c{number}", "type": "function", "function": {"name": "weather", "arguments": json.dumps(arguments)}}


ROW = {
    "id": "a",
    "tools": [TOOL],
    "messages": [
        {"role": "system", "content": "  Be brief. "}, {"role": "user", "content": "Oslo and Rome?\n"},
        {"role": "assistant", "reasoning_content": " look up ", "content": "Looking.", "tool_calls": [call(1, {"city": "Oslo", "days": 2, "deep": True, "x": None}), call(2, {"city": "Rømø", "list": [1, "a"]})]},
        {"role": "tool", "content": "12", "tool_call_id": "c1"}, {"role": "tool", "content": " 20 ", "tool_call_id": "c2"}, {"role": "assistant", "content": "Cold, warm."},
    ],
}


def test_full_text(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps(ROW))
    samples = adapters.messages_adapter(tables.rows(spark, str(path), "messages")).withColumnRenamed("id", "sample_id")
    assert render_tools.errors(samples).count() == 0 and render_tools.dropped_parts(samples).count() == 0
    spans = render_tools.qwen3_5_with_tools(samples)
    definition = '{"type": "function", "function": {"name": "weather", "description": "Look up", "parameters": {"type": "object", "properties": {"city": {"type": "string"}}}}}'
    wanted = (
        "<|im_start|>system\n" + render_tools.TOOL_PREAMBLE + "\n" + definition + render_tools.TOOL_INSTRUCTIONS + "\n\nBe brief.<|im_end|>\n<|im_start|>user\nOslo and Rome?<|im_end|>\n"
        "<|im_start|>assistant\n<think>\nlook up\n</think>\n\nLooking.\n\n<tool_call>\n<function=weather>\n<parameter=city>\nOslo\n</parameter>\n<parameter=days>\n2\n</parameter>\n<parameter=deep>\nTrue\n</parameter>\n"
        "<parameter=x>\nNone\n</parameter>\n</function>\n</tool_call>\n<tool_call>\n<function=weather>\n<parameter=city>\nRømø\n</parameter>\n<parameter=list>\n[1, \"a\"]\n</parameter>\n</function>\n</tool_call><|im_end|>\n"
        "<|im_start|>user\n<tool_response>\n12\n</tool_response>\n<tool_response>\n20\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nCold, warm.<|im_end|>\n"
    )
    assert render.documents(spans).first().text == wanted
    weighted = {r.span_class for r in spans.where("default_weight > 0").collect()}
    assert weighted == {"content", "reasoning", "tool_call", "tool_call_control", "assistant_end"}
    assert {r.call_id for r in spans.where("span_class = 'tool_call'").collect()} == {"c1", "c2"}


def test_plain_chat_agrees_with_the_plain_renderer(spark):
    m = spark.createDataFrame([("s", 0, "system", " s ", 3), ("s", 1, "user", "　 hi\n", 3), ("s", 2, "assistant", "yo", 3)], "sample_id string, message_index int, role string, text string, n_messages long")
    part = "array(struct('text' as kind, text as value, cast(null as string) as call_id, cast(null as string) as tool_name))"
    samples = m.selectExpr("sample_id", "message_index", "role", f"{part} as parts").groupBy("sample_id").agg({"message_index": "max"}).drop("max(message_index)")
    messages = m.selectExpr("sample_id", f"named_struct('i', message_index, 'role', role, 'parts', {part}) as x").groupBy("sample_id").agg({"x": "collect_list"}).withColumnRenamed("collect_list(x)", "x")
    samples = samples.join(messages, "sample_id").selectExpr("sample_id", "transform(array_sort(x), y -> named_struct('role', y.role, 'parts', y.parts)) as messages", f"cast(null as array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>) as tools")
    assert render.documents(render_tools.qwen3_5_with_tools(samples)).first().text == render.documents(render.qwen3_5(m)).first().text


def test_errors(spark):
    schema = "sample_id string, messages array<struct<role:string,parts:array<struct<kind:string,value:string,call_id:string,tool_name:string>>>>, tools array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>"
    text = [("text", "x", None, None)]
    rows = [("dev", [("developer", text)], None), ("none", [("assistant", text)], None), ("late", [("user", text), ("system", text)], None), ("call", [("user", text), ("assistant", [("tool_call", "{}", "c", "")])], None), ("ok", [("user", text)], None)]
    rows += [("early", [("user", text), ("assistant", [("reasoning", "hm", None, None)]), ("user", text)], None), ("answer", [("user", [("text", " <tool_response>x</tool_response>", None, None)])], None), ("thought", [("user", text), ("assistant", [("reasoning", "hm", None, None)])], None)]
    assert {r.sample_id for r in render_tools.errors(spark.createDataFrame(rows, schema)).collect()} == {"dev", "none", "late", "call", "early", "answer"}


def test_calls_of_many_arguments(spark, tmp_path):
    """Spans stand in the order of their messages, however many a message has."""
    n = 1500
    row = {"id": "many", "tools": [TOOL] * 3, "messages": [{"role": "user", "content": "?"}, {"role": "assistant", "content": "x", "tool_calls": [call(1, {f"p{k}": k for k in range(n)})]}, {"role": "tool", "content": "RESULT", "tool_call_id": "c1"}, {"role": "assistant", "content": "done"}]}
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps(row))
    samples = adapters.get_adapter("messages")(tables.rows(spark, str(path), "messages")).withColumnRenamed("id", "sample_id")
    text = render.documents(render_tools.qwen3_5_with_tools(samples)).first().text
    parameters = "".join(f"<parameter=p{k}>\n{k}\n</parameter>\n" for k in range(n))
    assert f"<function=weather>\n{parameters}</function>\n</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\nRESULT\n</tool_response><|im_end|>\n" in text
    assert text.startswith("<|im_start|>system\n" + render_tools.TOOL_PREAMBLE + "\n{") and text.count('{"type": "function"') == 3 and text.index(render_tools.TOOL_INSTRUCTIONS) < text.index("<|im_start|>user")
