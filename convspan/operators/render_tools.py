"""The chat template with tools, reasoning and tool calls, on samples in the message model.

Input is (sample_id, messages, tools) as the adapters make it; output has the span columns of render.py and part_index, part_kind,
call_id and tool_name. Only the formatting of JSON values, which follows Python's, runs in Python, on Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.operators.render import END, NO_THINK, START, STRIP, THINK, strip

#: Fixed values of the template.
TOOL_PREAMBLE = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
TOOL_INSTRUCTIONS = (
    "\n</tools>\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n<tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>\nvalue_1\n</parameter>\n"
    "<parameter=example_parameter_2>\nThis is the value for the second parameter\nthat can span\nmultiple lines\n</parameter>\n</function>\n</tool_call>\n\n<IMPORTANT>\nReminder:\n"
    "- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags\n- Required parameters MUST be specified\n"
    "- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after\n"
    "- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls\n</IMPORTANT>"
)
SPAN = "struct<span_class:string,text:string,default_weight:double,part_index:int,part_kind:string,call_id:string,tool_name:string>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parameters(arguments: pd.Series) -> pd.Series:
    """A call's JSON arguments, each as a parameter block, in the order given."""

    def blocks(text: str | None) -> list[str]:
        found = json.loads(text) if text else {}
        if not isinstance(found, dict):
            raise ValueError("tool-call arguments must be a mapping")
        shown = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v) for k, v in found.items()}
        return [f"<parameter={k}>\n{v}\n</parameter>\n" for k, v in shown.items()]

    return arguments.map(blocks)


@F.pandas_udf(T.StringType())
def _definition(name: pd.Series, description: pd.Series, parameters: pd.Series) -> pd.Series:
    """A tool's definition as JSON with a space after separators."""
    shown = [json.dumps({"type": "function", "function": {"name": n, "description": d or "", "parameters": json.loads(p) if p else {}}}, ensure_ascii=False) for n, d, p in zip(name, description, parameters, strict=True)]
    return pd.Series(shown)


def _span(span_class: str, text: Column, weight: float = 0.0, part: Column | None = None) -> Column:
    of = lambda name, kind: (F.lit(None) if part is None else part[name]).cast(kind).alias(name)
    return F.struct(F.lit(span_class).alias("span_class"), text.alias("text"), F.lit(weight).alias("default_weight"), of("part_index", "int"), (F.lit(None) if part is None else part["kind"]).cast("string").alias("part_kind"), of("call_id", "string"), of("tool_name", "string"))


def _one(when: Column, span: Column) -> Column:
    return F.when(when, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _chosen(*kinds: str) -> Column:
    """Parts of these kinds, numbered, each clipped to what a strip of their joined texts leaves."""
    numbered = F.transform("parts", lambda p, i: p.withField("part_index", i))
    own = F.filter(numbered, lambda p: p["kind"].isin(*kinds) & p["value"].isNotNull())
    whole = F.array_join(F.transform(own, lambda p: p["value"]), "")
    left = F.length(whole) - F.length(F.regexp_replace(whole, f"^{STRIP}", ""))
    right = left + F.length(strip(whole))
    before = lambda i: F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["value"]))
    begin = lambda i: F.greatest(left - before(i), F.lit(0))
    clip = lambda p, i: p.withField("value", F.substring(p["value"], begin(i) + 1, F.greatest(F.least(right - before(i), F.length(p["value"])) - begin(i), F.lit(0))))
    return F.transform(own, clip)


def _spans_of(parts: str, span_class: str, weight: float) -> Column:
    return F.transform(parts, lambda p: _span(span_class, p["value"], weight, p))


def errors(samples: DataFrame) -> DataFrame:
    """sample_id, error of samples that the template cannot show."""
    roles = F.transform("messages", lambda m: m["role"])
    kinds = F.flatten(F.transform("messages", lambda m: F.transform(m["parts"], lambda p: p["kind"])))
    nameless = F.exists("messages", lambda m: F.exists(m["parts"], lambda p: (p["kind"] == "tool_call") & (F.coalesce(p["tool_name"], F.lit("")) == "")))
    error = F.when(F.array_contains(roles, "developer"), "no developer role").when(F.array_contains(kinds, "media"), "text only").when(~F.array_contains(roles, "user"), "at least one user query is required")
    error = error.when(F.array_contains(F.slice(roles, F.lit(2), F.greatest(F.size(roles) - 1, F.lit(0))), "system"), "system message must be first").when(nameless, "a tool call needs a name")
    shown = lambda m: strip(F.array_join(F.transform(F.filter(m["parts"], lambda p: p["kind"].isin("text", "code")), lambda p: p["value"]), ""))
    query = lambda m: (m["role"] == "user") & ~(shown(m).startswith("<tool_response>") & shown(m).endswith("</tool_response>"))
    last = F.array_max(F.transform("messages", lambda m, i: F.when(query(m), i)))
    early = F.exists(F.transform("messages", lambda m, i: (m["role"] == "assistant") & (i <= last) & F.exists(m["parts"], lambda p: (p["kind"] == "reasoning") & (F.coalesce(p["value"], F.lit("")) != ""))), lambda x: x)
    error = error.when(last.isNull(), "at least one user query is required").when(F.coalesce(early, F.lit(False)), "reasoning before the last user query is not shown")
    return samples.select("sample_id", error.alias("error")).where("error is not null")


def qwen3_5_with_tools(samples: DataFrame) -> DataFrame:
    """Spans of samples without errors()."""
    by = Window.partitionBy("sample_id")
    m = samples.select("sample_id", F.coalesce(F.size("tools"), F.lit(0)).alias("n_tools"), F.posexplode("messages").alias("message_index", "m"))
    m = m.select("sample_id", "n_tools", "message_index", F.col("m.role").alias("role"), F.col("m.parts").alias("parts"))
    m = m.withColumns({"previous": F.lag("role").over(by.orderBy("message_index")), "following": F.lead("role").over(by.orderBy("message_index")), "content": _chosen("text", "code"), "thought": _chosen("reasoning"), "result": _chosen("text", "tool_result")})
    shown = F.array_join(F.transform("content", lambda p: p["value"]), "")
    m = m.withColumn("shown", shown)
    query = (F.col("role") == "user") & ~(F.col("shown").startswith("<tool_response>") & F.col("shown").endswith("</tool_response>"))
    m = m.withColumn("query", F.max(F.when(query, F.col("message_index"))).over(by))
    calls = F.filter(F.transform("parts", lambda p, i: p.withField("part_index", i)), lambda p: p["kind"] == "tool_call")
    # The arguments of all calls of a message are formatted beside each other and put back by position.
    one = m.select("sample_id", "message_index", F.posexplode(calls).alias("at", "call")).withColumn("blocks", _parameters("call.value"))
    prefix = F.when(F.col("at") > 0, "\n").when(F.col("shown") != "", "\n\n").otherwise("")
    one = one.join(m.select("sample_id", "message_index", "shown"), ["sample_id", "message_index"])
    own = F.concat(
        F.array(_span("tool_call_control", F.concat(prefix, F.lit("<tool_call>\n<function="), F.col("call.tool_name"), F.lit(">\n")), 1.0, F.col("call"))),
        F.transform("blocks", lambda b: _span("tool_call", b, 1.0, F.col("call"))), F.array(_span("tool_call_control", F.lit("</function>\n</tool_call>"), 1.0, F.col("call"))),
    )
    called = one.groupBy("sample_id", "message_index").agg(F.array_sort(F.collect_list(F.struct("at", own.alias("own")))).alias("all"))
    m = m.join(called.select("sample_id", "message_index", F.flatten(F.transform("all", lambda x: x["own"])).alias("calls")), ["sample_id", "message_index"], "left")
    is_ = {r: F.col("role") == r for r in ("system", "user", "assistant", "tool")}
    none = F.array().cast(f"array<{SPAN}>")
    think = is_["assistant"] & (F.col("message_index") > F.col("query"))
    spans = F.concat(
        _one(is_["user"] | is_["assistant"] | is_["system"] & (F.col("n_tools") == 0), _span("role_header", F.concat(F.lit(START), "role", F.lit("\n")))),
        _one(is_["system"] & (F.col("n_tools") > 0) & (F.col("shown") != ""), _span("template_control", F.lit("\n\n"))),
        _one(think, _span("reasoning_control", F.lit(THINK))), F.when(think, _spans_of("thought", "reasoning", 1.0)).otherwise(none), _one(think, _span("reasoning_control", F.lit(NO_THINK))),
        F.when(is_["assistant"], _spans_of("content", "content", 1.0)).when(is_["user"] | is_["system"], _spans_of("content", "content", 0.0)).otherwise(none),
        F.when(is_["assistant"], F.coalesce("calls", none)).otherwise(none), _one(is_["assistant"], _span("assistant_end", F.lit(END + "\n"), 1.0)), _one(is_["user"] | is_["system"], _span("turn_end", F.lit(END + "\n"))),
        _one(is_["tool"] & (F.coalesce("previous", F.lit("")) != "tool"), _span("role_header", F.lit(START + "user"))), _one(is_["tool"], _span("tool_result_control", F.lit("\n<tool_response>\n"))),
        F.when(is_["tool"], _spans_of("result", "tool_result", 0.0)).otherwise(none), _one(is_["tool"], _span("tool_result_control", F.lit("\n</tool_response>"))),
        _one(is_["tool"] & (F.coalesce("following", F.lit("")) != "tool"), _span("turn_end", F.lit(END + "\n"))),
    )
    body = m.select("sample_id", F.col("message_index").alias("message_index"), "role", F.posexplode(spans).alias("at", "span")).withColumn("order", F.struct(F.lit(1).alias("after_tools"), F.col("message_index").alias("number"), "at")).drop("at")
    # Before the messages: the tools, and the end of their turn unless a system message ends it.
    tools = samples.where(F.size("tools") > 0).select("sample_id", F.posexplode("tools").alias("at", "tool"), F.size("tools").alias("n"), (F.col("messages")[0]["role"] != "system").alias("alone"))
    tools = tools.withColumn("definition", _definition("tool.function.name", "tool.function.description", "tool.function.parameters"))
    head = F.concat(
        _one(F.col("at") == 0, _span("tool_preamble", F.lit(START + "system\n" + TOOL_PREAMBLE))), F.array(_span("tool_definition", F.concat(F.lit("\n"), "definition"))),
        _one(F.col("at") + 1 == F.col("n"), _span("tool_preamble", F.lit(TOOL_INSTRUCTIONS))), _one((F.col("at") + 1 == F.col("n")) & F.col("alone"), _span("turn_end", F.lit(END + "\n"))),
    )
    first = tools.select("sample_id", F.lit(None).cast("int").alias("message_index"), F.lit("system").alias("role"), F.col("at").alias("number"), F.posexplode(head).alias("at", "span"))
    first = first.withColumn("order", F.struct(F.lit(0).alias("after_tools"), "number", "at")).drop("number", "at")
    every = body.unionByName(first).where("length(span.text) > 0")
    index = F.row_number().over(by.orderBy("order")) - 1
    return every.select("sample_id", index.alias("span_index"), "message_index", "role", "span.*")


def dropped_parts(samples: DataFrame) -> DataFrame:
    """sample_id, message_index, part_index, kind of parts that the template passes over in silence."""
    p = samples.select("sample_id", F.posexplode("messages").alias("message_index", "m")).select("sample_id", "message_index", F.col("m.role").alias("role"), F.posexplode("m.parts").alias("part_index", "p"))
    kinds = {"system": ("text", "code"), "user": ("text", "code"), "assistant": ("text", "code", "reasoning", "tool_call"), "tool": ("text", "tool_result")}
    shown = F.lit(False)
    for role, own in kinds.items():
        shown |= (F.col("role") == role) & F.col("p.kind").isin(*own)
    return p.where(~shown).select("sample_id", "message_index", "part_index", "p.kind")
