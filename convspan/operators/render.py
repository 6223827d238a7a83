"""Messages to annotated text spans, one row per span, under three chat templates.

Input is the message table (sample_id, message_index, role, text, n_messages); every span is
(sample_id, span_index, message_index, span_class, role, text, default_weight), spans in the order of the rendered text, empty ones left
out. Long form: a sample's spans follow each other by span_index and their texts join to the rendered text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the templates.
BOS = "<|endoftext|>"
START, END = "<|im_start|>", "<|im_end|>"
MATH_SYSTEM = "<|im_start|>system\nPlease reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n"
THINK = "<think>\n"
NO_THINK = "\n</think>\n\n"
#: The white space that a template's strip removes: all of Unicode's, and the separators 1C to 1F.
STRIP = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{STRIP}|{STRIP}$", "")


def span(span_class: str, text: Column, weight: Column | float = 0.0) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(F.lit(span_class).alias("span_class"), text.alias("text"), weight.alias("default_weight"))


def spans_of(messages: DataFrame, each: list[Column], first: Column | None, generation: str = "") -> DataFrame:
    """The spans of every message, before the first message of a sample one that no message owns, and behind the last the start of an answer."""
    own = messages.select("sample_id", "message_index", "role", F.posexplode(F.array(*each)).alias("at", "span"))
    own = own.withColumn("message", F.col("message_index").cast("long"))
    edge = lambda where, role, text, message: messages.where(where).select("sample_id", F.lit(None).cast("int").alias("message_index"), F.lit(role).cast("string").alias("role"), F.lit(0).alias("at"), text.alias("span"), message.cast("long").alias("message"))
    if first is not None:
        own = own.unionByName(edge("message_index = 0", None, first, F.lit(-1)))
    if generation:
        own = own.unionByName(edge("message_index + 1 = n_messages", "assistant", span("generation_prompt", F.lit(generation)), F.col("n_messages")))
    own = own.where("length(span.text) > 0")
    index = F.row_number().over(Window.partitionBy("sample_id").orderBy("message", "at")) - 1
    return own.select("sample_id", index.alias("span_index"), "message_index", F.col("span.span_class").alias("span_class"), "role", F.col("span.text").alias("text"), F.col("span.default_weight").alias("default_weight"))


def _by_assistant() -> Column:
    return F.when(F.col("role") == "assistant", 1.0).otherwise(0.0)


def olmo2_instruct(messages: DataFrame, generation_prompt: bool = False) -> DataFrame:
    """Begin token; per message a role header, the untrimmed text, and an end."""
    last = F.col("message_index") + 1 == F.col("n_messages")
    assistant = F.col("role") == "assistant"
    end = F.when(assistant, F.concat(F.lit(BOS), F.when(last, "").otherwise("\n"))).otherwise("\n")
    each = [span("role_header", F.concat(F.lit("<|"), "role", F.lit("|>\n"))), span("content", F.col("text"), _by_assistant()), span("assistant_end", F.when(assistant, end).otherwise(""), 1.0), span("turn_end", F.when(assistant, "").otherwise(end))]
    return spans_of(messages, each, span("bos", F.lit(BOS)), "<|assistant|>\n" if generation_prompt else "")


def qwen2_5_math(messages: DataFrame, generation_prompt: bool = False) -> DataFrame:
    """A default system turn unless the sample brings one; the assistant's end marker carries weight, the line feed after it none."""
    assistant = F.col("role") == "assistant"
    each = [
        span("role_header", F.concat(F.lit(START), "role", F.lit("\n"))), span("content", F.col("text"), _by_assistant()),
        span("assistant_end", F.when(assistant, END).otherwise(""), 1.0), span("turn_end", F.when(assistant, "").otherwise(END)), span("turn_end", F.lit("\n")),
    ]
    return spans_of(messages, each, span("template_control", F.when(F.col("role") != "system", MATH_SYSTEM).otherwise("")), START + "assistant\n" if generation_prompt else "")


def qwen3_5(messages: DataFrame, generation_prompt: bool = False, thinking: bool = False) -> DataFrame:
    """Plain chat: trimmed texts; after the last user query an assistant turn opens with an empty thinking block.

    Samples that plain_refusals has, such as one without a user query, have no spans.
    """
    query = (F.col("role") == "user") & ~(strip(F.col("text")).startswith("<tool_response>") & strip(F.col("text")).endswith("</tool_response>"))
    last = F.max(F.when(query, F.col("message_index"))).over(Window.partitionBy("sample_id"))
    late = F.max((F.col("role") == "system") & (F.col("message_index") > 0)).over(Window.partitionBy("sample_id"))
    rows = messages.withColumns({"query": last, "late": late}).where("query is not null and not late")
    assistant = F.col("role") == "assistant"
    think = assistant & (F.col("message_index") > F.col("query"))
    each = [
        span("role_header", F.concat(F.lit(START), "role", F.lit("\n"))), span("reasoning_control", F.when(think, THINK).otherwise("")), span("reasoning_control", F.when(think, NO_THINK).otherwise("")),
        span("content", strip(F.col("text")), _by_assistant()), span("assistant_end", F.when(assistant, END + "\n").otherwise(""), 1.0), span("turn_end", F.when(assistant, "").otherwise(END + "\n")),
    ]
    return spans_of(rows, each, None, START + "assistant\n" + THINK + ("" if thinking else NO_THINK) if generation_prompt else "")


RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {"olmo2_instruct": olmo2_instruct, "qwen2_5_math": qwen2_5_math, "qwen3_5_text": qwen3_5}


#: Short names of renderers.
SHORT_NAMES = {"olmo2": "olmo2_instruct", "qwen2": "qwen2_5_math", "qwen3_5": "qwen3_5_text"}


def get_renderer(name: str) -> Callable[[DataFrame], DataFrame]:
    name = SHORT_NAMES.get(name, name)
    if name not in RENDERERS:
        raise KeyError(f"unknown renderer {name!r}; known: {sorted(RENDERERS)}")
    return RENDERERS[name]


#: Roles and kinds of parts that a template without tools can show.
TEXT_ROLES, TEXT_PARTS = ("system", "user", "assistant"), ("text", "code")


def text_template_errors(samples: DataFrame, renderer: str = "olmo2_instruct") -> DataFrame:
    """sample_id, error of samples(sample_id, messages, tools) in the message model that a template without tools would not show whole.

    The plain chat template also wants a user query, and a system message first.
    """
    roles = F.transform("messages", lambda m: m["role"])
    kinds = F.flatten(F.transform("messages", lambda m: F.transform(m["parts"], lambda p: p["kind"])))
    error = F.when(F.coalesce(F.size("tools"), F.lit(0)) > 0, "the template has no tool definitions").when(F.exists(roles, lambda r: ~r.isin(*TEXT_ROLES)), "the template has no such role")
    error = error.when(F.exists(kinds, lambda k: ~k.isin(*TEXT_PARTS)), "the template shows text only")
    if SHORT_NAMES.get(renderer, renderer) == "qwen3_5_text":
        shown = lambda m: strip(F.array_join(F.transform(m["parts"], lambda p: p["value"]), ""))
        query = lambda m: (m["role"] == "user") & ~(shown(m).startswith("<tool_response>") & shown(m).endswith("</tool_response>"))
        error = error.when(~F.exists("messages", query), "at least one user query is required").when(F.array_contains(F.slice(roles, F.lit(2), F.greatest(F.size(roles) - 1, F.lit(0))), "system"), "system message must be first")
    return samples.select("sample_id", error.alias("error")).where("error is not null")


def plain_refusals(messages: DataFrame) -> DataFrame:
    """sample_id, error of the samples of a message table that the plain chat template refuses."""
    text = strip(F.col("text"))
    query = (F.col("role") == "user") & ~(text.startswith("<tool_response>") & text.endswith("</tool_response>"))
    late = (F.col("role") == "system") & (F.col("message_index") > 0)
    found = messages.groupBy("sample_id").agg(F.count_if(query).alias("queries"), F.count_if(late).alias("late"))
    error = F.when(F.col("queries") == 0, "at least one user query is required").when(F.col("late") > 0, "system message must be first")
    return found.select("sample_id", error.alias("error")).where("error is not null")


def documents(spans: DataFrame) -> DataFrame:
    """sample_id, text: the rendered text of each sample."""
    parts = F.array_sort(F.collect_list(F.struct("span_index", "text")))
    return spans.groupBy("sample_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def template_hash(renderer: str, version: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(renderer), F.lit(str(version)), text), 256)


def renderer_identity(name: str, version: int = 1, **options: object) -> str:
    """Hash of what decides how a renderer shows a sample: its name, version and options, whatever their order."""
    if name not in RENDERERS and SHORT_NAMES.get(name) not in RENDERERS:
        raise KeyError(f"unknown renderer {name!r}")
    text = json.dumps({"renderer": SHORT_NAMES.get(name, name), "version": version, "options": options}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(b"convspan-renderer\0" + text.encode()).hexdigest()


def ranges(spans: DataFrame) -> DataFrame:
    """Spans with the character range [left, right) that each covers in its sample's text."""
    before = Window.partitionBy("sample_id").orderBy("span_index").rowsBetween(Window.unboundedPreceding, 0)
    right = F.sum(F.length("text")).over(before)
    return spans.withColumn("right", right).withColumn("left", F.col("right") - F.length("text"))
