"""Messages whose content is a string, null, or a list of typed blocks, as public chat and tool-use sets have it.

Rows have messages (and tools) as arrays of structs with any of the fields of ROW; fields that are missing count as null, role may be
called from and content value. Content is a string or a variant, so a string that looks like a list stays a string. Arguments and
parameters are text of JSON, which keeps the order of keys, or variants. A row that breaks a rule has a reason and no messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from convspan.operators.roles import role_of

#: The names that block types go by.
TEXT, REASONING, CALL, RESULT, MEDIA = ("text", "output_text", "input_text"), ("thinking", "reasoning"), ("tool_use", "tool_call"), ("tool_result",), ("image", "image_url", "video")
CALLS = "array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
#: Schema of the JSON of a row. A call's name and arguments may stand in a function or beside its id; arguments may be an object or a string of JSON, read alike.
ROW = f"messages array<struct<role:string,name:string,content:variant,reasoning_content:variant,tool_calls:{CALLS},tool_call_id:string,call_id:string>>, tools array<struct<name:string,description:string,parameters:string,function:struct<name:string,description:string,parameters:string>>>"
PART = "struct<kind:string,value:string,call_id:string,tool_name:string,fault:string>"


def _fields(kind: T.DataType) -> dict[str, T.DataType]:
    """Fields of a struct, or of the structs of an array."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def _completed(value: Column, have: dict[str, T.DataType], want: dict[str, T.DataType], other: dict[str, str]) -> Column:
    """A struct with all wanted fields: those that it has, under their name or another, else null."""

    def one(name: str, kind: T.DataType) -> Column:
        own = [c for c in (name, other.get(name)) if c in have]
        found = [F.lit(None).cast(kind) if isinstance(have[c], T.NullType) else _shaped(value[c], have[c], kind, other) for c in own]
        return (F.coalesce(*found) if found else F.lit(None).cast(kind)).alias(name)

    return F.struct(*[one(name, kind) for name, kind in want.items()])


def _shaped(value: Column, have: T.DataType, want: T.DataType, other: dict[str, str]) -> Column:
    if isinstance(want, T.StructType):
        return F.when(value.isNotNull(), _completed(value, _fields(have), _fields(want), other))
    if isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _shaped(x, have.elementType, want.elementType, other))
    if isinstance(want, T.StringType) and isinstance(have, T.VariantType):
        return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).when(_kind(value) != "VOID", F.to_json(value))
    return value if have == want else value.cast(want)


def completed(rows: DataFrame) -> DataFrame:
    """rows whose messages and tools have all fields of ROW."""
    want = {f.name: f.dataType for f in T._parse_datatype_string(ROW).fields}
    have = {f.name: f.dataType for f in rows.schema.fields}
    for name, kind in want.items():
        known = name in have and isinstance(have[name], T.ArrayType)
        rows = rows.withColumn(name, _shaped(F.col(name), have[name], kind, {"role": "from", "content": "value"}) if known else F.lit(None).cast(kind))
    return rows


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """What a variant holds: STRING, ARRAY<...>, OBJECT<...>, VOID, or null if it is not there."""
    return F.schema_of_variant(v)


def _is_string(v: Column, path: str) -> Column:
    """Whether a path of a variant leads to a string."""
    return F.coalesce(_kind(_get(v, path, "variant")) == "STRING", F.lit(False))


def _part(kind: str, value: Column, call_id: Column | None = None, tool_name: Column | None = None, fault: Column | None = None) -> Column:
    of = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), of(call_id).alias("call_id"), of(tool_name).alias("tool_name"), of(fault).alias("fault"))


def _identifier(v: Column, path: str) -> Column:
    """A fault if an identifier is there and no text with characters."""
    there = _get(v, path, "variant")
    return F.when(there.isNotNull() & (_kind(there) != "VOID") & ((_kind(there) != "STRING") | (F.coalesce(_get(v, path), F.lit("")) == "")), "an identifier must be a non-empty string")


def _block(b: Column) -> Column:
    """A block as a part; its fault if it breaks a rule."""
    kind = F.coalesce(_get(b, "$.type"), F.lit(""))
    arguments = F.coalesce(_get(b, "$.input", "variant"), _get(b, "$.arguments", "variant"))
    shown = F.coalesce(F.to_json(arguments), F.lit("{}"))
    thought = F.when(_get(b, "$.thinking", "variant").isNotNull(), F.lit("$.thinking")).otherwise(F.lit("$.text"))
    is_thought = F.when(thought == "$.thinking", _is_string(b, "$.thinking")).otherwise(_is_string(b, "$.text"))
    return (
        F.when(~F.coalesce(_kind(b).startswith("OBJECT"), F.lit(False)), _part("text", F.lit(None), fault=F.lit("a block must be a mapping")))
        .when(kind.isin(*TEXT), _part("text", _get(b, "$.text"), fault=F.when(~_is_string(b, "$.text"), "a text block needs a string")))
        .when(kind.isin(*REASONING), _part("reasoning", F.coalesce(_get(b, "$.thinking"), _get(b, "$.text")), fault=F.when(~is_thought, "a reasoning block needs a string")))
        .when(kind.isin(*CALL), _part("tool_call", shown, _get(b, "$.id"), _get(b, "$.name"), F.when(~_is_string(b, "$.name") | (F.coalesce(_get(b, "$.name"), F.lit("")) == ""), "a call needs a name").otherwise(_identifier(b, "$.id"))))
        .when(kind.isin(*RESULT), _part("tool_result", _get(b, "$.content"), _get(b, "$.tool_use_id"), fault=F.when(~_is_string(b, "$.content"), "a result block needs a string").otherwise(_identifier(b, "$.tool_use_id"))))
        .when(kind.isin(*MEDIA), _part("media", F.to_json(b)))
        .otherwise(_part("text", F.lit(None), fault=F.lit("a block has an unsupported type")))
    )


def _compact(json: Column) -> Column:
    """JSON text without the white space outside its strings; keys keep their order and numbers their digits."""
    return F.regexp_replace(json, r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")


def _call(c: Column) -> Column:
    """An entry of tool_calls as a part."""
    name, arguments = F.when(c["function"].isNotNull(), c["function"]["name"]).otherwise(c["name"]), F.when(c["function"].isNotNull(), c["function"]["arguments"]).otherwise(c["arguments"])
    value = F.coalesce(_compact(arguments), F.lit("{}"))
    fault = F.when(F.coalesce(name, F.lit("")) == "", "a call needs a name").when(F.try_parse_json(value).isNull(), "arguments are invalid JSON").when(F.coalesce(c["id"], F.lit("x")) == "", "an identifier must be a non-empty string")
    return _part("tool_call", value, c["id"], name, fault)


def _message(m: Column) -> Column:
    role = role_of(m["role"])
    none = F.array().cast(f"array<{PART}>")
    kind = F.coalesce(_kind(m["content"]), F.lit("VOID"))
    text = _get(m["content"], "$")
    content = F.when(kind == "STRING", F.array(F.when(role == "tool", _part("tool_result", text)).otherwise(_part("text", text)))).when(kind.startswith("ARRAY"), F.transform(_get(m["content"], "$", "array<variant>"), _block)).otherwise(none)
    thought_kind = F.coalesce(_kind(m["reasoning_content"]), F.lit("VOID"))
    thought = F.when(thought_kind != "VOID", F.array(_part("reasoning", _get(m["reasoning_content"], "$"), fault=F.when((role != "assistant") | (thought_kind != "STRING"), "reasoning belongs to an assistant and is a string")))).otherwise(none)
    call = F.coalesce(m["tool_call_id"], m["call_id"])
    linked = F.transform(F.concat(thought, content, F.coalesce(F.transform(m["tool_calls"], _call), none)), lambda p: F.when(
        (role == "tool") & (p["kind"] == "tool_result"),
        p.withField("fault", F.coalesce(p["fault"], F.when(p["call_id"] != call, "conflicting call ids of a result"))).withField("call_id", F.coalesce(p["call_id"], call)),
    ).otherwise(p))
    fault = F.when(role.isNull(), "unknown message role").when((kind != "STRING") & ~kind.startswith("ARRAY") & (kind != "VOID"), "content must be a string, null or a list of blocks")
    fault = fault.when((call == "") | (m["name"] == ""), "an identifier must be a non-empty string")
    return F.struct(role.alias("role"), m["name"].alias("name"), call.alias("call_id"), linked.alias("parts"), fault.alias("fault"))


def typed_messages_adapter(rows: DataFrame) -> DataFrame:
    """rows with reason, and messages and tools in the message model: the earliest message's earliest fault is the reason."""
    model = completed(rows).withColumn("messages", F.transform("messages", _message))
    faults = F.flatten(F.transform("messages", lambda m: F.concat(F.array(m["fault"]), F.transform(m["parts"], lambda p: p["fault"]))))
    tool = lambda t, c: F.coalesce(t["function"][c], t[c])
    tools = F.transform("tools", lambda t: F.struct(F.lit("function").alias("type"), F.struct(tool(t, "name").alias("name"), tool(t, "description").alias("description"), F.coalesce(tool(t, "parameters"), F.lit("{}")).alias("parameters")).alias("function")))
    nameless = F.coalesce(F.exists("tools", lambda t: F.coalesce(tool(t, "name"), F.lit("")) == ""), F.lit(False))
    shapeless = F.coalesce(F.exists("tools", lambda t: ~F.coalesce(_kind(F.try_parse_json(F.coalesce(tool(t, "parameters"), F.lit("{}")))), F.lit("VOID")).startswith("OBJECT")), F.lit(False))
    reason = F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages must be a non-empty list")
    reason = F.coalesce(reason, F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0)), F.when(nameless, "a tool needs a name").when(shapeless, "a tool's parameters must be a mapping"))
    shown = F.transform("messages", lambda m: m.withField("parts", F.transform(m["parts"], lambda p: p.dropFields("fault"))).dropFields("fault"))
    found = model.withColumn("reason", reason).withColumn("tools", tools)
    return found.withColumn("messages", F.when(F.col("reason").isNull(), shown))
