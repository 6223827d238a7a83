"""Semantic units of tool exchanges: a call, its results, chained calls and the final answer stay together.

An exchange goes on as long as the message before is a call or a result, so units come from a look at the message before and a running
count, and every rule is a column of the message it can be seen at. A sample's reason is the rule that its earliest such message breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _again(messages: DataFrame, ids: str, name: str) -> DataFrame:
    """sample_id, message_index of messages that have an id of an earlier message, with the column name."""
    every = messages.select("sample_id", "message_index", F.explode(F.array_distinct(F.col(ids))).alias("id"))
    first = F.min("message_index").over(Window.partitionBy("sample_id", "id"))
    return every.where("id is not null").withColumn("first", first).where("first < message_index").select("sample_id", "message_index", F.lit(True).alias(name)).distinct()


def audited(messages: DataFrame) -> DataFrame:
    """messages(sample_id, message_index, role, call_ids, result_ids) with unit, in_exchange and fault, null for a sound message."""
    order = Window.partitionBy("sample_id").orderBy("message_index")
    rows = messages.select("sample_id", "message_index", "role", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("call_ids", "result_ids")])
    rows = rows.withColumns({"calls": F.size("call_ids") > 0, "tool": F.col("role") == "tool"})
    rows = rows.withColumn("open", F.col("calls") | F.col("tool"))
    rows = rows.withColumns({"goes_on": F.coalesce(F.lag("open").over(order), F.lit(False)), "last": F.lead("message_index").over(order).isNull()})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "unit": F.count_if(~F.col("goes_on")).over(upto) - 1, "segment": F.count_if("calls").over(upto),
        "pending": F.last(F.when(F.col("calls"), F.col("call_ids")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    # Results since the last call, this message's own left out.
    rows = rows.withColumn("answered_here", F.count_if("tool").over(Window.partitionBy("sample_id", "segment").orderBy("message_index").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("answered", F.coalesce(F.lag("answered_here").over(order), F.lit(0)))
    for ids, name in (("call_ids", "called_before"), ("result_ids", "answered_before")):
        rows = rows.join(_again(messages.where("role = 'tool'") if ids == "result_ids" else messages, ids, name), ["sample_id", "message_index"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    blank = lambda ids: yes(F.exists(ids, lambda x: F.coalesce(x, F.lit("")) == ""))
    own = F.get("result_ids", F.lit(0))
    fault = F.when(F.col("calls") & (F.col("role") != "assistant"), "a tool call is outside an assistant message").when(blank("call_ids"), "a tool call has no id")
    fault = fault.when(F.size(F.array_distinct("call_ids")) < F.size("call_ids"), "duplicate call ids in a message").when(yes(F.col("called_before")), "a call id is used again")
    fault = fault.when(F.col("tool") & ((F.size("result_ids") != 1) | blank("result_ids")), "a tool result has not exactly one id")
    fault = fault.when(F.col("tool") & ~F.col("goes_on"), "a result belongs to no call").when(F.col("tool") & ~yes(F.array_contains("pending", own)), "a result has an unknown id")
    fault = fault.when(F.col("tool") & yes(F.col("answered_before")), "duplicate results of a call")
    fault = fault.when(F.col("goes_on") & ~F.col("tool") & (F.col("answered") < F.size("pending")), "a call lacks its result")
    fault = fault.when(F.col("goes_on") & ~F.col("tool") & (F.col("role") != "assistant"), "a tool exchange has no final answer")
    complete = F.col("tool") & (F.col("answered_here") >= F.size("pending"))
    fault = fault.when(F.col("last") & F.col("open") & ~complete, "a call lacks its result").when(F.col("last") & F.col("open"), "a tool exchange has no final answer")
    return rows.select("sample_id", "message_index", "role", F.col("unit").cast("int"), (F.col("open") | F.col("goes_on")).alias("in_exchange"), fault.alias("fault"))


def rejections(messages: DataFrame) -> DataFrame:
    """sample_id, reason of samples whose calls and results do not fit."""
    return audited(messages).where("fault is not null").groupBy("sample_id").agg(F.min_by("fault", "message_index").alias("reason"))


def units_of_messages(messages: DataFrame) -> DataFrame:
    """sample_id, message_index, unit, tool_exchange of the messages of sound samples."""
    rows = audited(messages)
    by = Window.partitionBy("sample_id")
    sound = rows.withColumn("faults", F.count("fault").over(by)).where("faults = 0")
    return sound.select("sample_id", "message_index", "unit", F.max("in_exchange").over(Window.partitionBy("sample_id", "unit")).alias("tool_exchange"))


def tool_units(messages: DataFrame) -> DataFrame:
    """sample_id, unit, first_message, last_message, has_tool_call, reason of messages(sample_id, message_index, role, call_ids, result_ids);
    a rejected sample is one row with its reason."""
    own = units_of_messages(messages).groupBy("sample_id", "unit").agg(F.min("message_index").alias("first_message"), F.max("message_index").alias("last_message"), F.max("tool_exchange").alias("has_tool_call"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    bad = rejections(messages).select("sample_id", none("int", "unit"), none("int", "first_message"), none("int", "last_message"), none("boolean", "has_tool_call"), "reason")
    return own.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


def links(messages: DataFrame) -> DataFrame:
    """sample_id, call_id, occurrence, call_message, result_message of every call and every result of messages; a side without the other is null.

    The n-th call with an id belongs to the n-th result with it, in the order of messages and of their lists, so ids that come again meet once.
    """

    def side(ids: str, name: str) -> DataFrame:
        rows = messages.select("sample_id", F.col("message_index").alias(name), F.posexplode(ids).alias("at", "call_id"))
        nth = F.row_number().over(Window.partitionBy("sample_id", "call_id").orderBy(name, "at"))
        return rows.withColumn("occurrence", nth).drop("at")

    return side("call_ids", "call_message").join(side("result_ids", "result_message"), ["sample_id", "call_id", "occurrence"], "full_outer")
