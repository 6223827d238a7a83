"""Truncation of weighed token sequences to a length: plain, by weight, and by weight between message boundaries.

All work on the long table (sample_id, pos, weight, ...) and return one row per sample with the window [start, stop) that stays. Scores
are sums of weights after a window's first token, which never counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sizes(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("weight") > 0).alias("selected"))


def plain(weighed: DataFrame, length: int, side: str) -> DataFrame:
    """The head (right), the tail (left), or nothing of longer samples (reject)."""
    n = F.col("n_tokens")
    start = {"right": F.lit(0), "left": F.greatest(n - length, F.lit(0)), "reject": F.lit(0)}[side]
    stop = {"right": F.least(n, F.lit(length)), "left": n, "reject": F.when(n <= length, n).otherwise(0)}[side]
    return sizes(weighed).select("sample_id", "n_tokens", start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def _starts(weighed: DataFrame, length: int, min_context: int, keep: tuple[str, ...], candidates: bool) -> DataFrame:
    """Every token as the start of a window, with what the window has and best, a struct that is greatest for the best one; only tokens that
    may start one if candidates, else the others have a null best.

    Running sums, and their values length - 1 rows ahead, give every start's score.
    """
    by = Window.partitionBy("sample_id")
    up = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    order = by.orderBy("pos")
    positive = F.when(F.col("weight") > 0, F.col("pos"))
    rows = weighed.select("sample_id", "pos", "weight", *keep, F.count(F.lit(1)).over(by).alias("n_tokens"), F.min(positive).over(down).alias("next"), F.sum("weight").over(up).alias("total"), F.max(positive).over(up).alias("latest"), F.count(positive).over(up).alias("seen"))
    ahead = {c: F.lead(c, length - 1).over(order) for c in ("total", "latest", "seen")} if length > 1 else {}
    last = {c: F.last(c).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("total", "latest", "seen")}
    rows = rows.select("sample_id", "pos", "weight", "n_tokens", "next", *keep, *[F.col(c).alias(f"{c}_here") for c in ("total", "seen")], *[F.when(F.col("n_tokens") <= length, last[c]).otherwise(ahead.get(c, F.col(c))).alias(c) for c in ("total", "latest", "seen")])
    may = (F.col("pos") + length <= F.col("n_tokens")) | (F.col("pos") == 0)
    rows = rows.where(may) if candidates else rows
    stop = F.least(F.col("pos") + length, F.col("n_tokens"))
    score, selected = F.col("total") - F.col("total_here"), F.col("seen") - F.col("seen_here")
    context = F.when(selected > 0, F.col("next") - F.col("pos")).otherwise(0)
    enough = ((context >= min_context) & (selected > 0)).cast("int")
    best = F.when(may, F.struct(enough.alias("enough"), score.alias("score"), F.when(selected > 0, F.col("latest")).otherwise(-1).alias("latest"), (-F.col("pos")).alias("back"), stop.alias("stop"), selected.alias("selected"), context.alias("context")))
    return rows.withColumn("best", best)


def within_loss_aware(weighed: DataFrame, length: int, min_context: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, pos, weight, columns of keep, from, to of the tokens in their sample's window by loss_aware, [from, to): tokens and window
    come from one sort of a sample's tokens, without a join."""
    rows = _starts(weighed, length, min_context, keep, False).withColumn("best", F.max("best").over(Window.partitionBy("sample_id")))
    rows = rows.select("sample_id", "pos", "weight", *keep, (-F.col("best.back")).alias("from"), F.col("best.stop").alias("to"))
    return rows.where("pos >= from and pos < to")


def loss_aware(weighed: DataFrame, length: int, min_context: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, n_tokens, start, stop, selected, context, relaxed of the window with the greatest score.

    Ties go to the latest last weighted token, then to the earliest start. Windows with fewer than min_context tokens before their
    first weighted one count only if there is no other (relaxed). Columns of keep, which are alike on all of a sample's tokens, come along.
    """
    rows = _starts(weighed, length, min_context, keep, True)
    picked = rows.groupBy("sample_id").agg(F.max(F.struct("best", "n_tokens", *keep)).alias("b")).select("sample_id", "b.n_tokens", "b.best.*", *[F.col("b")[c].alias(c) for c in keep])
    relaxed = (F.col("n_tokens") > length) & (F.col("selected") > 0) & (F.col("context") < min_context)
    return picked.select("sample_id", "n_tokens", (-F.col("back")).cast("long").alias("start"), F.col("stop").cast("long"), "selected", F.col("context").cast("long"), relaxed.alias("relaxed"), *keep)


def message_blocks(weighed: DataFrame) -> DataFrame:
    """sample_id, block, start, stop, first and last weighted position and sums of each message's run of tokens.

    Tokens that no message owns belong to the message on their left, leading ones to the first message. That one is found once a sample:
    a frame from each row to the end would be read anew for every token, the square of a sample's tokens.
    """
    by = Window.partitionBy("sample_id").orderBy("pos")
    owner = F.coalesce(F.last("message_index", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first("message_index", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = weighed.withColumn("block", owner)
    positive = F.when(F.col("weight") > 0, F.col("pos"))
    first = F.col("weight") * (F.col("pos") == F.min("pos").over(Window.partitionBy("sample_id", "block"))).cast("int")
    return rows.withColumn("head", first).groupBy("sample_id", "block").agg(
        F.min("pos").cast("long").alias("start"), (F.max("pos") + 1).cast("long").alias("stop"), F.sum("weight").alias("weight"), F.sum("head").alias("head"),
        F.min(positive).alias("first"), F.max(positive).alias("last"), F.min(F.when(F.col("head") == 0, positive)).alias("second"), F.count(positive).alias("selected"),
    )


def ownership_faults(weighed: DataFrame) -> DataFrame:
    """sample_id, fault of samples in which a message owns two runs of tokens, or messages are out of order, or none owns any."""
    by = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = weighed.withColumn("most", F.max("message_index").over(by))
    seen = rows.groupBy("sample_id").agg(F.count("message_index").alias("owned"), F.count_if(F.col("message_index") < F.col("most")).alias("back"))
    fault = F.when(F.col("owned") == 0, "no message owns a token").when(F.col("back") > 0, "a message does not own one run of tokens in order")
    return seen.select("sample_id", fault.alias("fault")).where("fault is not null")


def semantic_loss_aware(weighed: DataFrame, length: int, units: DataFrame | None = None, min_context: int = 0) -> DataFrame:
    """The best run of whole units within length: sample_id, start, stop, first_block, last_block, score, context, relaxed, n_units, kept_units,
    n_exchanges, kept_exchanges; start to score null if there is none.

    A unit is a message, or what units(sample_id, message_index, unit, tool_exchange) puts together; its messages follow each other.
    Samples that units lacks are left out. Ties go to the latest weighted token, the greatest context, the longest run, the earliest
    start. Runs without weight after their first token are skipped if the sample has any weight; runs with less than min_context
    tokens before their first weighted one count only if there is no other (relaxed). If tokens that no message owns are of the class
    tool_preamble or tool_definition, a run that leaves out the first unit, and so them, holds no tool exchange.

    As weights are not negative, of the runs from one start only the longest can be best. Where it ends, and the sums up to there, are
    windows over the starts in reach, so a sample costs a sort and no unit meets another.
    """
    blocks = message_blocks(weighed)
    if units is None:
        blocks = blocks.withColumns({"unit": F.col("block"), "tool_exchange": F.lit(False)})
    else:
        blocks = blocks.join(units.select("sample_id", F.col("message_index").alias("block"), "unit", "tool_exchange"), ["sample_id", "block"])
    first = lambda c: F.min_by(c, "start")
    b = blocks.groupBy("sample_id", "unit").agg(
        F.min("block").alias("low"), F.max("block").alias("high"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("weight").alias("weight"), first("head").alias("head"),
        F.max("last").alias("last"), F.min("first").alias("first"), F.min(F.struct("start", "second", "first")).alias("lead"), F.array_sort(F.collect_list("first")).alias("firsts"), F.max("tool_exchange").alias("tool_exchange"),
    )
    # The first weighted token after the unit's own first token.
    b = b.withColumn("second", F.coalesce(F.col("lead.second"), F.get(F.filter("firsts", lambda x: x > F.col("start")), F.lit(0))))
    if "span_class" in weighed.columns:
        ahead = weighed.where(F.col("message_index").isNull() & F.col("span_class").isin("tool_preamble", "tool_definition")).select("sample_id", F.lit(True).alias("preamble")).distinct()
        b = b.join(ahead, "sample_id", "left").withColumn("preamble", F.coalesce("preamble", F.lit(False)))
    else:
        b = b.withColumn("preamble", F.lit(False))
    every = Window.partitionBy("sample_id")
    order = every.orderBy("start")
    b = b.withColumns({
        "before": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "latest_before": F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)),
        "onward": F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)), "number": F.row_number().over(order), "exchanges_before": F.count_if("tool_exchange").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tool_exchange").cast("int"),
        "total": F.sum("weight").over(every), "latest": F.coalesce(F.max("last").over(every), F.lit(-1)), "n_tokens": F.max("stop").over(every), "n_units": F.count(F.lit(1)).over(every), "n_exchanges": F.count_if("tool_exchange").over(every), "last_block": F.max("high").over(every),
    })
    # What a run has if it ends where a unit starts; a run to the end has the sample's own.
    edge = ("start", "before", "latest_before", "number", "exchanges_before", "low_before")
    b = b.withColumn("low_before", F.lag("high").over(order))
    here = F.struct(*edge)
    reach = F.max(here).over(order.rangeBetween(0, length))
    to_exchange = F.min(F.when(F.col("tool_exchange"), here)).over(order.rowsBetween(0, Window.unboundedFollowing))
    end = F.struct(F.col("n_tokens").alias("start"), F.col("total").alias("before"), F.col("latest").alias("latest_before"), (F.col("n_units") + 1).alias("number"), F.col("n_exchanges").alias("exchanges_before"), F.col("last_block").alias("low_before"))
    b = b.withColumn("to", F.when(F.col("n_tokens") <= F.col("start") + length, end).otherwise(reach))
    b = b.withColumn("exchange", to_exchange)
    b = b.withColumn("to", F.when(F.col("preamble") & (F.col("number") > 1) & (F.col("exchange.start") < F.col("to.start")), F.col("exchange")).otherwise(F.col("to")))
    target = F.coalesce("second", "onward")
    b = b.withColumns({"score": F.col("to.before") - F.col("before") - F.col("head"), "context": F.when(target < F.col("to.start"), target - F.col("start")).otherwise(0)})
    b = b.withColumn("fits", (F.col("to.start") > F.col("start")) & ((F.col("total") <= 0) | ((F.col("score") > 0) & (target < F.col("to.start")))))
    b = b.withColumns({"far": F.when(F.col("to.latest_before") > F.col("start"), F.col("to.latest_before")).otherwise(-1), "enough": F.col("context") >= min_context})
    best = every.orderBy(F.desc("fits"), F.desc("enough"), F.desc("score"), F.desc("far"), F.desc("context"), F.desc(F.col("to.start") - F.col("start")), "start")
    picked = b.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    kept = {"start": F.col("start"), "stop": F.col("to.start"), "first_block": F.col("low"), "last_block": F.col("to.low_before"), "score": F.col("score"), "context": F.col("context"), "relaxed": ~F.col("enough"), "kept_units": F.col("to.number") - F.col("number"), "kept_exchanges": F.col("to.exchanges_before") - F.col("exchanges_before")}
    return picked.select("sample_id", "n_tokens", "n_units", "n_exchanges", *[F.when(F.col("fits"), c).alias(n) for n, c in kept.items()])


def records(weighed: DataFrame, windows: DataFrame, policy: str, length: int, min_context: int = 0) -> DataFrame:
    """A row for each sample longer than length with the window that a truncation left of it: what it had, what it keeps.

    windows is what plain, loss_aware or semantic_loss_aware gives. Message lists and counts of units are those of whole messages,
    and empty unless the policy keeps such.
    """
    semantic = "kept_units" in windows.columns
    w = windows.where("stop > start")
    w = w.select("sample_id", F.col("start").alias("from"), F.col("stop").alias("to"), *[F.col(c) if c in w.columns else F.lit(d).alias(c) for c, d in (("context", 0), ("relaxed", False), ("n_units", 0), ("kept_units", 0), ("n_exchanges", 0), ("kept_exchanges", 0))])
    inside = (F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("to"))
    counted = inside & (F.col("pos") > F.col("from"))
    rows = weighed.join(w, "sample_id").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("original_length"), *[F.first(c).alias(c) for c in w.columns[1:]], F.count_if(F.col("weight") > 0).alias("original_selected"), F.count_if(counted & (F.col("weight") > 0)).alias("retained_selected"),
        F.sum("weight").alias("original_weight"), F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)).alias("retained_weight"),
        F.array_sort(F.collect_set("message_index")).alias("messages"), F.array_sort(F.collect_set(F.when(inside, F.col("message_index")))).alias("kept"),
    ).where(F.col("original_length") > length)
    none = F.array().cast("array<int>")
    return rows.select(
        "sample_id", F.lit(policy).alias("policy"), "original_length", F.col("from").alias("start"), F.col("to").alias("stop"), "original_selected", "retained_selected", "original_weight", "retained_weight",
        F.lit(min_context).alias("minimum_context"), F.col("context").alias("retained_context"), (~F.col("relaxed")).alias("context_satisfied"),
        *[(c if semantic else none).alias(n) for n, c in (("original_messages", F.col("messages")), ("retained_messages", F.col("kept")), ("dropped_messages", F.array_except("messages", "kept")))],
        F.col("n_units").alias("original_units"), F.col("kept_units").alias("retained_units"), F.col("n_exchanges").alias("original_exchanges"), F.col("kept_exchanges").alias("retained_exchanges"),
    )


def record_faults(found: DataFrame) -> DataFrame:
    """sample_id, fault of truncation records that contradict themselves."""
    fault = F.when((F.col("start") < 0) | (F.col("start") >= F.col("stop")) | (F.col("stop") > F.col("original_length")), "no window of the sample").when(F.col("retained_selected") > F.col("original_selected"), "selected tokens were added")
    fault = fault.when(F.col("retained_weight") > F.col("original_weight") + 1e-12, "weight was added").when((F.col("minimum_context") < 0) | (F.col("retained_context") < 0), "a context is negative")
    fault = fault.when(F.col("context_satisfied") & (F.col("retained_context") < F.col("minimum_context")), "the context is below its minimum")
    semantic = F.col("policy") == "semantic_loss_aware"
    joined = F.array_sort(F.concat("retained_messages", "dropped_messages"))
    fault = fault.when(semantic & (joined != F.array_sort("original_messages")), "kept and dropped messages are not all messages once").when(F.col("retained_units") > F.col("original_units"), "units were added").when(F.col("retained_exchanges") > F.col("original_exchanges"), "tool exchanges were added")
    fault = fault.when(~semantic & ((F.size("original_messages") > 0) | (F.col("original_units") > 0)), "only semantic truncation keeps messages")
    return found.select("sample_id", fault.alias("fault")).where("fault is not null")
