"""Filter interaction audit: what every filter of a chain removes, under every order of the chain.

A document fails a set of the filters, its mask. All orders treat documents of one mask alike, so documents are first summed to cells
(part, mask), at most 2 ** filters of them a part. Each cell is then folded across the array of all orders (`transform` over the orders,
`aggregate` over the steps of one), which gives a struct of its weights for every order and step: 600 for five filters. The arrays of a
part's cells are merged by elementwise sums. The array of orders is a literal of the plan, so every task has it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspan.llm.common import WORDS, text_or_empty

#: The weights of an order's step, in the order of their struct.
WEIGHTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: The filter that fails copies; the others look at one text alone.
COPIES = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters of one text by their letters, true where the text fails: few words, repeated words, capitals, signs.

    The words are an array in a column of their own, so that they are made once.
    """
    words = F.col("__words")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def failed_masks(docs: DataFrame) -> DataFrame:
    """part, doc_id, content, mask of every row of docs(doc_id, text, source): bit k of mask stands for the k-th filter, copies left out.

    content is a cryptographic hash of the text, for the filter of copies.
    """
    text = F.col("__text")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(text).values())]
    return rows.select("part", "doc_id", F.unhex(F.sha2("__text", 256)).alias("content"), sum(bits[1:], bits[0]).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, those with quality 1 and those with toxic 1 among them.

    Equal rows are counted before they move. Rows of one content have one mask, so per content and part there is one row with its counts and,
    apart, those of its least doc_id; the least one of all parts passes the filter of copies. Nothing collects a content's documents.
    """
    flags = labels.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = failed_masks(docs).groupBy("doc_id", "part", "content", "mask").agg(F.count(F.lit(1)).alias("n")).join(flags, "doc_id", "left")
    counts = [F.col("n"), *(F.coalesce(F.col(c) * F.col("n"), F.lit(0)).alias(c) for c in ("good", "toxic"))]
    rows = rows.select("part", "doc_id", "content", "mask", *counts)
    names = ("n", "good", "toxic")
    one = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *names))
    unnamed = F.col("doc_id").isNull()
    held = rows.groupBy("content", "part", "mask").agg(F.min(one).alias("first"), *(F.sum(c).alias(c) for c in names), *(F.sum(F.when(unnamed, F.col(c)).otherwise(0)).alias(f"unnamed_{c}") for c in names))
    # A content has as many rows here as parts, whatever the number of its copies.
    held = held.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("content")))
    passes = {c: F.col(f"unnamed_{c}") + F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) for c in names}
    copies = F.struct((F.col("mask") + (1 << 4)).alias("mask"), *((F.col(c) - passes[c]).alias(c) for c in names))
    sides = F.array(F.struct("mask", *(passes[c].alias(c) for c in names)), copies)
    return held.select("part", F.explode(sides).alias("side")).select("part", "side.*").where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in names))


def fold_orders(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, the WEIGHTS and shapley of every part of cells(part, mask, n, good, toxic).

    letters names the filters by the bits of mask, least bit first. A part has factorial(len(letters)) * len(letters) rows.
    """
    size = len(letters)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    letter_at = lambda order, step: F.substring(order, step, F.lit(1))
    weigh = lambda when, of="n": F.when(when, F.col(of)).otherwise(F.lit(0).cast("long"))
    popcount = F.bit_count(F.col("mask"))

    def one_order(order: Column) -> Column:
        def next_step(told: Column, step: Column) -> Column:
            here, gone = F.get(F.col("__fails"), F.instr(F.lit(letters), letter_at(order, step)) - 1), told["gone"]
            now = here & ~gone
            weights = (weigh(~here & ~gone), weigh(now), weigh(here & gone), weigh(here & (popcount == 1)), weigh(now, "good"), weigh(now, "toxic"))
            steps = F.concat(told["steps"], F.array(F.struct(*(w.alias(name) for w, name in zip(weights, WEIGHTS, strict=True)))))
            return F.struct((gone | here).alias("gone"), steps.alias("steps"))

        none = F.array().cast(f"array<struct<{','.join(f'{w}:bigint' for w in WEIGHTS)}>>")
        begin = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(size)), begin, next_step, lambda told: told["steps"])

    flags = F.array(*((F.col("mask").bitwiseAND(1 << k) != 0) for k in range(size)))
    folded = cells.withColumn("__fails", flags).select("part", F.flatten(F.transform(orders, one_order)).alias("steps"))
    add = lambda a, b: F.struct(*((a[w] + b[w]).alias(w) for w in WEIGHTS))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # at most 2 ** size arrays
    merged = merged.select("part", F.aggregate(F.slice("cells", 2, 1 << size), F.get("cells", F.lit(0)), lambda a, b: F.zip_with(a, b, add)).alias("steps"))
    place = lambda pos: letter_at(F.get(orders, F.floor(pos / size).cast("int")), pos % size + 1)
    of = lambda letter: F.aggregate(F.filter("steps", lambda _, pos: place(pos) == letter), F.lit(0).cast("long"), lambda total, step: total + step["removed"])
    merged = merged.withColumn("shares", F.array(*(of(x) for x in letters)))
    rows = merged.select("part", "shares", F.posexplode("steps").alias("pos", "weights"))
    order = F.get(orders, F.floor(F.col("pos") / size).cast("int"))
    step = (F.col("pos") % size + 1).cast("int")
    return rows.select("part", order.alias("filter_order"), step.alias("step"), *(F.col("weights")[w].alias(w) for w in WEIGHTS), F.get("shares", F.instr(F.lit(letters), letter_at(order, step)) - 1).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each source of docs(doc_id, text, source) (null: empty string), each order of the five filters A to E and each step. A null text is empty. A row without
    a doc_id is no copy and makes none; equal rows count each, and all rows with the least doc_id of a text pass the filter of copies.
    labels(doc_id, quality, toxic) may miss documents or repeat them; a document is good or toxic if one of its rows says so. Other
    columns are ignored; an empty table gives an empty one.
    """
    return fold_orders(mask_cells(docs, labels), "ABCDE")


#: The same audit in DuckDB, cell by cell and order by order.
AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
flags AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > least, FALSE)} AS f
    FROM texts t LEFT JOIN flags USING (doc_id)),
cells AS (SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(s AS INT) AS step, o[s] AS letter, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)),
told AS (SELECT part, o, step, letter, n, good, toxic, contains(fails, letter) AS here, len(regexp_extract_all(fails, '[' || earlier || '_]')) > 0 AS gone, len(fails) AS many FROM cells, steps),
summed AS (SELECT part, o AS filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (here AND many = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost
    FROM told GROUP BY part, o, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
"""
