"""The audit of filters against applying every order to every document."""

import collections
import itertools
import re

from pyspark.sql import functions as F

from convspan.llm import filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc_id, text, source in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    docs = collections.defaultdict(list)
    for doc_id, text, source in rows:
        words, text = WORD.findall(text or ""), text or ""
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text],
        }
        docs[source or ""].append(({k for k, v in fails.items() if v}, doc_id))
    out, shares = [], collections.Counter()
    for part, mine in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0]]
                kept = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in mine) - len(here)
                shares[part, f] += len(here)
                out.append((part, "".join(order), step, len(kept), len(here), redundant, sum(x[0] == {f} for x in mine), sum(x[1] in good for x in here), sum(x[1] in toxic for x in here)))
                left = kept
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def held(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, n int")
    got = filters.audit_filters(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(3)))
    assert got.columns == ["part", "filter_order", "step", *filters.WEIGHTS, "shapley"]
    return sorted(map(tuple, got.collect()))


def test_odd_rows(spark, docs):
    """Nulls, empties, copies over sources, repeated rows and ids, labels that repeat, miss or belong to no document."""
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    fine = " ".join(f"w{k}" for k in range(250))
    rows += [(30, fine, "a"), (31, fine, "b"), (31, fine, "b"), (30, fine, "a"), (29, fine + " A", "b"), (32, "A" * 40, "a"), (33, "x# " * 300, None), (None, fine, "a"), (40, "", "z"), (3, "one id, two texts", "a")]
    labels = [(0, 1, 1), (1, 1, 0), (1, 0, 1), (30, 1, 0), (31, 1, 1), (31, None, None), (32, 0, 1), (99, 1, 1), (None, 1, 1), (33, None, 1)]
    assert held(spark, rows, labels) == plain_audit(rows, labels)


def test_empty(spark, empty):
    assert filters.audit_filters(empty, spark.createDataFrame([], LABELS)).count() == 0
    assert len(held(spark, [(1, None, None)], [])) == 600


def test_hot_keys(spark):
    """A third of all rows has one text, a third one id and a third no id; one mask has them all in one part."""
    rows = [(k, "same # text", f"s{k % 3}") for k in range(300)] + [(7, f"text {k}", "s0") for k in range(300)] + [(None, f"text {k}", None) for k in range(300)]
    labels = [(k, k % 2, k % 3) for k in range(300)]
    assert held(spark, rows, labels) == plain_audit(rows, labels)


def test_long_text(spark):
    rows = [(1, "word " * 1_100_000 + "A", "s"), (2, " ".join(map(str, range(700_000))), "s")]
    assert held(spark, rows, []) == plain_audit(rows, [])


def test_other_filters(spark):
    """Any number of filters: two of them have two orders."""
    cells = spark.createDataFrame([("p", 0, 5, 2, 1), ("p", 1, 4, 1, 0), ("p", 3, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filters.fold_orders(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 4, 10), ("XY", 2): (5, 0, 2, 0, 2), ("YX", 1): (9, 2, 0, 0, 2), ("YX", 2): (5, 4, 2, 4, 10)}
