"""The skip-chain field: marginals against enumeration, what skip edges add on rows of the table, long words."""

import itertools
import re
import time

import numpy as np
import pytest

from convspan.llm import pii


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def marked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return [r.text for r in docs.where("text rlike '[0-9@]'").select("text").collect()]


def test_marginals_like_enumeration():
    """On graphs without cycles messages give the exact marginals."""
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    for n in (1, 2, 4):
        chain = [(a, a + 1) for a in range(0, n - 1, 2)]
        skip = [(a, a + 1) for a in range(1, n - 1, 2)]
        features = [bytes(rng.integers(0, 2, pii.N_FEATURES, np.uint8)) for _ in range(n)]
        given = [0] * (n - 1) + [2 if n > 1 else 0]
        g = pii.Graph([0] * n, list(range(n)), list(range(n)), given, features, chain, skip)
        similar = rng.normal(size=(k, k))
        field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)), similar + similar.T)
        local = g.matrix() @ field.unary
        want = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            if all(y in (0, z) for y, z in zip(given, labels)):
                score = sum(local[i, y] for i, y in enumerate(labels) if not given[i])
                score += sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
                for i, y in enumerate(labels):
                    want[i, y] += np.exp(score)
        assert np.allclose(field.marginals(g), want / want.sum(1, keepdims=True), atol=0.01)


def test_skip_edges_decide_on_rows_of_the_table(field, marked):
    """Finds of table rows that are mentioned once more in a form that no pattern finds: with skip edges nearly all are found and
    hardly a number of the same look that nothing repeats; without them, few of either."""
    without = pii.Field(field.unary, field.chain, np.zeros_like(field.skip))
    rows = [x for x in map(pii.mentioned_again, marked) if x[1]]
    right, wrong = sum(len(x[1]) for x in rows), sum(len(x[2]) for x in rows)
    assert len(rows) > 300 and wrong > 300

    def caught(field):
        found = [[s for s in further] for _, further in pii.find_all([x[0] for x in rows], field)]
        hit = lambda a, b, spans: any(s < b and e > a for s, e, _ in spans)
        return sum(hit(a, b, f) for x, f in zip(rows, found) for a, b, _ in x[1]), sum(hit(a, b, f) for x, f in zip(rows, found) for a, b in x[2])

    found, false = caught(field)
    assert found > 0.95 * right and false < 0.02 * wrong
    found, false = caught(without)
    assert found < 0.15 * right and false < 0.15 * wrong


def test_chain_edges_decide_on_rows_of_the_table(field, marked):
    """Unchanged rows: a phone number that runs into the address behind it fails its pattern; its neighbours in the chain tell."""
    rows = [x for x in marked if re.search(r"\+1 \([0-9]{3}\) 555-[0-9]{4} [0-9]", x)]
    assert rows
    for text, (_, further) in zip(rows, pii.find_all(rows, field)):
        assert any(re.fullmatch(r"1 \([0-9]{3}\) 555-[0-9]{4}", text[a:b]) and name == "similar" for a, b, name in further)


def test_skip_edges_carry_labels(field):
    """A number written otherwise is labelled because the same digits are a phone number elsewhere."""
    found = pii.find_all(["see 9745553436 here", "see 9745553436 here, or call +19745553436 today"], field)
    assert not found[0][1] and found[1][1] == [(4, 14, "similar")]


def test_the_whole_text_is_read(field):
    mention = "call +19745553436 or 974.555.3436. "
    text = mention + "word 12 " * 50_000 + mention
    assert len(pii.find_all([text], field)[0][1]) == 2


def test_fit_is_bounded(monkeypatch):
    text = "call +19745553436 " + " ".join(f"a{k}b{k}" for k in range(5000)) + " +19745553436"
    monkeypatch.setattr(pii, "FITTED_NODES", 300)
    g = pii._training(text)
    assert len(g.row) == len(g.given) == 300 and all(0 <= x < 300 for e in g.chain + g.skip for x in e)


@pytest.mark.parametrize("text", ["1" + "a" * 10**6, "a" * 10**6 + "1", "\u6f22" * 10**6 + "@x", "1" * 10**6, "a@" * 500_000, "=" * 10**6 + "1", "1 " + "-" * 10**6])
def test_a_million_characters_without_spaces(field, text):
    began = time.time()
    pii.find_all([text], field)
    assert time.time() - began < 1


def test_marginals_do_not_depend_on_other_texts():
    """A text's messages stop when they stand still, whatever else is in its batch."""
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)) * 0.3, rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    texts = ["a1 b2 a1 c3", "x9", "q7 w8 q7 e5 q7 w8 r4 q7 " * 6, "12 a@b.co 12 99 12"]
    alone = [field.marginals(pii.graph([t], [pii.base_spans(t)])) for t in texts]
    together = field.marginals(pii.graph(texts, [pii.base_spans(t) for t in texts]))
    assert np.allclose(np.concatenate(alone), together, atol=1e-12, rtol=0)
