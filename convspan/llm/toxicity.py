"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posterior labels.

Voters are mined from labelled rows: words (lexicon) and beginnings of words (patterns) that toxic rows hold far more often than others,
and the voter that a row holds several of them. The label model has a hidden class for every row, given which the voters and the
noisy human label speak by their own rates; correlated voters (a word and its own beginning) share their say, by the correlations
within the classes that are estimated along. Expectation maximisation gives the posterior labels. A logistic regression on the votes,
fitted to these, is what scores a text.

Only the fit is bounded: by LABELLED rows and VOTERS voters. Scoring runs over all rows, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.llm.common import hash_sample, small_arrow_batches, text_or_empty
from convspan.llm.textarrays import byte_sums, chunks, spans, utf8

#: Labelled rows that are learned from, at most: those whose doc_id has the least hashes.
LABELLED = 20_000
VOTERS = 400
#: A voter is held by so many toxic rows at least, and so many times as often by toxic rows as by others.
LEAST_ROWS, LEAST_LIFT = 5, 4.0
#: Bytes of the beginnings of words that are patterns.
BEGINNINGS = (4, 5, 6, 7)
#: Voters of one row that count as several.
SEVERAL = (1, 2, 3)
THRESHOLD = 0.3
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a") : ord("z") + 1] = True
IS_LETTER[0x80:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are kept from learning: crc32 of the id as text is 2 modulo 4 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, number of the text, feature) of ranges of texts: hashes of words and of beginnings of longer words."""
    lower = pc.utf8_lower(texts)
    for first, last in chunks(lower):
        data, offsets = utf8(lower.slice(first, last - first))
        begins, ends, runs = spans(IS_LETTER[data], offsets)
        row = np.repeat(np.arange(last - first), np.diff(runs))
        sums = byte_sums(data)
        found, rows = [sums.slices(begins, ends)], [row]
        for n in BEGINNINGS:
            long = ends - begins > n
            found.append(sums.slices(begins[long], begins[long] + n) ^ np.uint64(n))
            rows.append(row[long])
        yield first, last, np.concatenate(rows), np.concatenate(found).view(np.int64)


@dataclass
class Model:
    voters: np.ndarray
    weights: np.ndarray
    bias: float

    def votes(self, texts: pa.Array) -> np.ndarray:
        """Which voters each text holds, and whether it holds several."""
        out = np.zeros((len(texts), len(self.voters) + len(SEVERAL)), bool)
        for first, _, rows, found in _features(texts):
            if len(self.voters):
                at = np.minimum(np.searchsorted(self.voters, found), len(self.voters) - 1)
                hit = self.voters[at] == found
                out[first + rows[hit], at[hit]] = True
        total = out[:, : len(self.voters)].sum(1)
        for k, n in enumerate(SEVERAL):
            out[:, len(self.voters) + k] = total >= n
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.votes(texts) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic of at most limit rows that are not held out; of a doc_id's labels the greatest counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = hash_sample(known, limit, "doc_id")
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")  # limit rows of 9 bytes


def _mine(sample: DataFrame) -> np.ndarray:
    """The voters: features with the greatest excess of toxic rows over what their frequency lets expect."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, rows, found in _features(batch.column(0)):
                pair = np.unique(np.stack([found, rows]), axis=1)
                feature, at = np.unique(pair[0], return_index=True)
                own = toxic[first + pair[1]].astype(np.int64)
                held, hit = np.diff(np.append(at, pair.shape[1])), np.add.reduceat(own, at) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(held.astype(np.int64)), pa.array(hit.astype(np.int64))], ["feature", "held", "hit"])

    total, toxic = sample.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    if not toxic or toxic == total:
        return np.zeros(0, np.int64)
    share = toxic / total
    per = sample.mapInArrow(count, "feature long, held long, hit long").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("hit").alias("hit"))
    per = per.where((F.col("hit") >= LEAST_ROWS) & (F.col("hit") * (1 - share) >= LEAST_LIFT * share * (F.col("held") - F.col("hit"))))
    excess = (F.col("hit") - F.col("held") * share) / F.sqrt(F.col("held") * share)
    rows = per.orderBy(excess.desc(), "feature").limit(VOTERS).collect()
    return np.sort(np.array([r.feature for r in rows], np.int64))


def _label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the hidden class of each row.

    Each round estimates the class's share, every voter's rate in either class, and within the classes the voters' correlations; a
    voter's evidence counts in inverse proportion to the correlation it shares with others.
    """
    v, y = votes.astype(np.float32), label.astype(np.float32)
    posterior = 0.9 * y + 0.1 * y.mean()
    for step in range(rounds):
        toxic = posterior.sum()
        rest = len(y) - toxic
        rates = (posterior @ v + 0.5) / (toxic + 1), ((1 - posterior) @ v + 0.5) / (rest + 1)
        says = (posterior @ y + 0.5) / (toxic + 1), ((1 - posterior) @ y + 0.5) / (rest + 1)
        if step % 5 == 0:
            within = np.zeros((v.shape[1],) * 2, np.float32)
            for rate, weight, total in ((rates[0], posterior, toxic), (rates[1], 1 - posterior, rest)):
                centred = (v - rate) * np.sqrt(weight)[:, None]
                spread = np.sqrt(np.maximum((centred**2).sum(0), 1e-6))
                within += np.abs(centred.T @ centred) / np.outer(spread, spread) * (total / len(y))
            share = 1 / np.maximum(1, np.where(within > 0.1, within, 0).sum(1))
        log = lambda hit, miss: np.log(hit) - np.log(miss)
        evidence = v @ (share * (log(*rates) - log(1 - rates[0], 1 - rates[1]))) + (share * log(1 - rates[0], 1 - rates[1])).sum()
        evidence += np.where(y > 0, log(*says), log(1 - says[0], 1 - says[1]))
        posterior = _sigmoid(evidence + np.log(toxic / max(rest, 1e-9))).astype(np.float32)
    return posterior


def _logistic(votes: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's iterations."""
    x = np.hstack([votes, np.ones((len(votes), 1), bool)]).astype(np.float32)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + penalty * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """The classifier, from at most limit labelled rows that are not held out; without labels of both classes it scores 0 throughout.

    The driver gets the voters and, of the limit rows, the votes as bits.
    """
    small_arrow_batches(docs)
    sample = _labelled(docs, labels, limit)
    model = Model(_mine(sample), np.zeros(0), 0.0)
    model.weights = np.zeros(len(model.voters) + len(SEVERAL))
    if not len(model.voters):
        return Model(model.voters, model.weights, -30.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(model.votes(batch.column(0)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bits], pa.binary()), batch.column(1)], ["bits", "toxic"])

    rows = sample.mapInArrow(vote, "bits binary, toxic boolean").groupBy("bits", "toxic").agg(F.count(F.lit(1)).alias("times")).collect()
    rows.sort(key=lambda r: (bytes(r.bits), r.toxic))
    rows = [r for r in rows for _ in range(r.times)]
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1)
    votes = np.unpackbits(bits, axis=1)[:, : len(model.weights)].astype(bool)
    label = np.array([r.toxic for r in rows])
    model.weights, model.bias = _logistic(votes, _label_model(votes, label))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on) of each row's whole text, under these names.

    A null or empty text has no votes and scores what such texts do; repeated rows score alike; an empty table gives an empty one;
    columns that have one of the new names are replaced.
    """
    small_arrow_batches(docs)
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(batch.num_columns - 1))
            columns = [*batch.columns[:-1], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return source.mapInArrow(run, schema)
