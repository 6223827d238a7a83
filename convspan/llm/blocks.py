"""Exchange of packed hashes between blocks of documents and ranges of hashes.

Rows fall into blocks by a hash of doc_id and text, a few MB of text each, so rows of one doc_id with different texts are spread. A block names what it holds by hashes; a hash belongs to a bucket, to
which every block sends its different hashes as one packed row. A bucket, knowing all blocks' hashes, answers every block with one
packed row. A frequent hash is so one entry per block that holds it, however many documents do.

There are as many blocks and buckets as keep a block at about BLOCK_BYTES of text, and at least as many as the session's shuffle
partitions ask for; beyond some tens of GB fewer, so that a message from a block to a bucket, of which there is one for each pair,
stands for MESSAGE_BYTES of text: both then grow with the square root of the text (32 MB of text a block for 1 TB, 320 MB for 100 TB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.llm.common import partitions, small_arrow_batches, text_or_empty

#: Blocks, which hold text, and buckets, which hold hashes, for each shuffle partition.
BLOCKS_PER_PARTITION, BUCKETS_PER_PARTITION = 2, 1
BLOCK_BYTES, MESSAGE_BYTES = 8_000_000, 1_000
LAST = (1 << 63) - 1
#: From here on doc is that of rows with a null doc_id.
FIRST_NULL = 1 << 62
#: A shared hash that more blocks than this hold is hot.
HOT_BLOCKS = 256
MESSAGE = "block long, bucket long, a binary, b binary, c binary, d binary"
PARTS = ["a", "b", "c", "d"]


def counts(size: int, partitions: int) -> tuple[int, int]:
    """Numbers of blocks and of buckets for so many bytes of text."""
    most = min(size // BLOCK_BYTES, int((size / MESSAGE_BYTES) ** 0.5))
    return max(BLOCKS_PER_PARTITION * partitions, most), max(BUCKETS_PER_PARTITION * partitions, most // 2)


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id, doc, text), number of buckets: a null text is empty; doc is doc_id for comparison.

    Rows with a null doc_id come after all others (below 2 ** 62), in the order of a hash of their texts, so many such rows fall into
    many blocks; those with equal texts count as one document.
    """
    small_arrow_batches(docs)
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    blocks, buckets = counts(size, partitions(docs.sparkSession))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_NULL) + F.shiftrightunsigned(F.xxhash64(text_or_empty()), 3))
    rows = docs.select("doc_id", doc.alias("doc"), text_or_empty().alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)).alias("block"), "doc_id", "doc", "text"), buckets


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(34)) % np.uint64(buckets)


def messages(block: int, rows: list[tuple[int, list[bytes]]]) -> pa.Table:
    """A table of MESSAGE rows from (bucket, parts)."""
    full = [(b, [*parts, *[None] * (len(PARTS) - len(parts))]) for b, parts in rows]
    columns = [pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in full], pa.int64())]
    columns += [pa.array([p[k] for _, p in full], pa.binary()) for k in range(len(PARTS))]
    return pa.table(columns, ["block", "bucket", *PARTS])


def received(table: pa.Table, part: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in table.column(part)]


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes) for those that have any, places in the order given."""
    if not len(hashes):
        return
    bucket = bucket_of(hashes, buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, at[1:]), strict=True)


def announce(block: int, hashes: np.ndarray, several: np.ndarray, buckets: int) -> pa.Table:
    """Tells the buckets which different hashes a block holds, by 32 bits each, and which of them count as shared already."""
    rows = []
    for bucket, at in by_bucket(hashes, buckets):
        rows.append((bucket, [(hashes[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.packbits(several[at]).tobytes()]))
    return messages(block, rows)


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Answers each block which of its hashes are shared, and which are hot."""
    parts = received(table, "a", np.uint32)
    sizes = list(map(len, parts))
    several = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(received(table, "b", np.uint8), sizes, strict=True)])
    _, which, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    marked = np.zeros(len(held), bool)
    marked[which[several > 0]] = True
    shared, hot = (marked | (held > 1))[which], (held > HOT_BLOCKS)[which]
    cuts = np.cumsum(sizes)[:-1]
    answer = [(x, y) for x, y in zip(np.split(shared, cuts), np.split(hot, cuts), strict=True)]
    pick = [k for k, (x, _) in enumerate(answer) if x.any()]
    blocks = table.column("block").to_numpy()
    columns = [pa.array(blocks[pick], pa.int64()), pa.array([key[0].as_py()] * len(pick), pa.int64())]
    columns += [pa.array([np.packbits(answer[k][j]).tobytes() for k in pick], pa.binary()) for j in (0, 1)] + [pa.nulls(len(pick), pa.binary())] * 2
    return pa.table(columns, ["block", "bucket", *PARTS])


def shared_hashes(dealt: DataFrame, buckets: int, hashes_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The answers to every block's announcement of hashes_of(rows): (different hashes, whether each counts as shared already).

    Two hashes that agree in their bucket and 32 more bits count as one; such a chance meeting marks a hash as shared that is not,
    which callers find out later.
    """
    def tell(key: tuple, table: pa.Table) -> pa.Table:
        return announce(key[0].as_py(), *hashes_of(table), buckets)

    return dealt.groupBy("block").applyInArrow(tell, MESSAGE).groupBy("bucket").applyInArrow(_shared, MESSAGE)


def marks(answers: pa.Table, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot, for each of a block's announced hashes, from the answers it got."""
    found = {b: k for k, b in enumerate(answers.column("bucket").to_pylist())}
    shared, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    a, b = received(answers, "a", np.uint8), received(answers, "b", np.uint8)
    for bucket, at in by_bucket(hashes, buckets):
        if (k := found.get(bucket)) is not None:
            shared[at], hot[at] = (np.unpackbits(x[k], count=len(at)).astype(bool) for x in (a, b))
    return shared, hot


def answered(dealt: DataFrame, answers: DataFrame, act: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """act(block, its rows, its answers) of every block that has rows."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        return act(key[0].as_py(), rows, told)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
