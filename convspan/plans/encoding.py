"""Queries on encoders and on tokens whose spans name their owners, each beside its DuckDB twin.

The twin of the file encoder reads the same tokenizer file and merges by a recursive query over the different pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.operators import encoders, render, tokens
from convspan.plans.exchanges import TOKENS, _transcript, tool_messages
from convspan.plans.oracle import MATH_SPANS
from convspan.sources import tables

NAME = "byte_bpe_50k.json"


def tokenizer_file(name: str = NAME) -> str | None:
    """The place of a public tokenizer file, where such files are installed."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.path(name)


def encode_messages(spark, sf_dir):
    """Ids and character ranges of every message's tokens by a tokenizer file."""
    m = tables.table(spark, sf_dir, "conversations")
    docs = m.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), "text")
    found = encoders.FileEncoder(tokenizer_file()).encoded(docs).where(F.size("ids") > 0)
    ranges = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.concat_ws(":", x["starts"], x["ends"]))
    return found.select("sample_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha"), F.sha2(F.array_join(ranges, ","), 256).alias("ranges_sha"))


def file_token_owners(spark, sf_dir):
    """Tokens of rendered samples by a tokenizer file, with the class and role of the spans that own them."""
    spans = render.get_renderer("qwen2_5_math")(tables.message_table(tables.table(spark, sf_dir, "conversations")))
    found = tokens.align(tokens.tokenize(render.documents(spans), encoders.FileEncoder(tokenizer_file())), spans)
    return found.groupBy("sample_id", "span_class", F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("token_count"), F.sum(F.col("token_id").cast("long")).alias("ids"))


def _owned_spans(spark, sf_dir) -> DataFrame:
    """Spans with owners, damaged by sample number: of one owner, of two, rejecting, with gaps, overlapping, empty, out of order."""
    spans = render.ranges(_transcript(tool_messages(spark, sf_dir)))
    kind, i = F.col("sample_id") % 8, F.col("span_index")
    owner = F.when(kind == 1, "left").when((kind == 2) & (i % 2 == 0), "left").when((kind == 3) & (i % 5 == 4), "reject").otherwise("right")
    left = F.when((kind == 4) & (i % 4 == 3), F.least(F.col("left") + 2, F.col("right"))).when((kind == 7) & (i == 3), F.col("right") + 10_000).otherwise(F.col("left"))
    right = F.when(kind == 5, F.col("right") + 3).when((kind == 6) & (i % 3 == 1), F.col("left")).when((kind == 7) & (i == 3), F.col("right") + 10_001).otherwise(F.col("right"))
    return spans.withColumn("boundary_owner", owner).withColumns({"left": left, "right": right})


def owners_of_tokens(spark, sf_dir):
    """Which span owns each token, or why none does."""
    t = tokens.tokenize(render.documents(_transcript(tool_messages(spark, sf_dir))))
    kind, pos = F.col("sample_id") % 8, F.col("pos")
    t = t.withColumn("end", F.when((kind == 0) & (pos % 50 == 9), F.col("start")).when((kind == 0) & (pos % 50 == 19), F.col("start") - 1).otherwise(F.col("end")))
    found = tokens.align_owned(t, _owned_spans(spark, sf_dir))
    return found.select("sample_id", F.col("pos").cast("long"), F.col("span_index").cast("long"), "span_class", "fault")


def queries() -> dict:
    found = {"owners_of_tokens": owners_of_tokens}
    return found | ({f.__name__: f for f in (encode_messages, file_token_owners)} if tokenizer_file() else {})


def _merged(texts: str) -> str:
    """CTEs from texts(key, text) to toks(key, k, n, t, id, s, e): tokens in the order of (k, n, t)."""
    return rf"""file AS (SELECT content AS j FROM read_text('{tokenizer_file()}')),
alphabet AS (SELECT b, chr(CAST(CASE WHEN shown THEN b ELSE 255 + row_number() OVER (PARTITION BY shown ORDER BY b) END AS INT)) AS c FROM (SELECT CAST(range AS INT) AS b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS shown FROM range(256))),
merges AS (SELECT p[1] AS x, p[2] AS y, rank FROM (SELECT unnest(l) AS p, generate_subscripts(l, 1) AS rank FROM (SELECT CAST(json_extract(j, '$.model.merges') AS VARCHAR[][]) AS l FROM file))),
vocabulary AS (SELECT e.key AS token, e.value AS id FROM (SELECT unnest(map_entries(CAST(json_extract(j, '$.model.vocab') AS MAP(VARCHAR, INT)))) AS e FROM file)),
texts AS ({texts}),
cut AS (SELECT key, generate_subscripts(l, 1) AS k, unnest(l) AS part FROM (SELECT key, string_split(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM texts)),
pieces AS (SELECT key, k, generate_subscripts(l, 1) AS n, unnest(l) AS piece FROM (SELECT key, k, regexp_extract_all(part, '''s|''t|''re|''ve|''m|''ll|''d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\s+') AS l FROM cut)),
bytes AS (SELECT piece, generate_subscripts(h, 1) AS i, CAST('0x' || unnest(h) AS INT) AS b FROM (SELECT piece, regexp_extract_all(hex(encode(piece)), '..') AS h FROM (SELECT DISTINCT piece FROM pieces))),
steps AS (SELECT piece, list(c ORDER BY i) AS syms, 0 AS step FROM bytes JOIN alphabet USING (b) GROUP BY piece
  UNION ALL SELECT piece, list_concat(list_concat(syms[:best % 10000 - 1], [syms[best % 10000] || syms[best % 10000 + 1]]), syms[best % 10000 + 2:]), step + 1
  FROM (SELECT piece, syms, step, (SELECT min(m.rank * 10000 + g.k) FROM (SELECT unnest(range(1, len(syms))) AS k) g JOIN merges m ON m.x = syms[g.k] AND m.y = syms[g.k + 1]) AS best FROM steps) WHERE best IS NOT NULL),
done AS (SELECT piece, generate_subscripts(l, 1) AS t, unnest(l) AS token FROM (SELECT piece, arg_max(syms, step) AS l FROM steps GROUP BY piece)),
chars AS (SELECT piece, i, sum(CASE WHEN b BETWEEN 128 AND 191 THEN 0 ELSE 1 END) OVER (PARTITION BY piece ORDER BY i) AS c FROM bytes),
ranged AS (SELECT piece, t, token, sum(length(token)) OVER (PARTITION BY piece ORDER BY t) AS b1 FROM done),
own AS (SELECT r.piece, t, id, a.c - 1 AS s, z.c AS e FROM ranged r JOIN vocabulary USING (token) JOIN chars a ON a.piece = r.piece AND a.i = b1 - length(token) + 1 JOIN chars z ON z.piece = r.piece AND z.i = b1),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY key ORDER BY k, n) - length(piece) AS base FROM pieces),
toks AS (SELECT key, k, n, t, id, CAST(base + s AS BIGINT) AS s, CAST(base + e AS BIGINT) AS e FROM placed JOIN own USING (piece))"""


OWNED = TOKENS + r""",
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS BIGINT) AS i2, r - length(text) AS l FROM spans),
damaged AS (SELECT sample_id, class, i2, sample_id % 8 AS kind,
    CASE WHEN sample_id % 8 = 1 THEN 'left' WHEN sample_id % 8 = 2 AND i2 % 2 = 0 THEN 'left' WHEN sample_id % 8 = 3 AND i2 % 5 = 4 THEN 'reject' ELSE 'right' END AS owner,
    CASE WHEN sample_id % 8 = 4 AND i2 % 4 = 3 THEN least(l + 2, r) WHEN sample_id % 8 = 7 AND i2 = 3 THEN r + 10000 ELSE l END AS a,
    CASE WHEN sample_id % 8 = 5 THEN r + 3 WHEN sample_id % 8 = 6 AND i2 % 3 = 1 THEN l WHEN sample_id % 8 = 7 AND i2 = 3 THEN r + 10001 ELSE r END AS z FROM numbered),
crooked AS (SELECT sample_id, max(i2) > 3 AS yes FROM damaged WHERE kind = 7 GROUP BY 1),
cut AS (SELECT sample_id, pos, e - length(token) AS s, CASE WHEN sample_id % 8 = 0 AND pos % 50 = 9 THEN e - length(token) WHEN sample_id % 8 = 0 AND pos % 50 = 19 THEN e - length(token) - 1 ELSE e END AS e FROM t),
met AS (SELECT c.sample_id, c.pos, c.s, c.e, count(d.i2) AS n, count(*) FILTER (owner = 'left') AS lefts, count(*) FILTER (owner = 'right') AS rights, min(d.i2) AS low, max(d.i2) AS high FROM cut c LEFT JOIN damaged d ON d.sample_id = c.sample_id AND c.s < d.z AND c.e > d.a GROUP BY ALL),
judged AS (SELECT met.*, CASE WHEN s < 0 OR e < s THEN 'a token has no valid range' WHEN s = e THEN 'a token has no characters' WHEN coalesce(yes, false) THEN 'spans are out of order' WHEN n = 0 THEN 'a token lies outside the spans' WHEN n > 1 AND rights < n AND lefts < n THEN 'a token crosses spans without one owner' END AS fault FROM met LEFT JOIN crooked USING (sample_id)),
chosen AS (SELECT sample_id, pos, fault, CASE WHEN fault IS NULL THEN CASE WHEN lefts = n THEN low ELSE high END END AS i2 FROM judged)"""

SQL = {"owners_of_tokens": f"WITH {OWNED} SELECT sample_id, pos, c.i2 AS span_index, d.class AS span_class, fault FROM chosen c LEFT JOIN damaged d USING (sample_id, i2)"}
if tokenizer_file():
    SQL |= {
        "encode_messages": f"WITH RECURSIVE {_merged('SELECT conv_id || chr(58) || turn AS key, text FROM conversations')} SELECT key AS sample_id, CAST(count(*) AS BIGINT) AS n_tokens, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY k, n, t)) AS ids_sha, sha256(string_agg(s || ':' || e, ',' ORDER BY k, n, t)) AS ranges_sha FROM toks GROUP BY 1",
        "file_token_owners": f"WITH RECURSIVE {MATH_SPANS}, {_merged('SELECT sample_id AS key, text FROM docs')} SELECT key AS sample_id, span_class, coalesce(role, 'none') AS role, CAST(count(*) AS BIGINT) AS token_count, CAST(sum(id) AS BIGINT) AS ids FROM toks JOIN spans ON spans.sample_id = key AND r - length(text) < e AND e <= r GROUP BY ALL",
    }
