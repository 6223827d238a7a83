"""Tokens of rendered samples: alignment with spans, loss weights by declarative rules, and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspan.operators import render
from convspan.operators.encoders import WORDS, Encoder, as_encoder

CHARACTERS = r"[\s\S]"
FIELDS = ("role", "span_class", "message_index", "part_kind", "part_index", "call_id", "tool_name", "tags")


def tokenize(documents: DataFrame, encoder: Encoder | str = WORDS) -> DataFrame:
    """sample_id, pos, token, token_id, start, end: the tokens of (sample_id, text) by an encoder or a pattern, ranges in characters."""
    return as_encoder(encoder).tokens(documents)


def align(tokens: DataFrame, spans: DataFrame, owner: str = "right") -> DataFrame:
    """Tokens with the span that owns them: of the spans they overlap the last (right) or the first (left).

    A sample's spans follow each other without gaps, so that is the span with the token's last or first character, and the last one
    that begins at it or before: spans and tokens are put in one order, and each token takes the span before it. Fields that only
    some spans have (FIELDS) come along.
    """
    at = {"right": F.col("end") - 1, "left": F.col("start")}[owner]
    more = [c for c in FIELDS if c in spans.columns and c not in ("role", "span_class", "message_index")]
    fields = [c for c in tokens.columns if c != "sample_id"]  # that one stays beside, by which the rows are dealt
    own = F.struct("span_index", "message_index", "span_class", "role", "default_weight", *more)
    starts = render.ranges(spans).where("right > left").select("sample_id", F.col("left").alias("__at"), own.alias("__span"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in tokens.select(*fields).schema) + ">").alias("__token"))
    every = tokens.select("sample_id", at.cast("long").alias("__at"), F.lit(None).cast(starts.schema["__span"].dataType).alias("__span"), F.struct(*fields).alias("__token")).unionByName(starts)
    order = Window.partitionBy("sample_id").orderBy("__at", F.col("__token").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("__span", F.last("__span", ignorenulls=True).over(order)).where("__token is not null and __span is not null")
    return found.select("sample_id", *[F.col("__token")[c].alias(c) for c in fields], "__span.*")


OWNERS = ("right", "left", "reject")


def owned(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """sample_id, pos, span_index, fault of every token, by the boundary owner of each span it overlaps.

    spans are (sample_id, span_index, left, right, boundary_owner), ranges of characters that may overlap, leave gaps or be empty, but begin
    and end in the order of their indices, which count from 0. A token in one span is its own; in several it is the last one's if all say right,
    the first one's if all say left, else it is at fault, as are tokens in no span, without characters or before the text, and all tokens of a sample whose spans
    are out of order. An empty span is overlapped by a token around it.

    A token overlaps the spans that begin before its end less those that end at its start or before, which are a run of indices: one
    sweep over the edges of spans and tokens in the order of their places counts both for each owner. No span meets a token in a join.
    """
    return _swept(tokens, spans).drop("tokens")


def _swept(tokens: DataFrame, spans: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """owned(), and tokens: the named columns of the tokens at that position, which come along on one of their edges."""
    by = Window.partitionBy("sample_id")
    s = spans.select("sample_id", "span_index", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.coalesce("boundary_owner", F.lit("right")).alias("owner"))
    order = by.orderBy("span_index")
    back = (F.col("left") < F.lag("left").over(order)) | (F.col("right") < F.lag("right").over(order)) | (F.col("right") < F.col("left")) | (F.col("span_index") != F.row_number().over(order) - 1)
    s = s.withColumn("back", F.coalesce(back, F.lit(False)))
    # At one place spans end first, then tokens start; tokens end before spans begin there.
    edge = lambda at, kind: F.struct(F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("int").alias("pos")
    of_spans = s.select("sample_id", none, "owner", "back", F.explode(F.array(edge("right", 0), edge("left", 3))).alias("edge"))
    own = [] if carried is None else [F.struct(*carried).alias("own")]
    of_tokens = tokens.select("sample_id", F.col("pos").cast("int").alias("pos"), F.lit(None).cast("string").alias("owner"), F.lit(False).alias("back"), F.explode(F.array(edge("start", 1), edge("end", 2))).alias("edge"), *own)
    if own:
        of_tokens = of_tokens.withColumn("own", F.when(F.col("edge.kind") == 1, F.col("own")))
    sweep = by.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.count_if((F.col("edge.kind") == kind) & (F.col("owner") == owner)).over(sweep).alias(f"{owner}_{kind}") for kind in (0, 3) for owner in OWNERS]
    rows = of_spans.unionByName(of_tokens, allowMissingColumns=True).select("sample_id", "pos", "edge", *seen, F.max("back").over(by).alias("disordered"), *(["own"] if own else [])).where("pos is not null")
    at_start = lambda c: F.max(F.when(F.col("edge.kind") == 1, F.col(c)))
    at_end = lambda c: F.max(F.when(F.col("edge.kind") == 2, F.col(c)))
    found = rows.groupBy("sample_id", "pos").agg(
        at_start("edge.at").alias("start"), at_end("edge.at").alias("end"), F.max("disordered").alias("disordered"),
        sum((at_start(f"{o}_0") for o in OWNERS[1:]), at_start("right_0")).alias("first"), *[(at_end(f"{o}_3") - at_start(f"{o}_0")).alias(o) for o in OWNERS], F.collect_list("own" if own else F.lit(None)).alias("tokens"),
    )
    count = F.col("right") + F.col("left") + F.col("reject")
    fault = F.when((F.col("start") < 0) | (F.col("end") < F.col("start")), "a token has no valid range").when(F.col("end") == F.col("start"), "a token has no characters").when(F.col("disordered"), "spans are out of order")
    fault = fault.when(count <= 0, "a token lies outside the spans").when((count > 1) & (F.col("right") < count) & (F.col("left") < count), "a token crosses spans without one owner")
    owner = F.when((count == 1) | (F.col("left") == count), F.col("first")).otherwise(F.col("first") + count - 1)
    return found.withColumn("fault", fault).select("sample_id", "pos", F.when(F.col("fault").isNull(), owner).cast("int").alias("span_index"), "fault", "tokens")


def align_owned(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens with the fields of the span that owns them by owned(), and fault; tokens at fault have no span.

    Tokens go along in the sweep, and each takes the fields behind which it comes in the order of its span: neither is a join, so rows
    stay where they are dealt by sample.
    """
    more = [c for c in FIELDS if c in spans.columns and c not in ("role", "span_class", "message_index")]
    fields = ["message_index", "span_class", "role", "default_weight", *more]
    placed = spans if "left" in spans.columns else render.ranges(spans)
    carried = [c for c in tokens.columns if c != "sample_id"]
    t = _swept(tokens, placed, carried).where("sample_id is not null").select("sample_id", F.col("span_index").alias("__at"), "fault", F.explode("tokens").alias("__token"))
    s = spans.where("span_index is not null").select("sample_id", F.col("span_index").cast("int").alias("__at"), F.struct(*fields).alias("__span"))
    by = Window.partitionBy("sample_id", "__at").orderBy(F.col("__token").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    every = t.unionByName(s, allowMissingColumns=True).withColumn("__span", F.last("__span", ignorenulls=True).over(by)).where("__token is not null")
    rest = [c for c in carried if c != "pos"]
    return every.select("sample_id", F.col("__at").alias("span_index"), *[F.col("__token")[c].alias(c) for c in ("pos", *rest)], "fault", *[F.col("__span")[c].alias(c) for c in fields])


def alignment_faults(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """sample_id, pos, fault of tokens that have no characters, lie outside their sample's text, or cross from one span into another."""
    size = spans.groupBy("sample_id").agg(F.sum(F.length("text")).alias("size"))
    t = tokens.join(size, "sample_id", "left")
    sound = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("size"))
    fault = F.when((F.col("start") < 0) | (F.col("end") > F.coalesce("size", F.lit(0))), "a token lies outside the text").when(F.col("end") <= F.col("start"), "a token has no characters")
    left, right = (align(t.where(sound).select("sample_id", "pos", "start", "end"), spans, o).select("sample_id", "pos", F.col("span_index").alias(o)) for o in ("left", "right"))
    crossing = left.join(right, ["sample_id", "pos"]).where("left <> right").select("sample_id", "pos", F.lit("a token crosses spans").alias("fault"))
    return t.select("sample_id", "pos", fault.alias("fault")).where("fault is not null").unionByName(crossing)


@dataclass(frozen=True)
class Rule:
    """A weight for tokens whose fields have the given values; a list matches any of its members."""

    weight: float
    match: dict[str, object] = field(default_factory=dict)
    require_match: bool = False
    name: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.weight < float("inf"):
            raise ValueError("a rule's weight is finite and not negative")
        if unknown := set(self.match) - set(FIELDS):
            raise ValueError(f"unknown fields {sorted(unknown)}")

    def matches(self) -> Column:
        found = F.lit(True)
        for name, value in self.match.items():
            if name == "tags":  # a set of tags matches any of its members
                found &= F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, value if isinstance(value, (list, tuple)) else [value]))), F.lit(False))
                continue
            found &= F.coalesce(F.col(name).isin(*value), F.lit(False)) if isinstance(value, (list, tuple)) else F.col(name).eqNullSafe(F.lit(value))
        return found


def rules_of(config: dict) -> tuple[tuple[Rule, ...], str]:
    """(rules, conflict mode) of an objective's configuration; unknown keys are errors."""
    if unknown := set(config) - {"conflict_mode", "rules"}:
        raise ValueError(f"the objective has unknown keys {sorted(unknown)}")
    conflict = config.get("conflict_mode", "last_match")
    if conflict not in ("last_match", "multiply", "error"):
        raise ValueError(f"unknown conflict mode {conflict!r}")
    found = []
    for k, raw in enumerate(config.get("rules", ())):
        if not isinstance(raw, dict) or "weight" not in raw:
            raise ValueError(f"rule {k} has to be a mapping with a weight")
        if unknown := set(raw) - {"name", "select", "weight", "require_match"}:
            raise ValueError(f"rule {k} has unknown keys {sorted(unknown)}")
        found.append(Rule(float(raw["weight"]), dict(raw.get("select", {})), bool(raw.get("require_match", False)), str(raw.get("name", f"rule_{k}"))))
    return tuple(found), conflict


#: The rules of the registered queries.
DEFAULT_RULES = (Rule(0.0), Rule(1.0, {"role": "assistant", "span_class": "content"}, require_match=True), Rule(0.5, {"role": "assistant", "span_class": ["assistant_end", "role_header"]}))
OVERLAPPING_RULES = (Rule(2.0, {"role": "assistant"}), Rule(0.5, {"span_class": "content"}))


def weigh(aligned: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, conflict: str = "last_match") -> DataFrame:
    """Tokens with matched (numbers of the rules that match) and weight; a sample's first token has weight 0.

    last_match takes the last matching rule's weight, multiply the default weight times all of theirs, error the only one's: there a
    token that several rules match has a null weight. Without a match the default weight stays.
    """
    numbers = F.filter(F.array(*[F.when(r.matches(), F.lit(k)) for k, r in enumerate(rules)]).cast("array<int>"), lambda x: x.isNotNull())
    if conflict == "multiply":
        weight = F.col("default_weight")
        for r in rules:
            weight = weight * F.when(r.matches(), r.weight).otherwise(1.0)
    else:
        weight = F.col("default_weight")
        for r in rules:
            weight = F.when(r.matches(), r.weight).otherwise(weight)
        if conflict == "error":
            weight = F.when(F.size("matched") <= 1, weight)
        elif conflict != "last_match":
            raise ValueError(f"unknown conflict mode {conflict!r}")
    return aligned.withColumn("matched", numbers).withColumn("weight", F.when(F.col("pos") == 0, 0.0).otherwise(weight))


def match_counts(weighed: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """sample_id and for each rule k the number rule_k of tokens that it matches."""
    return weighed.groupBy("sample_id").agg(*[F.count_if(F.array_contains("matched", k)).alias(f"rule_{k}") for k in range(len(rules))])


def faults(weighed: DataFrame) -> DataFrame:
    """sample_id, pos, fault of tokens that break a rule of a tokenized sample; empty for sound ones."""
    order = Window.partitionBy("sample_id").orderBy("pos")
    rows = weighed.select("sample_id", "pos", "start", "end", "weight", (F.row_number().over(order) - 1).alias("place"), F.coalesce(F.lag("end").over(order), F.lit(0)).alias("before"))
    fault = F.when(F.col("pos") != F.col("place"), "positions have gaps").when((F.col("start") >= F.col("end")) | (F.col("start") < F.col("before")), "an offset is empty or goes back")
    fault = fault.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf")), "a weight is negative or no number").when((F.col("place") == 0) & (F.col("weight") != 0), "a first token has weight")
    return rows.select("sample_id", "pos", fault.alias("fault")).where("fault is not null")
