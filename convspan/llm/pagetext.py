"""Main text of web pages by the site style tree.

A page's markup is a tree of elements. Pages of one host are merged into the host's style tree: a node is the chain of tags and classes
from the root down, and holds on how many of the host's pages it is, which sequences of child elements it takes there (presentation)
and which texts stand in it (content). What varies from page to page tells something of its page; what is alike on all is the site's
own. A node's importance, for either, is exp(entropy) / pages, the share of different values: 1 if every page has its own, 1 / n if
each value is on n pages. A host with few pages says little of itself, so up to OTHER_PAGES pages of all hosts with the same node are
counted in, and what the language or a name says of an element (article and main for it; navigation, header, footer, aside and the
words of AGAINST against it) is a prior: PRIOR_PAGES pages of importance 1 or 0.

On each page importance is composed bottom-up: an element without block elements in it has that of its content, any other a mean of its
presentation's and of its children's composite importance, in which children count less the more different ones there are. Branches of
low composite importance that hold nothing of high importance are removed. Inside a branch of high importance less is asked of its parts.

Only what holds no text by the language (scripts, styles, forms, hidden elements) is left out before, and so are reader comments by
their name, as these vary from page to page like text. Statistics come from one aggregation over all pages, partial before it shuffles.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspan.llm.common import checkpointed, small_arrow_batches, text_or_empty

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS_P = ("div", "section", "article", "td", "th", "li", "blockquote", "body", "main", "button")
#: What an element closes of its own kind that was left open, up to the element that holds them.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}
#: Elements and roles that hold no text; such as speak against an element, and for it.
NEVER_TEXT = frozenset("head script style noscript template svg iframe object canvas audio video select button input textarea form dialog".split())
NEVER_ROLES = frozenset("search dialog alert form".split())
AGAINST_TAGS, AGAINST_ROLES = frozenset("nav header footer aside menu".split()), frozenset("navigation banner contentinfo complementary menu".split())
FOR = ("article", "main")
#: Words that begin a class or id: of parts that are no main text, and of reader comments. They say nothing of WHOLE or of what holds one of FOR.
AGAINST = re.compile(r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|notice|menu|nav|navbar|breadcrumb\w*|header|footer|sidebar)(?![^\W_])", re.I)
COMMENTS = re.compile(r"(?:comments?|disqus\w*)(?![^\W_])", re.I)
WHOLE = frozenset("html body main article".split())
#: Parts of a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
SPACE, DIGITS = re.compile(r"\s+"), re.compile(r"[0-9]+")
#: Pages of all hosts that count for a host's node at most, and weight of the prior, in pages.
OTHER_PAGES, PRIOR_PAGES = 100, 100
#: Least importance that stays: of any element, of one that the prior speaks against, and of a part of an important branch.
LEAST, LEAST_AGAINST, LEAST_INSIDE = 0.3, 0.9, 0.1
#: Composite importance from which a branch is important.
IMPORTANT = 0.4
#: What each different child leaves to the children's part of the composite importance.
DAMPING = 0.9
#: Kinds of statistics: texts, sequences of children, pages.
CONTENT, SHAPE, PAGES = 0, 1, 2
#: Nodes with statistics (32 bytes each) up to which they are broadcast, in all and of one host; beyond, each page is joined with its own.
BROADCAST_NODES, NODES_OF_A_HOST = 500_000, 500


class Node:
    __slots__ = ("tag", "name", "parts", "parent", "bad", "lean", "comment", "holds")

    def __init__(self, tag: str, name: str, parent: Node | None, bad: bool, lean: int, comment: bool):
        self.tag, self.name, self.parent, self.bad, self.lean, self.comment = tag, name, parent, bad, lean, comment
        self.parts: list = []
        self.holds = False


def _attributes(raw: str) -> tuple[str, bool, bool, bool, bool]:
    """The classes for the node's name; whether the attributes hide it, a role speaks against it, words do, and words of comments do."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
    if not found:
        return "", False, False, False, False
    kinds = found.get("class", "").split()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in NEVER_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower()
    words = [*kinds, found.get("id", "")]
    return ".".join(sorted({DIGITS.sub("0", x) for x in kinds})), hidden, role in AGAINST_ROLES, any(map(AGAINST.match, words)), any(map(COMMENTS.match, words))


def parse(html: str) -> list[Node]:
    """The page's elements, an element before what it holds, the first one holding the page; in time that grows with the page's length.

    Unclosed and misnested elements end where the language lets them end.
    """
    root = Node("", "", None, False, 0, False)
    every, stack, blocks = [root], [root], [0]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    at = 0

    def nearest(tags: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    for found in TOKEN.finditer(html):
        if found.start() < at:
            continue
        if found.start() > at:
            stack[-1].parts.append(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            depth = nearest((tag,))
            if depth and not (tag in INLINE and depth < blocks[-1]):
                close(depth)
            continue
        kinds, holders = (("p",), HOLDS_P) if tag in CLOSES_P else SIBLINGS.get(tag, ((), ()))
        if tag == "body":
            kinds, holders = ("head",), ("html",)
        if kinds and (depth := nearest(kinds)) > nearest(tuple(h for h in holders if h not in kinds)):
            close(depth)
        raw = found[3] or found[6] or ""
        classes, hidden, role, words, comment = _attributes(raw)
        against = tag in AGAINST_TAGS or role
        new = Node(tag, f"{tag}.{classes}" if classes else tag, stack[-1], hidden or tag in NEVER_TEXT, -1 if against else 1 if tag in FOR else 0, comment and tag not in WHOLE)
        if words and tag not in WHOLE and not new.lean:
            new.lean = -2
        stack[-1].parts.append(new)
        every.append(new)
        if tag in FOR and not new.bad:
            up = new.parent
            while up and not up.holds and not up.bad:
                up.holds, up = True, up.parent
        if tag in VOID or raw.endswith("/") and tag not in INLINE | CLOSES_P:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            stop = end.start() if end else len(html)
            new.parts.append(html[at:stop])
            at = html.find(">", stop) + 1 if end else stop
            at = at or len(html)
            continue
        opened[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(new)
    if at < len(html):
        stack[-1].parts.append(html[at:])
    for node in every[1:]:  # words say nothing of what holds an article; what says nothing by itself is like what holds it
        if node.comment and not node.holds:
            node.bad = True
        if node.lean == -2:
            node.lean = 0 if node.holds else -1
        node.lean = node.lean or node.parent.lean
        node.bad = node.bad or node.parent.bad
    return every


def _clean(text: str) -> str:
    return SPACE.sub(" ", unescape(text)).strip()


def _own_text(node: Node) -> str:
    """A node's own text, that of inline elements that are no nodes by themselves included."""
    if all(type(x) is str for x in node.parts):
        return _clean("".join(node.parts))
    out, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if type(part) is str:
            out.append(part)
        elif not part.bad and _is_inline(part):
            stack += reversed(part.parts)
        else:
            out.append(" ")
    return _clean("".join(out))


def _is_inline(node: Node) -> bool:
    """Whether the element's text belongs to what holds it."""
    return node.tag in INLINE and node.lean == node.parent.lean


def blocks_of(every: list[Node]) -> list[tuple[Node, int]]:
    """The elements that can hold text, inline ones left out, each with its name in the style tree, a hash of the names from the root down."""
    names: dict[int, int] = {}
    known: dict[tuple[int, str], int] = {}
    out = []
    for node in every:
        if node.bad:
            continue
        above = names[id(node.parent)] if node.parent else 0
        if node.parent and (_is_inline(node) or node.tag == "br"):
            names[id(node)] = above
            continue
        if (key := (above, node.name)) not in known:
            known[key] = int.from_bytes(blake2b(above.to_bytes(8, "little", signed=True) + node.name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        names[id(node)] = known[key]
        out.append((node, known[key]))
    return out


def _short(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def statistics(html: str, host: str) -> set[tuple[int, int, int]]:
    """(node, kind, value) of a page: of each node a PAGES row, the hashes of its different texts and of its sequences of children.

    The host's own name in a text counts as the same on every host.
    """
    found = set()
    held: defaultdict[int, list[str]] = defaultdict(list)
    blocks = blocks_of(parse(html))
    for node, _ in blocks:
        up = node.parent
        while up and up.parent and _is_inline(up):
            up = up.parent
        held[id(up)].append(node.name)
    for node, name in blocks:
        found.add((name, PAGES, 0))
        if text := _own_text(node):
            found.add((name, CONTENT, _short(text.replace(host, "//") if host else text)))
        if children := held.get(id(node)):
            found.add((name, SHAPE, _short(",".join(children))))
    return found


def importance(of: tuple[float | None, float | None, float] | None, kind: int, lean: int) -> float:
    """Of a node's content or presentation, with the prior; 1 if nothing is known of it."""
    value, weight = (of[kind], of[2]) if of and of[kind] is not None else (0.0, 0.0)
    total = weight + abs(lean) * PRIOR_PAGES
    return (value * weight + max(lean, 0) * PRIOR_PAGES) / total if total else 1.0


def removed(every: list[Node], known: dict[int, tuple[float | None, float | None, float]]) -> set[int]:
    """id of the elements whose own text goes; known has (importance of content, of presentation, pages that say so) of nodes."""
    blocks = blocks_of(every)
    place = {id(node): k for k, (node, _) in enumerate(blocks)}
    up = []
    for node, _ in blocks:
        above = node.parent
        while above and id(above) not in place:
            above = above.parent
        up.append(place[id(above)] if above else -1)
    own = [importance(known.get(name), CONTENT, node.lean) if any(type(x) is str and not x.isspace() or type(x) is not str and _is_inline(x) for x in node.parts) else None for node, name in blocks]
    total, count, kinds = [0.0] * len(blocks), [0] * len(blocks), [set() for _ in blocks]
    composite = [0.0] * len(blocks)
    for k in range(len(blocks) - 1, -1, -1):
        node, name = blocks[k]
        if own[k] is not None:
            total[k] += own[k]
            count[k] += 1
        if kinds[k]:
            share = DAMPING ** len(kinds[k])
            composite[k] = (1 - share) * importance(known.get(name), SHAPE, node.lean) + share * total[k] / count[k]
        else:
            composite[k] = own[k] if own[k] is not None else importance(known.get(name), CONTENT, node.lean)
        if up[k] >= 0:
            total[up[k]] += composite[k]
            count[up[k]] += 1
            kinds[up[k]].add(node.name)
    out, inside = set(), [False] * len(blocks)
    for k, (node, _) in enumerate(blocks):
        branch = bool(kinds[k])
        inside[k] = up[k] >= 0 and inside[up[k]] and node.lean >= 0 or branch and node.tag not in WHOLE - set(FOR) and up[k] >= 0 and node.lean >= 0 and composite[k] >= IMPORTANT
        least = LEAST_AGAINST if node.lean < 0 else LEAST_INSIDE if inside[k] else LEAST
        if (own[k] if own[k] is not None else 1.0) < least:
            out.add(id(node))
    return out


def main_text(every: list[Node], known: dict[int, tuple[float | None, float | None, float]] | None = None) -> str:
    """Blocks of text in page order, joined by a line feed, without the branches that are removed; known as for removed."""
    gone = removed(every, known or {})
    blocks: list[str] = []
    own: list[str] = []

    def flush() -> None:
        if own and (text := _clean("".join(own))):
            blocks.append(text)
        own.clear()

    stack: list = [(x, id(every[0]) not in gone) for x in reversed(every[0].parts)]
    while stack:
        part, stays = stack.pop()
        if part is None:
            flush()
        elif type(part) is str:
            if stays:
                own.append(part)
        elif part.bad:
            if part.tag not in INLINE and part.tag not in RAW:
                flush()
        elif part.tag == "br":
            own.append(" ")
        elif _is_inline(part):
            stack += [(x, stays) for x in reversed(part.parts)]
        else:
            keep = id(part) not in gone
            if part.tag not in INLINE:
                flush()
                stack.append((None, keep))
            stack += [(x, keep) for x in reversed(part.parts)]
    flush()
    return "\n".join(blocks)


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node, kind, value, times (pages) of each batch's pages together."""
    for batch in batches:
        found: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for row in statistics(html, host):
                found[host, *row] += 1
        columns = list(zip(*((*k, v) for k, v in found.items()), strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "node", "kind", "value", "times"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, content, shape, weight of pages(host, html): the importance of each host's nodes and how many pages say so.

    content or shape is null for a node that has no text or no child elements; nodes of which one page only is known are left out.
    """
    seen = pages.mapInArrow(_node_rows, "host string, node long, kind int, value long, times long")
    seen = checkpointed(seen.groupBy("host", "node", "kind", "value").agg(F.sum("times").alias("n")))

    def shares(rows: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
        share = lambda kind: F.exp(-of(kind, F.col("n") * F.log("n")) / of(kind, F.col("n")))
        return rows.groupBy(*keys).agg(share(CONTENT).alias(f"content_{suffix}"), share(SHAPE).alias(f"shape_{suffix}"), (of(PAGES, F.col("n")) - 1).alias(f"pages_{suffix}"))

    own = shares(seen, ["host", "node"], "own")
    every = checkpointed(shares(seen.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")), ["node"], "every").where("pages_every > 0"))
    every = F.broadcast(every) if every.count() <= BROADCAST_NODES else every
    others = F.least("pages_every", F.lit(OTHER_PAGES))
    weight = F.col("pages_own") + others
    mixed = lambda name: ((F.col(f"{name}_own") * F.col("pages_own") + F.col(f"{name}_every") * others) / weight).alias(name)
    return own.join(every, "node").where(weight > 0).select("host", "node", mixed("content"), mixed("shape"), weight.cast("double").alias("weight"))


def host_of(url: str = "url") -> Column:
    """Lower-case host of a URL, empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(k, name) for k, html in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) for name in {n for _, n in blocks_of(parse(html))}]
        hosts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([hosts[k] for k, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["page", "host", "node"])


def with_nodes(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """page_id, url, html of rows, with nodes, what the tree says of nodes that the page may have.

    A tree that is small is broadcast, by host; of a larger one each page gets its own nodes by two joins, so a large host is no large row.
    """
    fact = F.struct("node", "content", "shape", "weight")
    none = F.array().cast("array<struct<node: bigint, content: double, shape: double, weight: double>>")
    nodes, of_a_host = tree.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (nodes or 0) <= BROADCAST_NODES and (of_a_host or 0) <= NODES_OF_A_HOST:
        rows = rows.join(F.broadcast(tree.groupBy("host").agg(F.collect_list(fact).alias("nodes"))), "host", "left")
    else:
        # Rows are told apart by a hash of all that matters here; equal rows have the same nodes.
        rows = rows.withColumn("page", F.xxhash64("page_id", "host", "html"))
        own = rows.select("page", "host", "html").mapInArrow(_page_nodes, "page long, host string, node long").distinct()
        own = own.join(tree, ["host", "node"]).groupBy("page").agg(F.collect_list(fact).alias("nodes"))
        rows = rows.join(own, "page", "left")
    return rows.select("page_id", "url", "html", F.coalesce("nodes", none).alias("nodes"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html).

    text is the page's main text, its blocks joined by one line feed, empty if there is none; n_chars counts its characters. A null
    html is empty; a page without a host shares the style tree of all such pages; repeated rows have the same text (and count as
    pages of their host); other columns are ignored; an empty table gives an empty one.
    """
    small_arrow_batches(pages)
    rows = pages.select("page_id", "url", host_of().alias("host"), text_or_empty("html").alias("html"))
    tree = checkpointed(style_tree(rows.select("host", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for batch in batches:
            texts = []
            for html, nodes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if last is None or not nodes.equals(last):
                    own = nodes.values
                    last, known = nodes, dict(zip(own.field(0).to_pylist(), zip(*(own.field(k).to_pylist() for k in (1, 2, 3)), strict=True), strict=True))
                texts.append(main_text(parse(html), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return with_nodes(rows, tree).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
