"""Main-text extraction by site style trees.

Pages of one host are merged into a style tree.  A node stands for the elements that pages show at one place: the path of (tag, class, id) from
the root, with the ordinal of each run of equal siblings.  A node's styles are the sequences of its children's signatures (runs collapsed), its
content is the text blocks, link targets and images at most DEPTH levels below it, all by hash.  With m pages that show the node:

* presentation importance: the entropy (base m) of its styles over the pages;
* content importance: 1 - the mean, over occurrences of features, of log_m(pages with that feature) - the entropy of a feature that
  is spread evenly over the pages that have it;
* importance on its host = (1 - g**l) * presentation + g**l * content, for l styles and g = DAMPING.

One page says nothing about importance and a few say little, so hosts back off to a pooled tree: elements with the same tag, class and id on all hosts have a mean importance,
itself held to PRIOR where few pages show them, and a node's importance is the mean of both with m - 1 pages against HOST_WEIGHT.  Elements without class and id are too general for the pool and back off to PRIOR.

Importance then decides with what tags and names say as a weight: an element goes if importance + weight < LOW.  Names of things that vary from page to page as an article does, and so look important
(reader comments, related links, advertisements, menus of the section), weigh so much that they decide alone; weaker names need low importance besides.  A name counts only where it
is what the class or id names: the last word of ``share-price-report`` is a report.  Elements that enclose an article or main element never go, what these enclose goes only by strong names
(copies of one page on a host would look like a frame around the others).

Statistics are counted per task, then summed by node, so a host with any share of the pages is no hot group.  Decisions go to all
executors while there are at most ``broadcast_nodes`` of them (checked by a count); beyond that they are joined to the pages' nodes.

Text: character references decoded, white space inside a block made one space, blocks joined by two line ends in page order.

Defined cases: null, empty or text-less html gives an empty text; a null url is a host of its own per page, without statistics; repeated rows
give repeated results (and count as pages); an empty table gives an empty table; other columns are never read.  Time and memory are linear in a page's size, however deep its elements lie.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.common import batch_of, cut, read_table, small_batches

DAMPING, LOW, PRIOR, HOST_WEIGHT, POOL_WEIGHT = 0.9, 0.5, 0.8, 3.0, 5.0
#: weights of what names say, by class of name: nothing, good, weak, strong
WEIGHTS = (0.0, 0.2, -0.35, -1.0)
PLAIN, GOOD, WEAK, STRONG = range(4)
DEPTH = 12

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg object select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main"
    " menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: an element that begins ends an open one of these, up to the given containers
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
NOISE_TAGS = frozenset("nav footer aside form dialog button menu head search".split())
HOLDERS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notification alert popup modal overlay"
    " nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar sidenav rail aside footer foot colophon copyright masthead topbar comment comments commentlist disqus respond reply replies"
    " share sharing social subscribe subscription newsletter signup login search related recommended recommendations widget widgets pager pagination toolbar tagcloud".split()
)
WEAK_WORDS = frozenset("header head hero meta byline notice notices legal tags promoted more".split())
GOOD_WORDS = frozenset("article content main body post entry story text prose".split())
#: words that say where or in what form something stands, not what it is
NEUTRAL = frozenset(
    "box wrap wrapper container block section area inner outer item items list column col row grid panel group site page primary secondary top bottom left right center buttons button icons links link bar"
    " posts articles stories content text form desktop mobile global local sticky fixed small large new".split()
)
#: tokens that begin or end so tell of a state, not of what the element is
_STATE = re.compile(r"^(?:has|is|no|with|without|js|not|hide|show)[-_]|[-_](?:open|opened|closed|enabled|disabled|on|off|active|inactive|visible|loaded)$", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "up", "key", "pool", "name", "holds", "heads")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.children, self.up = tag, attrs, [], up
        self.key = self.pool = self.name = 0
        #: encloses (or is) an article or main element; encloses a heading
        self.holds = self.heads = False


def parse(text: str) -> Node:
    """A tree of elements; children are elements and strings, void elements (img, br, hr) too."""
    root = Node("#root", {}, None)
    stack = [root]
    opened: Counter = Counter()  # so that ends of elements that are not open cost nothing
    at, n = 0, len(text)

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    while at < n:
        found = _TAG.search(text, at)
        if not found:
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag does not end a block
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _ENDS:
            ended, until = _ENDS[tag]
            least, left = None, sum(opened[x] for x in ended)
            for i in range(len(stack) - 1, 0, -1) if left else ():
                if stack[i].tag in until:
                    break
                if stack[i].tag in ended:
                    least, left = i, left - 1
                    if not left:
                        break
            if least is not None:
                close(least)
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        raw = found[3] if found[2] else found[6]
        attrs = {}
        if raw and not raw.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                attrs.setdefault(name.lower(), a or b or c)
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if tag in HOLDERS:
            _mark(node, "holds")
        elif tag in ("h1", "h2"):
            _mark(node.up, "heads")
        stack.append(node)
        opened[tag] += 1
    else:
        return root
    if at < n:
        stack[-1].children.append(text[at:])
    return root


def _mark(node: Node | None, what: str) -> None:
    """Mark an element and all above it."""
    while node is not None and not getattr(node, what):
        setattr(node, what, True)
        node = node.up


def signature(node: Node) -> str:
    a = node.attrs
    return f"{node.tag}.{a.get('class', '')}#{re.sub(r'[0-9]+', '0', a.get('id', ''))}" if a else node.tag


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def structural(node: Node) -> bool:
    return node.tag in BLOCK


def number(node: Node, key: int) -> list[Node]:
    """Give structural elements their place in the host's tree and in the pool; these elements."""
    out, todo = [], [(node, key)]
    while todo:
        node, key = todo.pop()
        node.key = key
        runs: Counter = Counter()
        before = None
        for child in _elements(node):
            s = signature(child)
            if s != before:
                runs[s] += 1
            before = s
            child.name = name_of(child)
            child.pool = _hash("pool", s) if child.attrs.get("class") or child.attrs.get("id") else 0
            out.append(child)
            todo.append((child, _hash(key, s, runs[s])))
    return out


def _elements(node: Node) -> list[Node]:
    """The structural elements directly below, inline elements looked through."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, Node):
            if structural(child):
                out.append(child)
            else:
                todo.extend(reversed(child.children))
    return out


def style(node: Node) -> int:
    seen = []
    for child in _elements(node):
        s = signature(child)
        if not seen or seen[-1] != s:
            seen.append(s)
    return _hash("style", *seen)


def _token(token: str) -> int:
    """What one class or id says."""
    if _STATE.search(token):
        return PLAIN
    words = [w.lower() for w in _WORD.findall(token)]
    own = [w for w in words if w not in NEUTRAL]
    if own and (own[-1] in NOISE_WORDS or own[-1] in WEAK_WORDS and own[0] in NOISE_WORDS):
        return STRONG
    if own and own[-1] in WEAK_WORDS:
        return WEAK
    return GOOD if words and words[-1] in GOOD_WORDS else PLAIN


def name_of(node: Node) -> int:
    """What tag, role and names say by themselves."""
    tag, a = node.tag, node.attrs
    if tag in NOISE_TAGS or tag == "header":
        return STRONG
    if not a:
        return PLAIN
    if "hidden" in a or a.get("aria-hidden") == "true" or "style" in a and re.search(r"display\s*:\s*none", a["style"]):
        return STRONG
    if a.get("role", "").lower() in NOISE_ROLES:
        return STRONG
    if tag in HOLDERS or tag in ("html", "body"):
        return PLAIN
    found = {_token(t) for t in f"{a.get('class', '')} {a.get('id', '')}".split()}
    return STRONG if STRONG in found else GOOD if GOOD in found else WEAK if WEAK in found else PLAIN


def stays(node: Node, inside: bool) -> bool:
    """Whether an element never goes: it encloses an article or main element, is a page's frame, or the heading part of an article."""
    return node.holds or node.tag in ("html", "body") or node.tag == "header" and inside and node.heads


def clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split()) if "&" in text else " ".join(text.split())


def blocks(node: Node, dropped=lambda node, inside: False) -> list[str]:
    """Text blocks of a tree without the dropped elements."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = clean("".join(now))
            if text:
                out.append(text)
            now.clear()

    todo: list = [(node, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in RAW or dropped(x, inside):
            if structural(x):
                flush()
        else:
            block = structural(x)
            if block:
                flush()
                todo.append((None, inside))
            inside = inside or x.tag in HOLDERS
            todo.extend((child, inside) for child in reversed(x.children))
    flush()
    return out


def site(url: str | None) -> str | None:
    """Host of a url: lower case, without user, port and a leading www."""
    if not url:
        return None
    rest = url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    host = rest.rsplit("@", 1)[-1].split(":", 1)[0].lower().rstrip(".")
    return host.removeprefix("www.") or None


def evidence(root: Node) -> set[tuple[int, int, int]]:
    """(node, kind, feature) of one page: kind 0 the node is shown (feature: its place in the pool, and its class of name in the last two bits), 1 its style, 2 features of its content.

    Only nodes that importance may remove have evidence.
    """
    seen: set[tuple[int, int, int]] = set()
    todo: list[tuple[Node, tuple[int, ...]]] = [(root, ())]
    while todo:
        node, above = todo.pop()
        if node.tag in RAW or node.tag == "head" or node.tag in HOLDERS:
            continue
        if structural(node):
            if not stays(node, False):
                above = (*above[1 - DEPTH :], node.key)
                seen.add((node.key, 0, (node.pool & ~3) | node.name))
                seen.add((node.key, 1, style(node)))
            for text in _own_text(node) if above else ():
                f = _hash("text", text)
                seen.update((key, 2, f) for key in above)
        elif above and node.tag in ("a", "img"):
            target = node.attrs.get("href") or node.attrs.get("src")
            if target:
                f = _hash("link", target)
                seen.update((key, 2, f) for key in above)
        todo.extend((child, above) for child in node.children if isinstance(child, Node))
    return seen


def _own_text(node: Node) -> list[str]:
    """Texts directly in a structural element, inline elements looked through, cut at structural children."""
    out, now, todo = [], [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif structural(x):
            out.append(clean("".join(now)))
            now = []
        elif x.tag not in RAW:
            now.append(" ") if x.tag == "br" else todo.extend(reversed(x.children))
    out.append(clean("".join(now)))
    return [t for t in out if t]


def _statistics(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        counts.clear()
        return batch_of(["node", "kind", "feature", "n"], [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array(n, pa.int64())])

    for batch in batches:
        for url, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            host = site(url)
            if text and host:
                root = parse(text)
                number(root, _hash("host", host))
                counts.update(evidence(root))
            if len(counts) > most:
                yield out()
    yield out()


def importance(pages: DataFrame) -> DataFrame:
    """node, pages, pool, name, own (importance on the host, null for one page), pooled and importance of all nodes."""
    rows = pages.mapInArrow(_statistics, "node long, kind int, feature long, n long").groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    log = F.log(F.col("n").cast("double"))
    nodes = rows.groupBy("node").agg(
        of(0, F.col("n")).alias("m"), F.max(F.when(F.col("kind") == 0, F.col("feature"))).alias("place"), of(1, F.lit(1)).alias("styles"), of(1, F.col("n") * log).alias("style_sum"),
        F.coalesce(of(2, F.col("n")), F.lit(0)).alias("total"), of(2, F.col("n") * log).alias("content_sum"),
    )
    m = F.log(F.col("m").cast("double"))
    presentation = 1 - F.col("style_sum") / (F.col("m") * m)
    content = F.when(F.col("total") > 0, 1 - F.col("content_sum") / (F.col("total") * m)).otherwise(0.0)
    weight = F.pow(F.lit(DAMPING), F.col("styles"))
    own = F.when(F.col("m") > 1, (1 - weight) * presentation + weight * content)
    place = F.col("place")
    nodes = nodes.select("node", F.col("m").alias("pages"), place.bitwiseAND(~3).alias("pool"), place.bitwiseAND(3).cast("int").alias("name"), own.alias("own"))
    said = (F.col("pages") - 1).cast("double")
    pool = nodes.where("own is not null and pool != 0").groupBy("pool").agg(((F.sum(said * F.col("own")) + POOL_WEIGHT * PRIOR) / (F.sum(said) + POOL_WEIGHT)).alias("pooled"))
    both = nodes.join(pool, "pool", "left").withColumn("pooled", F.coalesce("pooled", F.lit(PRIOR)))
    return both.withColumn("importance", (F.coalesce(said * F.col("own"), F.lit(0.0)) + HOST_WEIGHT * F.col("pooled")) / (said + HOST_WEIGHT))


def decisions(pages: DataFrame) -> DataFrame:
    """place, goes: for places in the pool that differ from what names alone say, and for nodes of which their host says otherwise than the pool."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("name") + 1)
    found = importance(pages).where(F.col("name") != STRONG)
    found = found.select("node", "pool", (PRIOR + weight < LOW).alias("plain"), (F.col("pooled") + weight < LOW).alias("pool_goes"), (F.col("importance") + weight < LOW).alias("goes"))
    found, _ = cut(found.where("goes != plain or pool_goes != plain"), "style-nodes")
    pools = found.where("pool_goes != plain").select(F.col("pool").alias("place"), F.col("pool_goes").alias("goes")).distinct()
    return pools.union(found.where("goes != pool_goes").select(F.col("node").alias("place"), "goes"))


class Decisions:
    """Places with a decision, as sorted arrays."""

    def __init__(self, places: np.ndarray, goes: np.ndarray):
        order = np.argsort(places)
        self.places, self.goes = places[order], goes[order]

    def of(self, keys: list[int]) -> np.ndarray:
        """1 goes, 0 stays, -1 nothing is said."""
        keys = np.array(keys, np.int64)
        if not len(self.places):
            return np.full(len(keys), -1, np.int8)
        at = np.minimum(np.searchsorted(self.places, keys), len(self.places) - 1)
        return np.where(self.places[at] == keys, self.goes[at], -1).astype(np.int8)


def main_text(text: str | None, url: str | None, tree: Decisions | None = None, names: bool = True) -> str:
    """The text of one page; without ``tree`` names decide alone, without ``names`` the tree does."""
    if not text:
        return ""
    root = parse(text)
    host = site(url)
    nodes = number(root, _hash("host", host or ""))
    plain = [names and PRIOR + WEIGHTS[x.name] < LOW for x in nodes]
    if tree is None:
        low = {id(x) for x, p in zip(nodes, plain) if p}
    else:
        said = zip(nodes, tree.of([x.key for x in nodes] if host else [0] * len(nodes)).tolist(), tree.of([x.pool & ~3 for x in nodes]).tolist(), plain)
        low = {id(x) for x, own, pool, p in said if (own if own >= 0 else pool if pool >= 0 and x.pool else p)}

    def goes(x: Node, inside: bool) -> bool:
        if not structural(x):
            return names and not x.holds and name_of(x) == STRONG
        if stays(x, inside):
            return False
        return names and x.name == STRONG or not inside and x.tag != "h1" and id(x) in low

    found = blocks(root, goes)
    if not found:  # all was of low importance: what strong names leave
        low.clear()
        found = blocks(root, goes)
    return "\n\n".join(found)


def extract(pages: DataFrame, broadcast_nodes: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    said, _ = cut(decisions(pages), "style-decisions")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"

    def texts(batch: pa.RecordBatch, each: Iterable[Decisions]) -> pa.RecordBatch:
        got = [main_text(h, u, x) for u, h, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), each)]
        return batch_of(["page_id", "url", "text", "n_chars"], [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())])

    if said.count() <= broadcast_nodes:
        own = said.toArrow()  # at most ``broadcast_nodes`` rows of nine bytes
        shared = spark.sparkContext.broadcast(Decisions(own.column(0).to_numpy(), own.column(1).to_numpy()))
        return pages.mapInArrow(lambda batches: (texts(b, [shared.value] * b.num_rows) for b in batches), schema)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for url, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = number(parse(text), _hash("host", site(url) or "")) if text else []
                out.append(sorted({x.key for x in own} | {x.pool & ~3 for x in own if x.pool}))
            yield batch_of(["page", "nodes"], [batch.column(3), pa.array(out, pa.list_(pa.int64()))])

    keyed = pages.withColumn("page", F.sha2(F.concat_ws("\0", F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))), 256))
    shown = keyed.mapInArrow(nodes, "page string, nodes array<long>").select("page", F.explode("nodes").alias("place")).distinct()
    per_page = shown.join(said, "place").groupBy("page").agg(F.collect_list(F.struct("place", "goes")).alias("said"))  # at most the page's own nodes
    joined = keyed.join(per_page, "page", "left").select("page_id", "url", "html", F.col("said.place").alias("places"), F.col("said.goes").alias("goes"))

    def each(batch: pa.RecordBatch) -> Iterator[Decisions]:
        for places, goes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            yield Decisions(np.array(places or [], np.int64), np.array(goes or [], bool))

    return joined.mapInArrow(lambda batches: (texts(b, each(b)) for b in batches), schema)


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(read_table(spark, sf_dir, "pages"))
