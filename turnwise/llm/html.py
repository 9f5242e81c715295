"""Main text of web pages by the style trees of their hosts."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns, small_batches
from turnwise.llm.urls import host_of
from turnwise.plans.cut import cut

BATCH = 4 << 20
GAMMA = 0.9
#: What the tree of a host says of its nodes: presentation, content, pages.
Tree = dict[bytes, tuple[float, float | None, int]]
BROADCAST_NODES = 200_000  # of at most 20 bytes and a host name each
LEAST_IMPORTANCE = 0.2
HIGH_CONTENT = 0.8
#: Pages that say nothing are added to every node: with few pages of its own it is neither low nor high, and each page more shifts that a little.
UNSEEN_PAGES = 2.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr").split())
#: Tags and words of class, id and role that stand for menus, headers, footers, sidebars, notices, adverts, forms and comments.
NOISE_TAGS = frozenset(("nav footer aside form button select dialog menu head script style noscript template textarea title iframe svg "
                        "object audio video canvas map").split())
NOISE_WORDS = frozenset(("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
                         "cookies disqus footer header masthead menu nav navbar navigation newsletter notice paywall popup promo promotion "
                         "recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
                         "toolbar widget").split())
#: Words that may stand beside those in a name without changing what it says: site-header, sidebar-left.
NOISE_FILLERS = frozenset(("area bar block bottom box buttons col column container content desktop group inner item items left links list "
                           "main mobile outer page primary right secondary section site slot small sticky top wrap wrapper").split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSED_BY = {"p": frozenset(("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                             "hr main nav ol p pre section table ul").split()),
             "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
             "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
#: Which open elements a start tag closes.
CLOSERS = {tag: frozenset(k for k, by in CLOSED_BY.items() if tag in by) for tag in frozenset().union(*CLOSED_BY.values())}
#: Elements at which an end tag or a start tag stops closing others.
SCOPE = frozenset(("table", "td", "th", "body", "html", "article", "main", "section", "div", "ul", "ol"))
#: Comments, declarations and tags. Quotes count only around a value, right after its `=`; what is not closed ends with the page.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?|=)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_PARTS = re.compile(r"[^\W\d_]+")


class Node:
    """An element: tag, name with class, id and role, key (a digest of the names from the root), depth, children in order.
    `prior` is 0 for noise, 1 for main text, None if markup does not settle it; `holds` tells of an article or main element
    below, `inside` of one around or itself, `doubt` of a name that stands for noise, here or, as 1, above. `chars` counts the
    text below. `low` and `high` are what the tree of the host says of it."""
    __slots__ = ("tag", "name", "key", "depth", "children", "prior", "holds", "inside", "doubt", "chars", "low", "high")

    def __init__(self, tag: str, name: str, above: Node | None):
        self.tag, self.name, self.children, self.prior, self.holds = tag, name, [], None, False
        self.key, self.depth = (digest(above.key + name.encode("utf-8", "surrogatepass")), above.depth + 1) if above else (b"", 0)
        self.inside, self.doubt, self.chars, self.low, self.high = False, 0, 0, False, None


def _named(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        if k.lower() in ("class", "id", "role"):
            found.setdefault(k.lower(), " ".join(sorted((a or b or c).lower().split())))
    return tag + "".join(f"[{k}={v}]" for k, v in sorted(found.items()) if v)


def _noise_tag(node: Node, inside: bool) -> bool:
    return node.tag in NOISE_TAGS or (node.tag == "header" and not inside)


def _noise_name(node: Node, inside: bool) -> bool:
    """Whether a whole class, id or role stands for noise: all its parts do, but for fillers, and one at least."""
    if node.tag in MAIN_TAGS or node.holds or "[" not in node.name or node.tag in ("html", "body"):
        return False
    for token in (t for part in node.name.split("[")[1:] for t in part.rstrip("]").partition("=")[2].split()):
        words = set(_PARTS.findall(token)) - NOISE_FILLERS
        if words and words <= NOISE_WORDS and not (inside and words == {"header"}):
            return True
    return False


def _judge(order: list[Node]) -> None:
    """Priors of the elements, which stand in page order. What is below noise is noise, also within main text; an
    element around an article is no noise by its name. A name alone does not settle it for an element that holds more
    than half of the text, unless it stands outside the articles of a page that has some."""
    for node in reversed(order):
        node.holds = any(isinstance(c, Node) and (c.holds or c.tag in MAIN_TAGS) for c in node.children)
    articles = order[0].holds
    for node in order:
        for child in node.children:
            if isinstance(child, Node):
                child.inside = node.inside or child.tag in MAIN_TAGS
                if node.prior == 0 or _noise_tag(child, node.inside):
                    child.prior = 0
                elif _noise_name(child, node.inside):
                    child.prior, child.doubt = None if child.inside or not articles else 0, 2
                else:
                    child.doubt = min(node.doubt, 1)
                    child.prior = 1 if child.inside and not child.doubt else None
    if not any(node.doubt == 2 and node.prior is None for node in order):
        return
    for node in reversed(order):
        node.chars = sum((0 if c.prior == 0 else c.chars) if isinstance(c, Node) else len(c.strip()) for c in node.children)
    for node in order:
        for child in node.children:
            if isinstance(child, Node) and (node.prior == 0 or child.doubt == 2 and 2 * child.chars <= order[0].chars):
                child.prior = 0


class _Stack:
    """Open elements, with how many of each tag are open, in all and since the last element of SCOPE."""

    def __init__(self, root: Node):
        self.open, self.tags, self.scopes, self.scope_tags = [root], Counter(), [Counter()], [""]

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.tags[node.tag] += 1
        if node.tag in SCOPE:
            self.scopes.append(Counter())
            self.scope_tags.append(node.tag)
        else:
            self.scopes[-1][node.tag] += 1

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.tags[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
            self.scope_tags.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def close(self, tags: frozenset[str], anywhere: bool = False) -> None:
        """Close the innermost of the open elements with one of these tags, and all in it; if there is none, or only one beyond
        the last element of SCOPE, nothing."""
        if (not anywhere and self.scope_tags[-1] in tags) or any((self.tags if anywhere else self.scopes[-1])[t] > 0 for t in tags):
            while self.pop() not in tags:
                pass


def parse(source: str) -> Node:
    """The tree of a page; text stands between the children as strings with character references decoded. Unclosed
    and stray tags are put right the way browsers do for paragraphs, items and cells. Time and memory grow with the page, not
    with how deep its elements lie."""
    root = Node("", "", None)
    stack, order, at = _Stack(root), [root], 0

    def text(upto: int) -> None:
        if upto > at:
            stack.open[-1].children.append(html.unescape(source[at:upto]))
    end = len(source)
    while at < end:
        match = _TOKEN.search(source, at)
        if match is None:
            text(end)
            break
        text(match.start())
        at, tag = match.end(), (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            stack.close(frozenset((tag,)), anywhere=tag not in INLINE and tag != "p")
            continue
        if tag in CLOSERS:
            stack.close(CLOSERS[tag])
        above = stack.open[-1]
        node = Node(tag, _named(tag, match[3]), above)
        above.children.append(node)
        order.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>|\Z", re.I).search(source, at)
            at = close.end()
        elif tag not in VOID and not match[3].endswith("/"):
            stack.push(node)
    _judge(order)
    return root


def blocks(root: Node) -> list[tuple[Node, str]]:
    """(block element, text) in page order: runs of text and inline elements between block borders, white space made
    one blank. Elements of prior 0, those that the tree finds low and those named as noise that it does not find high are left out
    with all below them; before a page is weighed, none of the latter two."""
    found, run = [], []

    def close(owner: Node) -> None:
        said = " ".join("".join(run).split())
        run.clear()
        if said:
            found.append((owner, said))
    todo: list = [(root, iter(root.children), root)]
    while todo:
        node, rest, owner = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
            if node is owner:
                close(owner)
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif child.prior == 0 or child.low or (child.doubt == 2 and child.high is False):
            if child.tag not in INLINE and child.tag not in RAW:
                close(owner)
        elif child.tag in INLINE and not any(isinstance(c, Node) and c.tag not in INLINE for c in child.children):
            todo.append((child, iter(child.children), owner))
        else:
            close(owner)
            todo.append((child, iter(child.children), child))
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def weigh(root: Node, tree: Tree) -> None:
    """Set `low` and `high` of the elements that markup does not settle from what the tree of the host says of them.

    From the leaves up: importance = (1 - GAMMA^depth) * presentation + GAMMA^depth * mean of what is below, which is the
    content of the element's own text and the importance of its children; without any, presentation alone. An element is low if
    this is below LEAST_IMPORTANCE and all its children are low too. It is high if content, its own and below, is HIGH_CONTENT on average.
    A node on m pages counts as m / (m + UNSEEN_PAGES) of what is known and for the rest as important, but not as high.
    """
    order, importance, own = open_nodes(root), {}, {}
    for node in reversed(order):
        presentation, content, pages = tree.get(node.key, (1.0, None, 0))
        known = pages / (pages + UNSEEN_PAGES)
        children = [c for c in node.children if isinstance(c, Node) and id(c) in importance]
        below = [importance[id(c)] for c in children]
        said = [own[id(c)] for c in children if own[id(c)] is not None]
        if content is not None:
            below.append(1 - known * (1 - content))
            said.append(known * content)
        shown, weight = 1 - known * (1 - presentation), GAMMA ** node.depth
        importance[id(node)] = (1 - weight) * shown + weight * sum(below) / len(below) if below else shown
        own[id(node)] = sum(said) / len(said) if said else None
        node.low = importance[id(node)] < LEAST_IMPORTANCE and all(c.low for c in children)
        node.high = bool(said) and own[id(node)] >= HIGH_CONTENT


def main_text(root: Node, tree: Tree | None = None) -> str:
    """Blocks joined by a line feed, by what the tree of the host says. A page that has article or main elements gives the blocks
    inside them, and of those outside the ones whose elements are high, or all if they hold more text than the blocks inside;
    any other page gives all blocks that are left."""
    weigh(root, tree or {})
    kept = blocks(root)
    inside = sum(len(said) for node, said in kept if node.inside)
    outside = sum(len(said) for node, said in kept) - inside
    if inside and outside <= inside:
        kept = [(node, said) for node, said in kept if node.inside or node.high]
    return "\n".join(said for _, said in kept)


def open_nodes(root: Node) -> list[Node]:
    """The elements that markup does not settle and that hold no article or main element, each before those below it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag and node.prior is None and not node.holds:
            found.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.prior != 0]
    return found


def style_rows(root: Node) -> list[tuple[bytes, bytes | None, bytes | None]]:
    """What a page adds to the style tree of its host: (node, style, content). A style is the sequence of an element's
    children, repeats taken together; a content is a text block of the element itself."""
    rows: dict[tuple, None] = {}
    nodes = open_nodes(root)
    for node in nodes:
        names = [c.name if isinstance(c, Node) else "#" for c in node.children if isinstance(c, Node) or c.strip()]
        style = " ".join(n for i, n in enumerate(names) if i == 0 or n != names[i - 1])
        rows[node.key, digest(style.encode("utf-8", "surrogatepass")), None] = None
    if nodes:
        judged = {n.key for n in nodes}
        for node, said in blocks(root):
            if node.key in judged:
                rows[node.key, None, digest(said.encode("utf-8", "surrogatepass"))] = None
    return list(rows)


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts of `pages` (host, html): one row (host, node, pages, presentation, content) for each element
    key without a prior.

    presentation = entropy of the styles a node has on the pages of its host, to the base of their number;
    content = 1 - mean entropy of its text blocks, a block on c of m pages having log c / log m, null without text. Text that every
    page repeats has none, text that each page says anew has most. All of it is grouped sums over (host, node, feature), each
    page adding a row per feature, so no task holds a host or its tree, and a page of any depth adds as many rows as it has
    elements and blocks.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "html", BATCH):
            counted: Counter = Counter()
            for host, source in zip(frame.host, frame.html):
                counted.update((host, *row) for row in style_rows(parse(source)))
            yield pd.DataFrame([(*key, n) for key, n in counted.items()], columns=["host", "node", "style", "content", "n"])
    features = (pages.mapInPandas(run, "host string, node binary, style binary, content binary, n bigint")
                .groupBy("host", "node", "style", "content").agg(F.sum("n").alias("n")))
    is_style = F.col("style").isNotNull()
    nodes = features.groupBy("host", "node").agg(
        F.sum(F.when(is_style, F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(is_style, F.col("n") * F.log("n")).otherwise(0.0)).alias("style_logs"),
        F.sum(F.when(~is_style, F.log("n"))).alias("content_logs"), F.sum(F.when(~is_style, 1)).alias("contents"))
    m = F.col("pages")
    presentation = F.when(m > 1, (F.log(m) - F.col("style_logs") / m) / F.log(m)).otherwise(1.0)
    content = F.when(m > 1, 1 - F.least(F.lit(1.0), F.col("content_logs") / F.col("contents") / F.log(m))).otherwise(1.0)
    return nodes.select("host", "node", "pages", presentation.alias("presentation"), F.when(F.col("contents").isNotNull(), content).alias("content"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (main text) of every row of `pages` (page_id, url, html).

    Markup decides first: nav, footer, forms and scripts go, article and main stay. All other elements go, with what is
    below them, if the style tree of their host finds them low (`weigh`). Elements with a class, id or role that names noise go
    too, unless they hold most of a page's text and the tree finds them high; such content stays outside articles as well. Up
    to BROADCAST_NODES nodes that several pages have are broadcast; a larger tree meets the pages node by node.

    Null html is empty; pages without text give an empty string. A url without host has the empty host, a tree like any
    other. Repeated rows come out as often as they go in. Quotes count only around the values of attributes, unclosed comments, tags
    and scripts end with the page, and pages nested to any depth take time in proportion to their length.
    """
    own = columns(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    hosted = own.withColumn("host", host_of(F.col("url")))
    tree = cut(style_tree(hosted.select("host", "html")).filter("pages > 1"))
    if tree.count() <= BROADCAST_NODES:
        hosts: dict[str, Tree] = {}
        for r in tree.toLocalIterator():
            hosts.setdefault(r.host, {})[bytes(r.node)] = (r.presentation, r.content, r.pages)
        shared = pages.sparkSession.sparkContext.broadcast(hosts)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in small_batches(frames, "html", BATCH):
                text = [main_text(parse(source), shared.value.get(host)) for source, host in zip(frame.html, frame.host)]
                yield pd.DataFrame({"page_id": frame.page_id, "url": frame.url, "text": text})
        return hosted.select("page_id", "url", "html", "host").mapInPandas(run, "page_id bigint, url string, text string")

    def run_noted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "html", BATCH):
            text = [main_text(parse(source), {bytes(x["node"]): (x["presentation"], x["content"], x["pages"]) for x in ([] if found is None else found)})
                    for source, found in zip(frame.html, frame.found)]
            yield pd.DataFrame({"page_id": frame.page_id, "url": frame.url, "text": text})
    return _noted(hosted, tree).select("page_id", "url", "html", "found").mapInPandas(run_noted, "page_id bigint, url string, text string")


def _noted(hosted: DataFrame, tree: DataFrame) -> DataFrame:
    """`hosted` with what the tree says of each page's own nodes, `found`, for trees too large to broadcast: nodes of the pages meet
    those of the tree on (host, node), and the lists meet the pages by a hash of their content."""
    keyed = hosted.withColumn("page", F.xxhash64("page_id", "url")).withColumn("check", F.xxhash64("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "html", BATCH):
            rows = [(p, c, h, k) for p, c, h, source in zip(frame.page, frame["check"], frame.host, frame.html)
                    for k in {n.key for n in open_nodes(parse(source))}]
            yield pd.DataFrame(rows, columns=["page", "check", "host", "node"])
    asked = keyed.select("page", "check", "host", "html").mapInPandas(run, "page bigint, check bigint, host string, node binary")
    lists = asked.join(tree, ["host", "node"]).groupBy("page", "check").agg(
        F.collect_set(F.struct("node", "presentation", "content", "pages")).alias("found"))
    return keyed.join(lists, ["page", "check"], "left")
