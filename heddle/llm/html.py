"""Operator 8: main text of web pages by wrapper induction.

Pages of one host share a template. Each page's DOM tree, with runs of like siblings folded, is
merged into its host's tree by simple tree matching: children are aligned in order so that most
nodes match, matched nodes add up their counts and lengths of text, others become optional nodes. Own text that is the
same on all pages of a host is template, be it of a node or of one among like siblings; own text that varies is a slot.

Which slots are the article follows from how much varies where, over all of the host's pages: from the root down, while one
container that each page has once holds most of the varying text that isn't links, that container is gone into. Where it ends is
the article's place; slots outside of it, and containers within it whose text is mostly links, aren't content. Tags and class names (navigation,
adverts, forms and the like) further exclude what they mark. Only where no container holds most of the text, article and main
elements choose among the slots that are left.

Trees are merged in each task first and then by host in two steps, so a host with very many pages
costs a row for each task. A template's size follows its distinct nodes, not the number of pages.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed lists of HTML: elements without content, with raw text, and those that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element that the start of another ends.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl select".split())
#: Tags and words of class, id or role that mark what isn't the article.
ASIDE_TAGS = frozenset("head nav footer aside form script style noscript iframe template svg math canvas button select textarea title object menu dialog input label option video audio".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Those that mark an article element too, which says itself that it is content of some kind.
ASIDE_ARTICLES = frozenset("ad ads advert adverts advertisement advertising comment comments promo promoted promotion related replies reply sponsor sponsored teaser teasers".split())
VARIES = -1
#: Distinct pages from which on a host's constant nodes count as template, and texts that stand anywhere on all of them; shares of varying text that make a container the article's place, and of
#: links that make one no content.
ENOUGH, MANY, MOST, LINKS = 3, 8, 0.6, 0.7


class Node:
    """An element; ``kids`` are elements and texts in order."""

    __slots__ = ("tag", "sign", "kids")

    def __init__(self, tag: str, sign: str):
        self.tag, self.sign, self.kids = tag, sign, []


def sign(tag: str, attributes: str) -> str:
    """Tag with class, id and role, without digits, so that generated names look alike."""
    if not attributes:
        return tag
    found = " ".join(sorted(re.sub(r"\d+", "", a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(attributes)))
    return f"{tag} {found}" if found else tag


def parse(page: str) -> Node:
    """Element tree of a page, however broken."""
    root = Node("", "")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            if at < n:
                stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break  # an inline end tag doesn't end a block
            continue
        ends = {"p"} if tag in BLOCK else set()
        ends |= ENDED.get(tag, set())
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag not in ("tr", "td", "th", "tbody"):
                        break
                elif stack[i].tag in SCOPE or (stack[i].tag in BLOCK and tag not in ENDED):
                    break
        node = Node(tag, sign(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


class Fold:
    """Like siblings as one node, or the same place on many pages: sign, pages, elements (``nodes``), own text (its checksum, 0 for
    none, VARIES), characters of own text and children in order."""

    __slots__ = ("sign", "pages", "nodes", "text", "chars", "kids", "of")

    def __init__(self, sign: str, pages: int, nodes: int, text: int, chars: int, kids: list[Fold], of: list[Node] | None = None):
        self.sign, self.pages, self.nodes, self.text, self.chars, self.kids, self.of = sign, pages, nodes, text, chars, kids, of

    def plain(self) -> list:
        """All nodes, parents first, in one flat list: trees may be deeper than JSON can nest."""
        out, steps = [], [self]
        while steps:
            x = steps.pop()
            out.append([x.sign, x.pages, x.nodes, x.text, x.chars, len(x.kids)])
            steps += reversed(x.kids)
        return out


def thaw(rows: list) -> Fold:
    top, open_ = None, []
    for *own, kids in rows:
        x = Fold(*own, [])
        if open_:
            open_[-1][0].kids.append(x)
            open_[-1][1] -= 1
        else:
            top = x
        while open_ and open_[-1][1] == 0:
            open_.pop()
        if kids:
            open_.append([x, kids])
    return top


def checksum(texts: list[str]) -> int:
    return crc32(" ".join(" ".join(texts).split()).encode("utf-8", "replace")) + 1 if texts else 0


def own_texts(node: Node) -> list[str]:
    return [k for k in node.kids if isinstance(k, str) and not k.isspace()]


def shape(node: Node, levels: int = 2) -> tuple:
    """What siblings must share to be folded: the sign, and of containers what they hold, two levels down."""
    kids = [k for k in node.kids if not isinstance(k, str)]
    holds = levels and any(k.tag in BLOCK for k in kids)
    return node.sign, frozenset(shape(k, levels - 1) for k in kids) if holds else None


def folded(nodes: list[Node]) -> Fold:
    groups: dict[tuple, list[Node]] = {}
    texts, kids = [], []
    for node in nodes:
        texts += own_texts(node)
        for k in node.kids:
            if not isinstance(k, str) and k.tag not in RAW:
                groups.setdefault(shape(k), []).append(k)
    for g in groups.values():
        kids.append(folded(g))
    return Fold(nodes[0].sign, 1, len(nodes), checksum(texts), sum(map(len, texts)), kids, nodes)


def all_texts(root: Node) -> set[int]:
    """Checksums of the elements' own texts."""
    out, steps = set(), [root]
    while steps:
        node = steps.pop()
        if texts := own_texts(node):
            out.add(checksum(texts))
        steps += [k for k in node.kids if not isinstance(k, str) and k.tag not in RAW]
    return out


Memo = dict[tuple[int, int], tuple[int, list[tuple["Fold | None", "Fold | None"]]]]


def aligned(a: list[Fold], b: list[Fold], memo: Memo) -> list[tuple[Fold | None, Fold | None]]:
    """Children in order, paired by simple tree matching: like signs only, most matched nodes."""
    if [x.sign for x in a] == [x.sign for x in b]:
        return list(zip(a, b, strict=True))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = {}
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i].sign == b[j].sign:
                gain[i, j] = match(a[i], b[j], memo)[0]
            best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + gain.get((i, j), 0))
    out, i, j = [], len(a), len(b)
    while i and j:
        if (i - 1, j - 1) in gain and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    out += [(x, None) for x in reversed(a[:i])] + [(None, x) for x in reversed(b[:j])]
    return out[::-1]


def match(a: Fold, b: Fold, memo: Memo) -> tuple[int, list]:
    """Nodes that the best alignment of two trees with like roots pairs, and how their children pair."""
    key = id(a), id(b)
    if key not in memo:
        pairs, n = aligned(a.kids, b.kids, memo), 1
        for x, y in pairs:
            if x is not None and y is not None:
                n += match(x, y, memo)[0]
        memo[key] = n, pairs
    return memo[key]


def merged(a: Fold, b: Fold, memo: Memo | None = None) -> Fold:
    memo = {} if memo is None else memo
    kids = [merged(x, y, memo) if x is not None and y is not None else x or y for x, y in match(a, b, memo)[1]]
    return Fold(a.sign, a.pages + b.pages, a.nodes + b.nodes, a.text if a.text == b.text else VARIES, a.chars + b.chars, kids)


class Template:
    """A host's merged tree, the checksums of own texts that all of its pages with any text have, and up to MANY distinct pages."""

    def __init__(self, tree: Fold, common: set[int] | None, seen: set[int]):
        self.tree, self.common, self.seen, self._place = tree, common, seen, None

    def add(self, other: Template) -> None:
        self.tree = merged(self.tree, other.tree)
        self.common = other.common if self.common is None else self.common if other.common is None else self.common & other.common
        self.seen = set(sorted(self.seen | other.seen)[:MANY])

    def dumps(self) -> str:
        return json.dumps([self.tree.plain(), None if self.common is None else sorted(self.common), sorted(self.seen)])

    @property
    def enough(self) -> bool:
        return len(self.seen) >= ENOUGH

    def place(self) -> tuple[Fold | None, set[int]]:
        """The container that is the article's place (None: there is none), and the ids of containers of links within it."""
        if self._place is None:
            self._place = article_place(self.tree) if self.enough else (None, set())
        return self._place


def loads(text: str) -> Template:
    tree, common, seen = json.loads(text)
    return Template(thaw(tree), None if common is None else set(common), set(seen))


def induced(page: str) -> Template:
    """The template of one page."""
    root = parse(page)
    texts = all_texts(root)
    return Template(folded([root]), texts or None, {crc32(page.encode("utf-8", "replace"))} if texts else set())


def article_place(tree: Fold) -> tuple[Fold | None, set[int]]:
    """See Template.place(). Nodes that tags and names mark don't count, nor do constant texts."""
    sums: dict[int, list[int]] = {}  # characters of varying text and of links below each node
    order, steps = [], [(tree, False, False)]
    while steps:
        x, link, main = steps.pop()
        order.append((x, link))
        tag = x.sign.partition(" ")[0]
        for k in x.kids:
            if not marked(Node(k.sign.partition(" ")[0], k.sign), main or tag in MAIN_TAGS):
                steps.append((k, link or k.sign.partition(" ")[0] == "a", main or tag in MAIN_TAGS))
    for x, link in reversed(order):
        own = 0 if x.text > 0 else x.chars
        sums[id(x)] = [0 if link else own, own if link else 0]
        for k in x.kids:
            if id(k) in sums:
                sums[id(x)][0] += sums[id(k)][0]
                sums[id(x)][1] += sums[id(k)][1]
    place, found = tree, None
    while sums[id(place)][0]:
        holds = [k for k in place.kids if id(k) in sums and k.nodes == k.pages and sums[id(k)][0] >= MOST * sums[id(place)][0] and any(g.sign.partition(" ")[0] in BLOCK for g in k.kids)]
        if not holds:
            break
        place = holds[0]
        found = place if place.sign.partition(" ")[0] not in ("html", "body") else found
    links = set()
    for x, _ in order:
        text, linked = sums[id(x)]
        if linked and linked >= LINKS * (text + linked) and x.sign.partition(" ")[0] in BLOCK and any(g.sign.partition(" ")[0] in BLOCK for g in x.kids):
            links.add(id(x))
    return found, links


def marked(node: Node, in_main: bool) -> bool:
    """Whether tags or names say that a node isn't part of the article."""
    if node.tag in ASIDE_TAGS or (node.tag == "header" and not in_main):
        return True
    names = node.sign.partition(" ")[2]
    words = ASIDE_ARTICLES if node.tag == "article" else ASIDE_WORDS
    return bool(names) and node.tag not in ("main", "body", "html") and not words.isdisjoint(re.split(r"[^a-z]+", names))


def placed_nodes(page: Fold, host: Template) -> tuple[set[int], set[int], list[Node]]:
    """Of a page: elements whose own text is constant on the host's pages, containers of links, and those at the article's place."""
    constant: set[int] = set()
    without: set[int] = set()
    place, links = host.place()
    inside, memo, steps = [], {}, [(page, host.tree)]
    while steps:
        x, y = steps.pop()
        if host.enough and y.text > 0 and host.tree.pages >= ENOUGH:
            constant.update(map(id, x.of))
        if id(y) in links:
            without.update(map(id, x.of))
        if y is place:
            inside += x.of
        steps += [(a, b) for a, b in match(x, y, memo)[1] if a is not None and b is not None]
    if len(host.seen) >= MANY and host.common:
        todo = list(page.of)
        while todo:
            node = todo.pop()
            if (texts := own_texts(node)) and checksum(texts) in host.common:
                constant.add(id(node))
            todo += [k for k in node.kids if not isinstance(k, str)]
    return constant, without, inside


def blocks(root: Node, constant: set[int], without: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks under ``root`` in page order, without marked nodes, those of ``without`` and constant texts."""
    out, line = [], []

    def close() -> None:
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    steps: list = [(root, root.tag in MAIN_TAGS)]
    while steps:
        node, main = steps.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            line.append(node)
        else:
            block = node.tag in BLOCK
            if block:
                close()
            if node.tag == "br":
                line.append(" ")
            rest: list = [(None, main)] if block else []
            own = id(node) not in constant
            for k in reversed(node.kids):
                if isinstance(k, str):
                    if own:
                        rest.append((k, main))
                elif not marked(k, main) and id(k) not in without:
                    rest.append((k, main or k.tag in MAIN_TAGS))
            steps += rest
    close()
    return out


def regions(root: Node) -> list[Node]:
    """Outermost article or main elements that aren't within marked ones."""
    out, steps = [], [root]
    while steps:
        for k in reversed(steps.pop().kids):
            if not isinstance(k, str) and not marked(k, False):
                if k.tag in MAIN_TAGS or "role" in k.sign and k.sign.endswith(" main"):
                    out.append(k)
                else:
                    steps.append(k)
    return out


def main_text(page: str, template: Template | None) -> str:
    """The article of a page: the slots at its host's place of the article. Where the host has none, or the page nothing there, the slots in its
    main element or its articles, if it has any and no more varies outside of them; else its body's slots, without the
    articles where there are several, as cards are. Should the template cover all of an article or
    page, nothing tells it apart, and all its unmarked text stays."""
    root = parse(page)
    template = template or induced(page)
    constant, without, inside = placed_nodes(folded([root]), template)
    found = [b for r in inside for b in blocks(r, constant, without)]
    if found:
        return "\n\n".join(found)
    places = _in_order(root, regions(root))
    found = [b for r in places for b in blocks(r, constant)] or [b for r in places for b in blocks(r, set())]
    if found and template.enough and all(r.tag == "article" for r in places):
        outside = blocks(root, constant, set(map(id, places)))
        if sum(map(len, outside)) > sum(map(len, found)):
            found = outside if len(places) > 1 else blocks(root, constant)
    if not found:
        found = blocks(root, constant) or blocks(root, set())
    return "\n\n".join(found)


def _in_order(root: Node, some: list[Node]) -> list[Node]:
    if len(some) < 2:
        return some
    want, out, steps = set(map(id, some)), [], [root]
    while steps:
        node = steps.pop()
        if id(node) in want:
            out.append(node)
        steps += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def any_depth() -> None:
    """Trees as deep as pages nest them: Python's own functions may call each other as often as memory allows."""
    sys.setrecursionlimit(1 << 30)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): each host's merged tree as JSON. ``pages``: host, html."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_depth()
        for b in batches:
            found: dict[str, Template] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = induced(page.as_py() or "")
                if host in found:
                    found[host].add(one)
                else:
                    found[host] = one
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([t.dumps() for t in found.values()], pa.string())], names=["host", "template"])

    def add(group: pa.Table) -> pa.Table:
        any_depth()
        total = None
        for x in group.column("template"):
            one = loads(x.as_py())
            if total is None:
                total = one
            else:
                total.add(one)
        return pa.table({"host": group.column("host")[:1], "template": pa.array([total.dumps()])})

    schema = "host string, template string"
    parts = pages.select("host", "html").mapInArrow(some, schema)
    for key in (["host", "salt"], ["host"]):
        parts = (parts.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(64))) if "salt" in key else parts).groupBy(*key).applyInArrow(add, schema)
    return parts


#: Hosts whose templates may be broadcast, if these are small enough; with more, pages are joined by host, a hot host in parts.
TEMPLATES = 100_000


def extracted(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """All rows with their main text in ``out``: blocks joined by an empty line, '' if there is none.

    Null and empty pages have no text. Pages without a host share one template. Repeated pages and
    rows come back each. Of a host with few pages nothing counts as constant. Elements may nest to any depth.
    """
    names = shared.names_free(pages, "host", "template")
    rows = pages.withColumn(names["host"], host_of(F.col(url)))
    found = shared.stored(templates(rows.select(F.col(names["host"]).alias("host"), F.col(html).alias("html"))), "templates")
    found = found.withColumnsRenamed({"host": names["host"], "template": names["template"]})
    known: dict[str, Template] = {}

    @F.arrow_udf("string")
    def text(page: pa.Array, template: pa.Array) -> pa.Array:
        any_depth()
        texts = []
        for x, t in zip(page, template, strict=True):
            t = t.as_py()
            if t is not None and t not in known:
                if len(known) > 1000:
                    known.clear()
                known[t] = loads(t)
            texts.append(main_text(x.as_py() or "", known.get(t)))
        return pa.array(texts, pa.string())

    joined = shared.met(rows, found, names["host"], TEMPLATES, "left")
    return joined.withColumn(out, text(F.col(html), F.col(names["template"]))).select(*[c for c in pages.columns if c != out], out)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
