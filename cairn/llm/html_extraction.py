"""HTML extraction: wrapper induction over the pages of a host.

A page's DOM tree is reduced to its slots: elements keep tag, class and id, and siblings of one kind are one repeated
slot. One page of each host, the one with the least hash of its id, is the host's reference tree. Every page is aligned
with it, whole, by simple tree matching, which finds the largest set of matching nodes that keeps order and parents.
Over all different pages of a host it is counted how many hold a text in a slot, and how many characters of different
texts a slot holds. Texts that most pages with a slot have there are constant: they are template. The slots that hold the
varying texts are content: the wrapper's region is the article or main elements that have a good part of them, or else the
container that gathers most of them. Menus, headers, footers, asides, adverts, forms and comments inside the region go by
their tags, roles and names, and elsewhere with everything else outside it. Hosts with few pages have no wrapper, and
a page that has nothing in its wrapper's region doesn't use it: there the page's own region counts in the same way.

Scale: siblings of one kind are merged, so that matching meets an element's kinds of children once each and takes time in
proportion to the page. A page is parsed twice, once to count its slots against the reference and once to extract.
Counting sends hashes, pre-aggregated in each task. Wrappers are outlines of a few kB; they are broadcast while they are
few, and joined by host otherwise, where Spark splits a hot host. HTML is shuffled only in that join.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, pieces, release
from cairn.llm.url_filters import host_of

#: A text is template if this share of a host's different pages with its slot, of which there are at least so many, has it there.
CONSTANT_SHARE = 0.8
LEAST_PAGES = 8
#: The share of varying text that an article needs to be the content, and a container to be looked into for it.
ARTICLE_SHARE, DENSE_SHARE = 0.1, 0.7
#: Bytes of reference trees that are broadcast at most; more are joined.
BROADCAST_BYTES = 32 << 20
#: Slots of all hosts together whose numbers of pages are broadcast at most.
BROADCAST_SLOTS = 200_000
#: Characters of possible reference pages that a task holds, and references that it holds read.
HELD_CHARS = 32 << 20
HELD_REFERENCES = 1_000

# Fixed values of the HTML standard and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Elements that another start tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg math button select input textarea dialog menu object embed canvas audio video title head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header masthead menu modal nav "
    "navbar navigation newsletter notice notification pagination pager popup promo promoted promotion related replies responses share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar widget".split()
)
#: What a class of boilerplate may say besides, as in site-header; has-sidebar, nav-layout or related-work say something else.
AFFIXES = frozenset("area bar block bottom box form global item items link links list main page posts section site top".split())
#: Elements that are cut: by a name, or a form, as far as they don't hold the page's content; or in any case.
BY_NAME, ALWAYS = 1, 2
#: Ends the kind of slots of cut elements.
CUT = "\0"
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|article-body|content|entry|entry-content|main|main-content|post|post-body|story|text)(?:$|[\s_-])", re.IGNORECASE)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Names of an article's own header.
OWN_HEADER = re.compile(r"(?:article|entry|post|story)[_-]header", re.IGNORECASE)
#: Elements nested deeper than this are read as if they were not there; their text stays.
DEEPEST = 150
#: Never cut by name: an id there is made from the heading's own words.
HEADING = re.compile("h[1-6]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def named_boilerplate(words: str) -> bool:
    """Whether a whole class or id names boilerplate."""
    for word in words.lower().split():
        parts = re.split("[-_]+", word.strip("-_"))
        if any(p in BOILERPLATE_WORDS for p in parts) and all(p in BOILERPLATE_WORDS or p in AFFIXES for p in parts):
            return True
    return False


class Node:
    """An element: tag, names, whether it is boilerplate or marked as content, children; or a text, with the tag #text."""

    __slots__ = ("children", "content", "depth", "parent", "skip", "tag", "text", "weight", "words")

    def __init__(self, tag: str, words: str = "", skip: int = 0, content: bool = False, parent: Node | None = None):
        self.tag, self.words, self.skip, self.content, self.parent = tag, words, skip, content, parent
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.text, self.weight = "", 0

    @property
    def kind(self) -> str:
        return f"{self.tag}.{self.words}" if self.words else self.tag


def _element(tag: str, attributes: str, parent: Node) -> Node:
    by_tag = 0 if tag not in BOILERPLATE_TAGS or _inside_content(tag, parent) else BY_NAME if tag == "form" else ALWAYS
    if not attributes.strip():
        return Node(tag, "", by_tag, tag in ("article", "main"), parent)
    values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    words = " ".join(x for x in (values.get("class", ""), values.get("id", "")) if x)
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or bool(HIDDEN.search(values.get("style", "")))
    content = tag in ("article", "main") or role in ("main", "article") or bool(CONTENT_WORDS.search(words))
    named = tag not in ("html", "body", "main") and named_boilerplate(OWN_HEADER.sub("", words)) and not (tag == "article" and not re.search("comment|repl", words, re.IGNORECASE))
    if named and (HEADING.fullmatch(tag) or tag == "section" and _in_article(parent) and _names_a_section(values.get("class", ""), values.get("id", ""))):
        named = False
    skip = ALWAYS if hidden or role in BOILERPLATE_ROLES or by_tag == ALWAYS else BY_NAME if named or by_tag else 0
    return Node(tag, words, skip, content and not skip, parent)


def _names_a_section(classes: str, id_: str) -> bool:
    """Whether a section of an article has such a name for what it is about: an id, as generators make them from headings, but not that of comments."""
    return f"{classes} {id_}".strip().lower() == "discussion" or not named_boilerplate(classes) and not re.search("comment|repl|respon|disqus", id_, re.IGNORECASE)


def _inside_content(tag: str, parent: Node) -> bool:
    """An article's own header is part of the article."""
    return tag == "header" and parent.tag == "article"


def _in_article(node: Node | None) -> bool:
    while node and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def parse(page: str | None) -> Node:
    """The block tree of a page; never fails, whatever the markup. Text outside blocks is a leaf of its container."""
    root = Node("#root")
    at_node, text, at, source = root, [], 0, page or ""

    def flush() -> None:
        block = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if block:
            leaf = Node("#text", parent=at_node)
            leaf.text, leaf.weight = block, len(block)
            at_node.children.append(leaf)

    for m in iter(lambda: TOKEN.search(source, at), None):
        text.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif not m[1] and m[3].strip():
                inline = _element(tag, m[3], at_node)
                if inline.skip:  # a hidden or advertising span
                    at = _after(source, tag, at)
            continue
        if m[1]:
            opened = at_node
            while opened is not root and opened.tag != tag:
                opened = opened.parent
            if opened is not root:
                flush()
                at_node = opened.parent
            elif tag == "p":
                flush()
            continue
        flush()
        if tag in CLOSES_P:
            opened = at_node
            while opened is not root and opened.tag not in ("p", "td", "li", "div", "article", "section", "button"):
                opened = opened.parent
            if opened.tag == "p":
                at_node = opened.parent
        for ended in SIBLINGS.get(tag, ()):
            opened = at_node
            while opened is not root and opened.tag not in (ended, "ul", "ol", "dl", "table", "select"):
                opened = opened.parent
            if opened.tag == ended:
                at_node = opened.parent
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        node = _element(tag, m[3], at_node)
        if node.depth <= DEEPEST:
            at_node.children.append(node)
            at_node = node
    text.append(source[at:])
    flush()
    return root


def _after(source: str, tag: str, at: int) -> int:
    """Where the element of this inline tag that was just opened ends."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.IGNORECASE).finditer(source, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def weighed(node: Node) -> int:
    """Sets each node's weight, the characters of its text that no cut element holds."""
    if node.tag != "#text":
        inside = sum(weighed(c) for c in node.children)
        node.weight = 0 if node.skip else inside
    return node.weight


def kept(node: Node) -> Iterator[Node]:
    """The nodes that are not inside a cut element, in document order."""
    todo = [node]
    while todo:
        node = todo.pop()
        if not node.skip:
            yield node
            todo.extend(reversed(node.children))


def _has_text(node: Node) -> bool:
    return any(n.text for n in kept(node))


def _holds_article(node: Node) -> bool:
    """Whether an article or main element with text is inside, be it inside elements cut by name."""
    todo = [c for c in node.children if c.skip != ALWAYS]
    while todo:
        node = todo.pop()
        if not node.skip and node.tag in ("article", "main") and _has_text(node):
            return True
        todo.extend(c for c in node.children if c.skip != ALWAYS)
    return False


def _spared_weight(node: Node) -> int:
    return sum(n.weight for c in node.children for n in kept(c) if n.text)


def spare_content(root: Node) -> Node:
    """The tree, where elements cut by name stay if the page has its articles, or all of its text, only in them."""
    while True:
        nodes = list(kept(root))
        if any(n.content and _has_text(n) for n in nodes):
            break
        by_name = [c for n in nodes for c in n.children if c.skip == BY_NAME]
        found = [c for c in by_name if _holds_article(c)]
        if not found and not any(n.text for n in nodes):
            found = sorted((c for c in by_name if _spared_weight(c)), key=_spared_weight)[-1:]
        if not found:
            break
        for c in found:
            c.skip = 0
    weighed(root)
    return root


class Slot:
    """All elements of one kind under one parent slot: their kind, the slots inside, and the elements themselves."""

    __slots__ = ("children", "kind", "nodes")

    def __init__(self, kind: str):
        self.kind, self.children, self.nodes = kind, [], []

    def __getitem__(self, i: int):
        return (self.kind, self.children)[i]


def slots_of(root: Node) -> Slot:
    """The slots of a page; a slot's children have different kinds, in the order in which they first come."""
    top = Slot(root.kind)
    top.nodes.append(root)
    todo = [top]
    while todo:
        slot = todo.pop()
        by_kind: dict[str, Slot] = {}
        for node in slot.nodes:
            for child in node.children:
                kind = child.kind + CUT if child.skip else child.kind
                if kind not in by_kind:
                    by_kind[kind] = Slot(kind)
                    slot.children.append(by_kind[kind])
                by_kind[kind].nodes.append(child)
        todo.extend(slot.children)
    return top


def page_tree(page: str | None) -> Node:
    return spare_content(parse(page))


def _heaviest_chain(found: list[tuple[int, int, int]]) -> list[int]:
    """Which of found (i, j, size) make the heaviest chain in which i and j both rise; found is sorted by i and -j."""
    ranks = {j: r for r, j in enumerate(sorted({j for _, j, _ in found}), 1)}
    best: list[tuple[int, int]] = [(0, -1)] * (len(ranks) + 1)  # a Fenwick tree of prefix maxima: sum, where its chain ends
    before: list[int] = []
    for at, (_, j, size) in enumerate(found):
        top, r = (0, -1), ranks[j] - 1
        while r:
            top, r = max(top, best[r]), r & (r - 1)
        before.append(top[1])
        r = ranks[j]
        while r <= len(ranks):
            best[r] = max(best[r], (top[0] + size, at))
            r += r & -r
    top, r = (0, -1), len(ranks)
    while r:
        top, r = max(top, best[r]), r & (r - 1)
    chain, at = [], top[1]
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def simple_tree_matching(a, b, pairs: list | None = None) -> int:
    """The size of the largest matching of two trees of (kind, children), and in pairs the matched nodes.

    Only children of one kind are compared, and the best of them in order are a chain, so that trees whose siblings
    have different kinds take time in proportion to their size, but for a logarithm.
    """
    if a[0] != b[0]:
        return 0
    places: dict[str, list[int]] = {}
    for j, child in enumerate(b[1]):
        places.setdefault(child[0], []).append(j)
    found, inner = [], []
    for i, child in enumerate(a[1]):
        for j in reversed(places.get(child[0], ())):
            own: list | None = None if pairs is None else []
            found.append((i, j, simple_tree_matching(child, b[1][j], own)))
            inner.append(own)
    chain = _heaviest_chain(found)
    if pairs is not None:
        pairs.append((a, b))
        for at in chain:
            pairs.extend(inner[at])
    return 1 + sum(found[at][2] for at in chain)


def outline(slot: Slot) -> list:
    """What the reference keeps of a page: kinds only."""
    return [slot.kind, [outline(c) for c in slot.children]]


def numbered(reference: list) -> dict[int, int]:
    """Numbers of a reference's nodes in document order, by identity."""
    out: dict[int, int] = {}
    todo = [reference]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo.extend(reversed(node[1]))
    return out


def aligned(slots: Slot, reference: list, numbers: dict[int, int]) -> list[tuple[int, Slot]]:
    """Numbers of reference nodes and the page's slots matched with them."""
    pairs: list = []
    simple_tree_matching(slots, reference, pairs)
    return [(numbers[id(r)], slot) for slot, r in pairs]


def region(root: Node) -> list[Node]:
    """A page's own content region: the outermost elements marked as content with text, else the densest container.

    Articles come first, unless other marked elements have more text than all of them, as beside teasers.
    """
    marked, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if node.content and node.weight:
            marked.append(node)
        else:
            todo.extend(reversed(node.children))
    if marked:
        articles = [n for n in marked if n.tag in ("article", "main")]
        others = [n for n in marked if n.tag not in ("article", "main")]
        return articles if articles and sum(n.weight for n in articles) >= sum(n.weight for n in others) else others
    node = root
    while heavy := [c for c in node.children if c.children and any(n.children for n in c.children) and c.weight > DENSE_SHARE * node.weight]:
        node = heavy[0]
    return [node]


class Wrapper:
    """A host's reference, which of its nodes make the content region, and the template texts (hashes) of each node."""

    def __init__(self, reference: str, weights: dict[int, int], template: set[tuple[int, int]]):
        self.reference = json.loads(reference)
        self.numbers = numbered(self.reference)
        self.template = template
        self.sums: dict[int, int] = {}
        self._sum(self.reference, weights)
        self.region = self._region()

    def _sum(self, node: list, weights: dict[int, int]) -> int:
        number = self.numbers[id(node)]
        inside = [self._sum(c, weights) for c in node[1]]
        self.sums[number] = 0 if node[0].endswith(CUT) else weights.get(number, 0) + sum(inside)
        return self.sums[number]

    def weight(self, node: list) -> int:
        return self.sums[self.numbers[id(node)]]

    def _region(self) -> set[int]:
        whole, articles, todo = self.weight(self.reference), [], [self.reference]
        while todo:
            node = todo.pop()
            if not node[0].endswith(CUT):
                if node[0].split(".")[0] in ("article", "main") and self.weight(node) >= ARTICLE_SHARE * whole > 0:
                    articles.append(node)
                else:
                    todo.extend(node[1])
        if articles:
            return {self.numbers[id(n)] for n in articles}
        node = self.reference
        while heavy := [c for c in node[1] if any(n[1] for n in c[1]) and self.weight(c) > DENSE_SHARE * self.weight(node)]:
            node = heavy[0]
        return {self.numbers[id(node)]}

    def blocks(self, root: Node) -> list[str]:
        """The page's texts in the region that are not template, in document order.

        Articles of the page that match nothing in the reference, of which the host tells nothing, belong to the region.
        """
        matched = aligned(slots_of(root), self.reference, self.numbers)
        known = {id(n) for _, slot in matched for n in slot.nodes}
        inside = {id(n) for number, slot in matched if number in self.region for n in slot.nodes}
        inside |= {id(n) for n in region(root) if n.content and id(n) not in known}
        template = {id(n) for number, slot in matched for n in slot.nodes if n.text and (number, _hash(n.text)) in self.template} if self.template else ()
        tops, todo = [], [root]
        while todo:
            node = todo.pop()
            if id(node) in inside and not node.skip:
                tops.append(node)
            elif not node.skip:
                todo.extend(reversed(node.children))
        return [n.text for top in tops for n in kept(top) if n.text and id(n) not in template]


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of nodes in document order."""
    return [n.text for node in nodes for n in kept(node) if n.text]


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page, by its host's wrapper if there is one."""
    root = page_tree(page)
    return "\n".join((wrapper.blocks(root) if wrapper else []) or blocks(region(root)))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def references(pages: DataFrame) -> DataFrame:
    """host and reference (JSON outline) of the page with the least hash of its id in each host."""

    def outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        named = lambda: pd.DataFrame([(h, r, p, json.dumps(outline(slots_of(page_tree(x))))) for h, (r, p, x) in best.items()], columns=["host", "rank", "page_id", "reference"])
        for batch in batches:
            for host, rank, page_id, page in zip(batch["host"], batch["rank"], batch["page_id"], batch["html"], strict=True):
                if host not in best or (rank, page_id) < best[host][:2]:
                    best[host] = (rank, page_id, page)
            if sum(len(x) for _, _, x in best.values()) > HELD_CHARS:  # hosts of a long task leave in parts; the aggregation puts them together
                yield named()
                best = {}
        yield named()

    ranked = pages.where("html is not null and page_id is not null").select("host", F.xxhash64("page_id").alias("rank"), "page_id", "html")
    found = ranked.mapInPandas(outlines, "host string, rank long, page_id long, reference string")
    return found.groupBy("host").agg(F.min(F.struct("rank", "page_id", "reference")).alias("r")).select("host", "r.reference")


def with_references(pages: DataFrame, refs: DataFrame, size: int) -> DataFrame:
    return pages.join(F.broadcast(refs) if size <= BROADCAST_BYTES else refs, "host", "left")


def slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, node, text, page (hashes) and n_chars: what each reference node holds in each different page of a task."""
    parsed: dict[str, tuple] = {}
    for batch in batches:
        seen: set[tuple] = set()
        for host, page, reference in zip(batch["host"], batch["html"], batch["reference"], strict=True):
            root = page_tree(page)
            if len(parsed) > HELD_REFERENCES:
                parsed = {}
            if reference not in parsed:
                tree = json.loads(reference)
                parsed[reference] = tree, numbered(tree)
            name = _hash("\n".join(blocks([root])))
            seen |= {(host, number, _hash(n.text), name, len(n.text)) for number, slot in aligned(slots_of(root), *parsed[reference]) for n in slot.nodes if n.text}
        yield pd.DataFrame(list(seen), columns=["host", "node", "text", "page", "n_chars"])


def wrappers(pages: DataFrame, refs: DataFrame, size: int, share: float = CONSTANT_SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """host, reference, weights (of its nodes) and template (its constant texts) of hosts with enough pages. Copies of a page count once."""
    known = with_references(pages, refs, size).where("reference is not null and html is not null").select("host", "html", "reference")
    cells = materialize(known.mapInPandas(slot_counts, "host string, node int, text long, page long, n_chars int").distinct(), "slot-counts")
    by_text = cells.groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    by_node = cells.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("pages"))
    by_node = materialize(by_node, "slot-pages")
    constant = by_text.join(F.broadcast(by_node) if by_node.count() <= BROADCAST_SLOTS else by_node, ["host", "node"]).withColumn("constant", (F.col("pages") >= least) & (F.col("n") >= share * F.col("pages")))
    # Constant texts say nothing about where the content is.
    by_slot = constant.groupBy("host", "node").agg(
        F.sum(F.when(F.col("constant"), 0).otherwise(F.col("n_chars"))).alias("weight"), F.collect_list(F.when(F.col("constant"), F.col("text"))).alias("template")
    )
    enough = cells.select("host", "page").distinct().groupBy("host").count().where(F.col("count") >= least).select("host")
    slots = by_slot.join(enough, "host").groupBy("host").agg(F.collect_list(F.struct("node", "weight", "template")).alias("slots"))
    made = materialize(refs.join(slots, "host"), "wrappers")
    release(cells, by_node)
    return made


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url and text. Ids stay in Arrow, where a null beside them changes none."""
    parsed: dict = {}
    for batch in pieces(batches, "html"):
        texts = []
        for host, page, reference, slots in zip(*(batch[c].to_pylist() for c in ("host", "html", "reference", "slots")), strict=True):
            if len(parsed) > HELD_REFERENCES:
                parsed = {}
            if reference is not None and host not in parsed:
                parsed[host] = Wrapper(reference, {s["node"]: s["weight"] for s in slots}, {(s["node"], t) for s in slots for t in s["template"]})
            texts.append(extract(page, parsed.get(host) if reference is not None else None))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row for each row of pages (page_id, url, html; other columns are ignored).

    White space inside a block is one space, blocks are joined by a line feed. Null and empty pages, and pages without
    content, have an empty text. A null URL, or one without host, is of the empty host. Repeated rows are extracted
    each, and count once for the template. Ties for the reference go to the smaller page_id, and rows without page_id are never one.
    An empty table gives an empty result.
    """
    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    refs = materialize(references(taken), "references")
    size = refs.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0
    known = wrappers(taken, refs, size)
    size = known.agg(F.sum(F.octet_length("reference") + F.octet_length("host") + 16 * F.size("slots") + 8 * F.size(F.flatten("slots.template")))).first()[0] or 0
    ready = with_references(taken, known, size).select("page_id", "url", "host", "html", "reference", "slots")
    return ready.mapInArrow(texts_of, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = None
