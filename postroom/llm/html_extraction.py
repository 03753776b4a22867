"""Main text of HTML pages by wrapper induction: pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, checked_broadcast
from postroom.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# FIXED VALUES: element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select body html article main section div nav aside".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())

# What is never main text: by element, by role, and by a word in class or id.
LEFT_OUT = frozenset("nav header footer aside head select button dialog menu svg object canvas audio video datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar note".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ads?|advert\w*|adbox|banner|promo\w*|"
    r"sponsor\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|comments?|replies|respond|disqus|"
    r"discussion|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|newsletter|subscribe|signup|login|"
    r"search|widget|toolbar|copyright|legal|disclaimer|skip)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
KEEP_WHATEVER_HINT = PROSE - {"li", "td", "th"} | {"html", "body", "main", "article"}
# Where a hint has to be a whole class or id, as lists and cells are part of the text more often than not.
WHOLE_NAME_HINT = frozenset("ul ol dl table tbody tr li td th".split())

# A text is template if it is in its slot on at least this share of a host's pages that differ, of at least so many;
# for paragraphs, list items, cells and other prose the share is higher. Prose in an article is kept, as the page itself
# calls it content, and so is constant prose longer than this and than the rest of its page, which is a near copy then.
CONSTANT_PERCENT = 50
CONSTANT_PROSE_PERCENT = 90
LEAST_PAGES = 5
TRUSTED_PROSE_CHARS = 500
TEMPLATE_HOSTS = 100_000


class Node:
    __slots__ = ("tag", "label", "out", "doubtful", "constant", "children")

    def __init__(self, tag: str, label: str = "", out: bool = False, doubtful: bool = False) -> None:
        self.tag, self.label, self.out = tag, label or tag, out
        self.doubtful = doubtful  # left out by a hint or as a form, unless the page's text lies in it
        self.constant = False  # its own text is template; what lies in blocks below it is judged by itself
        self.children: list[Node | str] = []


def hinted(tag: str, names: str) -> bool:
    """Whether a class or id of an element tells that it is no main text; paragraphs and headings are told by template only."""
    if tag in KEEP_WHATEVER_HINT:
        return False
    if tag in WHOLE_NAME_HINT:
        return any((m := HINT.match(name)) and m.end() == len(name) for name in names.split())
    return bool(HINT.search(names))


def element(tag: str, attributes: str) -> Node:
    label, out, doubtful = tag, tag in LEFT_OUT, tag == "form"
    if "=" in attributes or "hidden" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if names != " ":
            label = f"{tag}.{re.sub(r'[^a-z]+', '-', names.lower())}"
            doubtful = doubtful or hinted(tag, names)
        out = out or found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true"
        out = out or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))
        out = out or "display:none" in found.get("style", "").replace(" ", "").lower()
    return Node(tag, label, out, doubtful)


def parse(source: str) -> Node:
    """Tree of a page; unclosed and misplaced tags are mended as browsers mostly do."""
    root = Node("html")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # tags on the stack above the root

    def close_from(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while True:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in ("html", "body") and len(stack) == 1 and not m[1]:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            if depth and not (tag in INLINE and any(n.tag not in INLINE for n in stack[depth + 1 :])):
                close_from(depth)
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            at = close.end() if close else len(source)
            continue
        node = element(tag, m[3])
        if tag in VOID:
            stack[-1].children.append(node)
            continue
        ends = ("p",) if tag in ENDS_PARAGRAPH else ENDS_SAME.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
            if stack[i].tag in ends:
                close_from(i)
                if tag not in ("tr",):
                    break
            elif stack[i].tag in SCOPE:
                break
        stack[-1].children.append(node)
        stack.append(node)
        opened[tag] += 1


Skeleton = tuple[str, tuple]
# Labels of a tree in preorder, and how many nodes each subtree has: no depth is too deep for it.
Flat = tuple[list[str], list[int]]


def skeleton(root: Node, owned: list[list], places: list[list[Node]]) -> Flat:
    """Labels of the block elements below ``root``; neighbours that look alike become one repeated slot.

    ``places`` gets the nodes that fill each slot, ``owned`` their own texts, both in preorder. What is left out
    for certain has no slot.
    """
    # 1. Own text and block children of each block, through inline elements.
    order: list[Node] = [root]
    parts: dict[int, list[str]] = {id(root): []}
    kids: dict[int, list[Node]] = {id(root): []}
    todo = [(c, root) for c in reversed(root.children)]
    while todo:
        c, block = todo.pop()
        if isinstance(c, str):
            parts[id(block)].append(c)
            continue
        if c.out:
            continue
        if c.tag not in INLINE and c.tag not in VOID:
            kids[id(block)].append(c)
            order.append(c)
            parts[id(c)], kids[id(c)], block = [], [], c
        todo.extend((x, block) for x in reversed(c.children))
    # 2. A number per shape, from the leaves up: children come after their parent in ``order``.
    numbers: dict[tuple, int] = {}
    shapes: dict[int, int] = {}
    for n in reversed(order):
        runs: list[int] = []
        for kid in kids[id(n)]:
            if not runs or runs[-1] != shapes[id(kid)]:
                runs.append(shapes[id(kid)])
        shapes[id(n)] = numbers.setdefault((n.label, *runs), len(numbers))
    # 3. Slots from the root down: nodes of one shape in a run fill one slot, and so do their like children.
    labels: list[str] = []
    above: list[int] = []
    groups: list[tuple[list[Node], int]] = [([root], -1)]
    while groups:
        nodes, parent = groups.pop()
        at = len(labels)
        labels.append(nodes[0].label)
        above.append(parent)
        owned.append([text_of(parts[id(n)]) for n in nodes])
        places.append(nodes)
        runs_of: list[list[Node]] = []
        for n in nodes:
            run, last = -1, None
            for kid in kids[id(n)]:
                if shapes[id(kid)] != last:
                    run, last = run + 1, shapes[id(kid)]
                if run == len(runs_of):
                    runs_of.append([])
                runs_of[run].append(kid)
        groups.extend((r, at) for r in reversed(runs_of))
    sizes = [1] * len(labels)
    for at in range(len(labels) - 1, 0, -1):
        sizes[above[at]] += sizes[at]
    return labels, sizes


def flat(tree: Skeleton) -> Flat:
    labels, above, todo = [], [], [(tree, -1)]
    while todo:
        (label, children), parent = todo.pop()
        at = len(labels)
        labels.append(label)
        above.append(parent)
        todo.extend((c, at) for c in reversed(children))
    sizes = [1] * len(labels)
    for at in range(len(labels) - 1, 0, -1):
        sizes[above[at]] += sizes[at]
    return labels, sizes


def below(tree: Flat, at: int) -> list[int]:
    """Positions of a node's children."""
    found, end, at = [], at + tree[1][at], at + 1
    while at < end:
        found.append(at)
        at += tree[1][at]
    return found


def matched_children(xs: list[int], ys: list[int], sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + sizes.get((x, y), 0))
    return best


def match(a: Flat, b: Flat) -> tuple[int, dict[int, int]]:
    """As ``simple_tree_matching``, of flat trees, by stacks of its own."""
    if a[0][0] != b[0][0]:
        return 0, {}
    below_a = [below(a, i) for i in range(len(a[0]))]
    below_b = [below(b, j) for j in range(len(b[0]))]
    # Pairs whose ancestors agree level by level; children come after their parents.
    pairs = [(0, 0)]
    for x, y in pairs:
        pairs.extend((i, j) for i in below_a[x] for j in below_b[y] if a[0][i] == b[0][j])
    sizes: dict[tuple[int, int], int] = {}
    for x, y in reversed(pairs):
        sizes[x, y] = matched_children(below_a[x], below_b[y], sizes)[-1][-1] + 1
    met, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        met[x] = y
        xs, ys = below_a[x], below_b[y]
        best, i, j = matched_children(xs, ys, sizes), len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return sizes[0, 0], met


def simple_tree_matching(a: Skeleton, b: Skeleton) -> tuple[int, dict[int, int]]:
    """Largest order-keeping match of two trees whose roots agree: its size, and preorder positions of ``a`` to those of ``b``."""
    return match(flat(a), flat(b))


@lru_cache(maxsize=20_000)
def aligned(page: str, reference: str) -> dict[int, int]:
    """Slots of a page to slots of the host's reference, both as JSON of their flat skeletons."""
    a = json.loads(page)
    if page == reference:
        return {i: i for i in range(len(a[0]))}
    return match(a, json.loads(reference))[1]


def spaced(text: str) -> str:
    return " ".join(text.split())


def text_of(parts: list[str]) -> str:
    return spaced(html.unescape("".join(parts)))


def text_keys(texts: list[str]) -> list[int]:
    """A key for each text of a slot, 0 for a blank one: 64 bits of a hash of it and of how often the slot has it.

    So a notice counts, which each page has once, but not a cell value that each page has some times.
    """
    counts = Counter(texts)
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"), seed=counts[t]) - (1 << 63) or 1 if t else 0 for t in texts]


def sketch(source: str) -> tuple[str, list[list[int]]]:
    """Flat skeleton of a page as JSON, and the keys of each slot's texts that are not blank."""
    owned: list[list[str]] = []
    form = skeleton(parse(source), owned, [])
    return json.dumps(form), [sorted(set(text_keys(texts)) - {0}) for texts in owned]


@lru_cache(maxsize=1_000)
def prose_slots(reference: str) -> list[bool]:
    return [label.split(".")[0] in PROSE for label in json.loads(reference)[0]]


def settle(root: Node, evidence: bool, nothing_else: bool = False) -> bool:
    """Decide the doubtful nodes: whether any was taken back.

    A hint or a form does not cut a node that holds ``main``, nor one with more than half of the page's
    text that is not template, if the host's pages tell what is or the node holds an article. If nothing
    else is left, all are taken back.
    """
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, root.constant)]
    while todo:
        node, above, constant = todo.pop()
        order.append((node, above, constant))
        todo.extend(
            (c, node, constant if c.tag in INLINE else c.constant) for c in node.children if isinstance(c, Node) and not c.out
        )
    if not any(node.doubtful for node, _, _ in order):
        return False
    chars: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    for node, above, constant in reversed(order):
        at = id(node)
        chars[at] = chars.get(at, 0) + (0 if constant else sum(len(c.strip()) for c in node.children if isinstance(c, str)))
        if above:
            chars[id(above)] = chars.get(id(above), 0) + chars[at]
            holds.setdefault(id(above), set()).update(holds.get(at, ()), {node.tag} & {"article", "main"})
    taken = False
    for node, _, _ in order:
        if node.doubtful:
            inside = holds.get(id(node), set())
            most = 2 * chars[id(node)] > chars[id(root)]
            if nothing_else or "main" in inside or most and (evidence or "article" in inside):
                node.doubtful, taken = False, True
    return taken


def running(top: Node) -> tuple[int, int]:
    """Characters below ``top`` that are neither left out, template nor inside a link: all of them, and those inside articles."""
    total = inside = 0
    todo: list[tuple[Node | str, bool, bool]] = [(c, top.constant, top.tag == "article") for c in top.children]
    while todo:
        c, constant, article = todo.pop()
        if isinstance(c, str):
            n = 0 if constant else len(c.strip())
            total, inside = total + n, inside + n * article
        elif not c.out and not c.doubtful and c.tag != "a":
            inner = constant if c.tag in INLINE else c.constant
            todo.extend((x, inner, article or c.tag == "article") for x in c.children)
    return total, inside


def tops(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a kind that are not left out."""
    found, todo = [], list(reversed(root.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and not c.out and not c.doubtful:
            if c.tag == tag:
                found.append(c)
            else:
                todo.extend(reversed(c.children))
    return found


def text_roots(root: Node) -> list[Node]:
    """Where a page's text lies: its articles, if they hold at least half of the running text of what is around them.

    Around them is ``main``, if there is one with running text that articles outside it do not exceed, else
    the whole page. So a teaser that is marked up as an article beside the text does not stand for the page.
    """
    around = tops(root, "main")
    total, inside = (sum(n) for n in zip(*map(running, around), strict=True)) if around else (0, 0)
    whole, articles = running(root)
    if not total or articles - inside > total:
        around, total, inside = [root], whole, articles
    if 2 * inside >= total:
        found = [a for top in around for a in tops(top, "article")]
        return [a for a in found if running(a)[0]] or found or around
    return around


def read(root: Node) -> str:
    """Text of the articles, or of ``main``, or of the whole body, without what is left out or constant."""
    blocks: list[str] = []
    for top in text_roots(root):
        blocks.append(" ")
        todo = [(c, top.constant) for c in reversed(top.children)]
        while todo:
            c, constant = todo.pop()
            if isinstance(c, str):
                if not constant:
                    blocks.append(c)
            elif c.tag == "br" or c.tag == "hr":
                blocks.append(" ")
            elif not c.out and not c.doubtful and c.tag not in VOID:
                edge = "" if c.tag in INLINE else " "
                inner = constant if c.tag in INLINE else c.constant
                blocks.append(edge)
                todo.append((edge, False))
                todo.extend((x, inner) for x in reversed(c.children))
    return text_of(blocks)


def main_text(source: str, template: tuple[str, dict[int, set[int]]] | None = None) -> str:
    """Main text: the article, or what is left of the body, without what is boilerplate by role or by template."""
    root = parse(source)
    if template:
        owned: list[list[str]] = []
        places: list[list[Node]] = []
        form = skeleton(root, owned, places)
        slots = aligned(json.dumps(form), template[0])
        rest, prose, article_end = 0, [], 0
        for slot, (texts, nodes) in enumerate(zip(owned, places, strict=True)):
            constant = template[1].get(slots.get(slot, -1), ())
            if nodes[0].tag == "article":
                article_end = max(article_end, slot + form[1][slot])
            inside = slot < article_end
            for text, node, k in zip(texts, nodes, text_keys(texts), strict=True):
                node.constant = k in constant and not (inside and node.tag in PROSE)
                if not node.constant:
                    rest += len(text)
                elif node.tag in PROSE:
                    prose.append((node, len(text)))
        if sum(n for _, n in prose) > max(rest, TRUSTED_PROSE_CHARS):
            for node, _ in prose:
                node.constant = False
    settle(root, template is not None)
    text = read(root)
    if not text and settle(root, template is not None, nothing_else=True):
        text = read(root)
    return text


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null for null and for a URL that names none."""
    found = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(found, F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """Template per host from ``host, html``: ``host, reference, constants``.

    The reference is the host's most frequent skeleton. Every page is aligned with it; per matched slot
    the texts are counted over all pages, and those on at least half of them (prose: nine tenths) become
    constants. Pages of a host with the same skeleton and texts count once, as copies do not tell a
    template. Counts combine on the map side, so a host with a third of all pages costs no task more than
    the others.
    """
    def sketched(batch: dict[str, list]):
        for host, source in zip(batch["host"], batch["html"], strict=True):
            yield host, *sketch(source or "")

    sketches = arrow_map(pages.filter(F.col("host").isNotNull()).select("host", "html"), sketched, "host string, form string, texts array<array<long>>")
    forms = cut_lineage(sketches.withColumn("print", F.xxhash64("form", "texts")).dropDuplicates(["host", "print"]).drop("print"))
    counted = forms.groupBy("host", "form").count()
    references = counted.groupBy("host").agg(
        F.max_by("form", F.struct("count", "form")).alias("reference"), F.sum("count").alias("pages")
    ).filter(F.col("pages") >= LEAST_PAGES)

    def matched(batch: dict[str, list]):
        counts: dict[tuple, int] = {}
        for host, form, texts, reference in zip(batch["host"], batch["form"], batch["texts"], batch["reference"], strict=True):
            prose = prose_slots(reference)
            for slot, other in aligned(form, reference).items():
                for text in texts[slot]:
                    at = (host, other, prose[other], text)
                    counts[at] = counts.get(at, 0) + 1
        return ((*k, n) for k, n in counts.items())

    met = forms.join(checked_broadcast(references, TEMPLATE_HOSTS), "host").select("host", "form", "texts", "reference")
    constants = (
        arrow_map(met, matched, "host string, slot int, prose boolean, text long, n long")
        .groupBy("host", "slot", "prose", "text").agg(F.sum("n").alias("n"))
        .join(checked_broadcast(references.select("host", "pages"), TEMPLATE_HOSTS), "host")
        .filter(F.col("n") * 100 >= F.col("pages") * F.when(F.col("prose"), CONSTANT_PROSE_PERCENT).otherwise(CONSTANT_PERCENT))
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "text"))).alias("constants"))
    )
    return references.join(constants, "host", "left").select("host", "reference", "constants")


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page.

    Null and empty HTML give an empty text. Pages without a host, or of a host with fewer than five
    pages, are read without a template. Rows repeat as they come, null keys stay null, an empty table
    gives an empty result; other columns are not read.
    """
    rows = pages.select(
        pages[key].alias("page_id"), pages[url].alias("url"), pages[source].alias("html"), host_of(pages[url]).alias("host")
    )
    templates = cut_lineage(induce(rows))
    met = rows.join(checked_broadcast(templates, TEMPLATE_HOSTS), "host", "left").select("page_id", "url", "html", "reference", "constants")

    def run(batch: dict[str, list]):
        for page_id, address, page, reference, constants in zip(*(batch[c] for c in ("page_id", "url", "html", "reference", "constants")), strict=True):
            template = None
            if reference is not None:
                slots: dict[int, set[int]] = {}
                for c in constants or ():
                    slots.setdefault(c["slot"], set()).add(c["text"])
                template = (reference, slots)
            text = main_text(page or "", template)
            yield page_id, address, text, len(text)

    kind = dict(rows.dtypes)["page_id"]
    return arrow_map(met, run, f"page_id {kind}, url string, text string, n_chars long")
