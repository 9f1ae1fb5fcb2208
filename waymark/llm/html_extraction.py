"""Main text of web pages by composite text density.

Every block element has characters per tag, adjusted for the share of its links. The element whose children's
densities sum highest is the core of the article; other elements at least as dense as the thinnest element between the
core and the body belong to it too. All text below their common ancestor, or the outermost article or main element
around it, is kept, but for parts that are boilerplate by
their element or role. A container whose name (class or id) says nothing but comments, sidebar, advert, notice or
sign-up box goes wherever it stands. Any other name only keeps a part out of the choice: below the chosen ancestor such a part
goes when it is thinner than the threshold, inside an article or main element when most of it is links or it holds form
controls. Headings never go by their names, and a form or named part that holds the title, the article or most of the
page's plain text stays.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import map_texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea canvas audio video title annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br "
    "math semantics mrow mi mo mn ms mtext mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover".split()
)
DROPPED = frozenset("nav footer aside form button select option menu dialog fieldset datalist head".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
NAMES = re.compile(
    r"(?:[a-z0-9]+[-_])*(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|"
    r"notifications?|alerts?|popups?|modal|overlay|newsletter|subscri\w+|sign-?up|log-?in|paywall|side-?bars?|aside|rail|menus?|"
    r"nav|navbar|navigation|breadcrumbs?|toc|header|masthead|topbar|footer|copyright|disclaimer|shar(?:e|ing)|social|related|"
    r"recommend\w*|widgets?|comments?|commentlist|disqus|respond|repl(?:y|ies)|reader-?comments?|discussion|pagination|pager|toolbar|search|"
    r"skip-?link|trending|outbrain|taboola)(?:[-_][a-z0-9]+)*",
    re.I,
)
# Name parts that say what a container is; those that an id may say as well (other ids are often made from
# headings); parts that say nothing more.
CLEAR = re.compile(
    r"ads?|advert\w*|adsense|adbox|sponsor(?:ed|ship)?|cookies?|consent|gdpr|notices?|newsletters?|subscri\w+|signup|paywall|popups?|"
    r"sidebars?|comments?|commentlist|disqus|respond|breadcrumbs?|navbar|pagination|outbrain|taboola"
)
CLEAR_ID = re.compile(r"sidebars?|comments?|commentlist|disqus|respond")
NEUTRAL = re.compile(r"box|wrap|wrapper|container|section|list|area|block|inner|item|top|bottom|left|right|slot|thread|form|\d+")
COMMENTS = re.compile(r"comments?|commentlist|disqus|respond")
#: Elements of running text, which go by no clear name; parts whose name is only a topic's keep their paragraphs.
PROSE = frozenset("p li dt dd td th tr pre blockquote figcaption span h1 h2 h3 h4 h5 h6".split())
TOPICS = re.compile(r"discussion|search|related|social|notices?|alerts?|sharing|repl(?:y|ies)", re.I)
CONTROLS = frozenset("input select textarea button".split())
#: Elements that end an open paragraph, and that end an open element of their own kind.
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table menu".split())


class Node:
    __slots__ = (
        "tag", "parent", "children", "named", "holds_title", "out", "chars", "tags", "link_chars", "link_tags", "sum",
        "controls", "plain",
    )

    def __init__(self, tag: str, parent: "Node | None", named: int = 0):
        self.tag, self.parent, self.named = tag, parent, named
        self.controls = self.plain = 0  # form controls and characters outside links, with all below
        self.children: list[Node | str] = []  # strings are pieces of text
        self.holds_title = False
        self.out = False  # boilerplate by name
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = 0.0


#: How far a name speaks: for a topic, for a part of a page, for boilerplate, for reader comments.
TOPIC, PART, CLEARLY, BY_READERS = 1, 2, 3, 4


def _name_level(token: str, by_id: bool) -> int:
    """How surely a class or id that ``NAMES`` knows tells boilerplate."""
    parts = re.split("[-_]", token.lower().replace("side-bar", "sidebar").replace("sign-up", "signup"))
    clear = [p for p in parts if (CLEAR_ID if by_id else CLEAR).fullmatch(p)]
    if clear and all(p in clear or NAMES.fullmatch(p) or NEUTRAL.fullmatch(p) for p in parts):
        return BY_READERS if any(map(COMMENTS.fullmatch, clear)) else CLEARLY
    return TOPIC if TOPICS.fullmatch(token) else PART


def _named_boilerplate(attributes: str) -> tuple[bool, int]:
    """(boilerplate by role or hidden, level of its class or id, 0 for none)."""
    by_name = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, by_name
        if name == "role" and value.lower() in ROLES:
            return True, by_name
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, by_name
        if name in ("class", "id"):
            for token in value.split():
                if NAMES.fullmatch(token) and not re.match(r"(?:has|no|with|is|page|body|without)[-_]|.*[-_]with[-_]", token, re.I):
                    by_name = max(by_name, _name_level(token, name == "id"))
    return False, by_name


def parse(page: str) -> Node:
    """Tree of the block elements; inline elements only leave their text (links with a mark around it)."""
    root = Node("body", None)
    node, open_links = root, 0
    at, n = 0, len(page)
    stack: list[tuple[str, Node | None]] = []  # open elements; inline ones have no node
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                node.children.append(piece)
                if open_links:
                    node.link_chars += len(piece.strip())
            continue
        closing, tag, attributes = bool(m[1] or m[4]), tag.lower(), m[3] or m[6] or ""
        if tag in ("html", "body"):
            continue
        if not closing and tag in CONTROLS:
            node.controls += 1
        if not closing and tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            node.children.append(" ")
            continue
        if not closing and tag == "xmp":  # its markup is text
            end = re.compile(r"</xmp\b[^>]*(?:>|\Z)", re.I).search(page, at)
            child = Node("pre", node)
            child.children.append(html.escape(page[at : end.start() if end else n]))
            node.children.append(child)
            at = end.end() if end else n
            continue
        if tag == "a":
            if closing:
                open_links = max(0, open_links - 1)
            else:
                open_links += 1
                node.link_tags += 1
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                node.children.append(" ")
            if not closing and not attributes.endswith("/") and tag not in VOID:
                hidden, named = _named_boilerplate(attributes) if attributes else (False, 0)
                if hidden or named:  # an inline advert or share link is a part of its own
                    child = Node("span", node, PART)
                    node.children.append(child)
                    stack.append((tag, node))
                    node = child
                elif any(t == tag for t, _ in stack):
                    stack.append((tag, None))
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if stack[i][1] is not None:
                            node = stack[i][1]
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            continue
        if closing:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                node = next(p for t, p in stack[place:] if p is not None)
                del stack[place:]
                if tag not in ("p", "li"):
                    open_links = 0
            continue
        # an open paragraph ends where a block starts; list items and cells end their kind up to the list
        for i in range(len(stack) - 1, -1, -1):
            kind = stack[i][0]
            if kind == "p" or kind in SAME_ENDS.get(tag, ()):
                node = next(p for t, p in stack[i:] if p is not None)
                del stack[i:]
                if kind == "p" and tag not in SAME_ENDS:
                    break
            elif kind in LISTS or kind not in INLINE and tag not in SAME_ENDS:
                break
        if tag in VOID:
            node.children.append(Node(tag, node))  # a rule parts two blocks
            continue
        hidden, named = _named_boilerplate(attributes) if attributes else (False, 0)
        child = Node("nav" if hidden or tag in DROPPED else tag, node, named)
        node.children.append(child)
        if not attributes.endswith("/"):
            stack.append((tag, node))
            node = child
        if tag in ("h1", "article", "main"):
            up = child
            while up is not None and not up.holds_title:
                up.holds_title = True
                up = up.parent
    return root


def _in_article(node: Node) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return True
        up = up.parent
    return False


def weigh(root: Node) -> None:
    """Fill in the plain characters and the form controls of every node."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        node.plain = max(sum(len(c.strip()) for c in node.children if not isinstance(c, Node)) - node.link_chars, 0)
        for c in node.children:
            if isinstance(c, Node):
                node.plain += c.plain
                node.controls += c.controls


def prune(root: Node) -> None:
    """Take out boilerplate by element and role; mark that by name.

    A form that holds the title, the article or most of the plain text is a frame around the page, and so is any other element
    of that kind around most of the plain text. Headings, and what is inside them or an article, are only marked by clear
    names; a part with most of the plain text is not, reader comments only where there is no other text. What holds most of
    the text beside a part that holds the title or the article (a long footer under a short article) is no frame.
    """
    weigh(root)
    todo = [(root, False, False)]
    while todo:
        node, spared, beside = todo.pop()
        spared = spared or node.tag in HEADINGS or node.tag in ("article", "main")
        titled = [c for c in node.children if isinstance(c, Node) and c.holds_title and c.tag != "h1"]
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                besides = beside or bool(titled) and (len(titled) > 1 or titled[0] is not c)
                most = 2 * c.plain > root.plain and not besides
                if c.tag in DROPPED and (most or c.tag in ("form", "fieldset") and c.holds_title):
                    c.tag = "div"
                if c.tag in DROPPED or c.tag == "header" and not most and not (c.holds_title and _in_article(c)):
                    kept.append(" ")
                    continue
                if c.holds_title or c.tag in HEADINGS or (c.plain == root.plain if c.named == BY_READERS else most):
                    c.named = 0
                elif c.named >= CLEARLY and c.tag in PROSE:
                    c.named = TOPIC
                c.out = c.named >= CLEARLY or c.named > 0 and not spared and not (c.tag in PROSE and c.named == TOPIC)
                todo.append((c, spared, besides))
            kept.append(c)
        node.children = kept


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags and link parts from the leaves up; nodes in document order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.out)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, Node):
                if c.out:
                    continue
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
            else:
                node.chars += len(c.strip())
    for node in order:
        own = sum(len(c.strip()) for c in node.children if not isinstance(c, Node))
        node.sum = float(own) + sum(density(c, root) for c in node.children if isinstance(c, Node))
    return order


def density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, less the more of them are links."""
    if not node.chars:
        return 0.0
    c, t = node.chars, max(node.tags, 1)
    links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(c - node.link_chars, 1)
    base = math.log(c / plain * links + body.link_chars / max(body.chars, 1) * c + math.e)
    return c / t * max(math.log(max(c * t / (links * link_tags), 1.0)) / base, 0.0)


def settle_names(top: Node, root: Node, threshold: float) -> None:
    """Decide below the chosen node which parts go by their names, once the page is measured."""
    todo = [(top, _in_article(top))]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        for c in node.children:
            if not isinstance(c, Node):
                continue
            if c.out:
                if c.named < CLEARLY:
                    measure(c)
                    c.out = density(c, root) < threshold
            elif c.named and inside:
                c.out = 2 * c.link_chars > c.chars or c.controls > 0 and 2 * c.plain <= root.plain
            if not c.out:
                todo.append((c, inside))


def content_root(root: Node) -> tuple[Node, float]:
    """The element that holds the main text, and the least density on the way from its core to the body."""
    order = measure(root)
    core = max(order, key=lambda x: x.sum)  # the outermost of equals comes first
    if not core.chars:
        return root, math.inf
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(density(x, root) for x in path)
    chosen = [core]
    for node in path[:-1]:
        chosen += [s for s in node.parent.children if isinstance(s, Node) and s is not node and s.chars and density(s, root) >= threshold]
    ancestors = [[x] for x in chosen]
    for line in ancestors:
        while line[-1].parent is not None:
            line.append(line[-1].parent)
    common = set(map(id, ancestors[0])).intersection(*[set(map(id, line)) for line in ancestors[1:]])
    top = next(x for x in ancestors[0] if id(x) in common)
    whole = [x for x in ancestors[0][ancestors[0].index(top) :] if x.tag in ("article", "main")]
    return (whole[-1] if whole else top), threshold


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.out:
            run.append(" ")
        elif x.tag == "span":
            todo.extend(reversed(x.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of a page, one line per block; empty for a page without any."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    top, threshold = content_root(root)
    settle_names(top, root, threshold)
    return "\n".join(blocks(top))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points of the text) of every page.

    Null and empty pages give an empty text, plain text without a tag is its own main text, and broken markup is read as
    far as it goes. Repeated rows give repeated results.
    """

    def columns(texts):
        found = [main_text(t) for t in texts]
        return {"text": found, "n_chars": [len(t) for t in found]}

    return map_texts(pages.select("page_id", "url", F.col("html").alias("_html")), columns, "text string, n_chars bigint", "_html")
